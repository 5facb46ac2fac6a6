import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from drayage import lifecycle, schemas
from drayage.plans import dashboard, quality, states
from drayage.sources.mart import SourceMart
from drayage.sources.tables import SOURCE_TABLES, read_table
from tests.conftest import DATA


def counts(mart):
    return {r.table_name: r.row_count for r in quality.row_counts(mart).collect()}


def test_build_keep_rebuild_comment_and_drop(spark, mart):
    schema = "logistics_test"
    assert not lifecycle.table_present(spark, schema, "vehicles")
    first = lifecycle.build(spark, DATA, schema)
    assert first["schema"] == schema and first["tables"] == first["built"] == lifecycle.BUILD_ORDER
    stored = lifecycle.open_mart(spark, schema, mart.depots)
    assert counts(stored) == counts(mart)
    assert dashboard.kpis(stored).collect() == dashboard.kpis(mart).collect()

    # a second build keeps everything; a lost table alone is rebuilt
    assert lifecycle.build(spark, DATA, schema)["built"] == []
    spark.sql(f"DROP VIEW {schema}.route_plans")
    assert lifecycle.build(spark, DATA, schema)["built"] == ["route_plans"]
    assert lifecycle.versions(spark, schema, "served_lines") == []

    lifecycle.add_comments(spark, schema)
    for table, fields in schemas.TABLES.items():
        described = {r.col_name: r.comment for r in spark.sql(f"DESCRIBE {schema}.{table}").collect()}
        for field in fields:
            assert described[field.name] == field.metadata["comment"]
        assert spark.table(f"{schema}.{table}").dtypes == [(f.name, f.dataType.simpleString()) for f in fields]

    report = lifecycle.drop(spark, schema)
    assert report == {
        "tables_dropped": ["route_stops", "route_plans", "delivery_orders", "vehicles"],
        "schema_dropped": True,
        "errors": {},
    }
    assert not spark.catalog.databaseExists(schema)
    assert lifecycle.drop(spark, schema)["schema_dropped"]


def test_drop_leaves_what_it_did_not_make(spark):
    lifecycle.ensure_schema(spark, "foreign_test")
    spark.range(3).write.saveAsTable("foreign_test.mine")
    report = lifecycle.drop(spark, "foreign_test")
    assert not report["schema_dropped"] and "foreign_test" in report["errors"]
    assert spark.table("foreign_test.mine").count() == 3
    spark.sql("DROP TABLE foreign_test.mine")
    assert lifecycle.drop(spark, "foreign_test")["schema_dropped"]


def test_empty_table_does_not_count_as_present(spark):
    lifecycle.ensure_schema(spark, "present_test")
    spark.createDataFrame([], schemas.VEHICLES).write.saveAsTable("present_test.vehicles")
    assert spark.catalog.tableExists("present_test.vehicles")
    assert not lifecycle.table_present(spark, "present_test", "vehicles")
    lifecycle.drop(spark, "present_test")


class Refused(PySparkException):
    def __init__(self, condition, state, text):
        super().__init__(text)
        self._given = condition, state

    def getCondition(self):
        return self._given[0]

    def getSqlState(self):
        return self._given[1]


def test_schema_creation_without_permission(spark, monkeypatch):
    lifecycle.ensure_schema(spark, "granted_test")

    def refusing(condition, state, text="no"):
        def refuse(self, statement, *args, **kwargs):
            raise Refused(condition, state, text)

        return refuse

    for condition, state in (("INSUFFICIENT_PERMISSIONS.SCHEMA", None), ("OTHER", "42501")):
        monkeypatch.setattr(type(spark), "sql", refusing(condition, state))
        assert lifecycle.ensure_schema(spark, "granted_test") is False
        with pytest.raises(Refused):
            lifecycle.ensure_schema(spark, "never_made")
    # words in a message decide nothing
    monkeypatch.setattr(type(spark), "sql", refusing("INTERNAL_ERROR", "XX000", "permission denied by a full disk"))
    with pytest.raises(Refused):
        lifecycle.ensure_schema(spark, "granted_test")
    monkeypatch.undo()
    lifecycle.drop(spark, "granted_test")


def test_default_schema_is_an_identifier(spark):
    assert lifecycle.default_schema(spark).isidentifier() or lifecycle.default_schema(spark)[0].isdigit()


def test_a_write_that_fails_leaves_the_old_table(spark, mart):
    schema = "swap_test"
    lifecycle.ensure_schema(spark, schema)
    assert lifecycle.materialize(mart.vehicles, schema, "vehicles")
    before = sorted(map(str, read_table(spark, schema, "vehicles").collect()))
    half = mart.vehicles.withColumn("vehicle_type", F.when(F.col("vehicle_no") < 5, F.col("vehicle_type")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        lifecycle.materialize(half, schema, "vehicles", overwrite=True)
    assert sorted(map(str, read_table(spark, schema, "vehicles").collect())) == before
    assert len(lifecycle.versions(spark, schema, "vehicles")) == 1
    # a version that does not hold what was written is not put in use
    version = lifecycle.write_version(mart.vehicles, schema, "vehicles")
    with pytest.raises(RuntimeError):
        lifecycle.check_version(read_table(spark, schema, version), "vehicles", mart.vehicles.count() + 1)
    # a table replaced by what is read from it
    assert lifecycle.materialize(read_table(spark, schema, "vehicles").limit(3), schema, "vehicles", overwrite=True)
    assert read_table(spark, schema, "vehicles").count() == 3
    lifecycle.drop(spark, schema)


def test_a_build_that_fails_leaves_the_old_tables(spark, mart, monkeypatch):
    schema = "failing_test"
    lifecycle.build(spark, DATA, schema)
    before = {t: lifecycle.current_version(spark, schema, t) for t in lifecycle.BUILD_ORDER}
    monkeypatch.setitem(states.STATES, "order_states", lambda m: m.orders.select(F.raise_error(F.lit("stopped")).alias("x")))
    with pytest.raises(Exception, match="stopped"):
        lifecycle.build(spark, DATA, schema, overwrite=True)
    monkeypatch.undo()
    assert {t: lifecycle.current_version(spark, schema, t) for t in lifecycle.BUILD_ORDER} == before
    assert counts(lifecycle.open_mart(spark, schema, mart.depots)) == counts(mart)
    lifecycle.drop(spark, schema)


@pytest.fixture
def sources(spark, tmp_path):
    """A copy of the sources that a test may change; write(table, change) puts the changed rows in place."""
    folder = str(tmp_path)
    rows = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in SOURCE_TABLES}

    def write(table, change=lambda df: df):
        rows[table] = spark.createDataFrame(change(rows[table]).collect(), rows[table].schema)
        rows[table].write.mode("overwrite").parquet(f"{folder}/{table}.parquet")

    for t in SOURCE_TABLES:
        write(t)
    return folder, write


def equal_to_a_full_build(spark, folder, schema):
    fresh = SourceMart(spark, folder)
    stored = lifecycle.open_mart(spark, schema, fresh.depots)
    for name in ("vehicles", "orders", "routes", "stops"):
        mine, theirs = getattr(stored, name), getattr(fresh, name)
        assert mine.count() == theirs.count() and mine.exceptAll(theirs).isEmpty(), name
    for name in states.STATES:
        mine, theirs = stored.state(name), fresh.state(name)
        columns = [c for c in theirs.columns]
        assert mine.count() == theirs.count() and mine.select(columns).exceptAll(theirs).isEmpty(), name


def files_of(spark, schema, table, month):
    version = lifecycle.current_version(spark, schema, table)
    return {f for f in spark.table(f"{schema}.{version}").inputFiles() if f"month={month}" not in f}


def test_only_changed_months_are_replaced(spark, sources):
    folder, write = sources
    schema, month = "renewed_test", "1997-03"
    lifecycle.build(spark, folder, schema)
    inside = F.date_format("l_shipdate", "yyyy-MM") == month
    kept = {t: files_of(spark, schema, t, month) for t in ("route_plans", "route_stops")}

    # other outcomes in one month: its routes and stops, nothing else
    write("lineitem", lambda df: df.withColumn("l_returnflag", F.when(inside, "R").otherwise(F.col("l_returnflag"))))
    report = lifecycle.build(spark, folder, schema)
    assert report["built"] == ["route_plans", "route_stops"]
    assert report["months"] == {"route_plans": [month], "route_stops": [month]}
    assert {t: files_of(spark, schema, t, month) for t in kept} == kept
    equal_to_a_full_build(spark, folder, schema)
    # files written again with the same rows change nothing
    write("lineitem", lambda df: df.orderBy("l_partkey"))
    assert lifecycle.build(spark, folder, schema)["built"] == []

    # a month without lines any more, which orders weigh less for
    write("lineitem", lambda df: df.where(~inside))
    report = lifecycle.build(spark, folder, schema)
    assert report["months"]["route_stops"] == [month] and report["built"][0] == "delivery_orders"
    equal_to_a_full_build(spark, folder, schema)

    # another customer for an order: its month of orders, and the months of its lines
    write("orders", lambda df: df.withColumn("o_custkey", F.when(F.col("o_orderkey") == 40, 1).otherwise(F.col("o_custkey"))))
    report = lifecycle.build(spark, folder, schema)
    assert report["built"] == ["delivery_orders", "route_plans", "route_stops"]
    assert 0 < len(report["months"]["delivery_orders"]) <= 4
    equal_to_a_full_build(spark, folder, schema)

    # a vehicle less reaches everything
    write("supplier", lambda df: df.where("s_suppkey > 0"))
    assert lifecycle.build(spark, folder, schema)["built"] == lifecycle.BUILD_ORDER
    lifecycle.drop(spark, schema)


def test_months_that_a_date_can_reach():
    assert lifecycle.later_months("1997-01", 30) == {"1997-01", "1997-02", "1997-03", "1997-04"}
    assert lifecycle.later_months("1997-12", 5) == {"1997-12", "1998-01", "1998-02"}
