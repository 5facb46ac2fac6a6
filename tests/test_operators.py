"""Operators: properties, edge cases, and the path for keys that hold many rows."""

import datetime as dt
import pathlib
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from drayage import fixed_values as fv
from drayage.functions import calendar, costing, draws
from drayage.operators.joins import lookup_join
from drayage.operators.numbering import ascending, dense_id, descending, first_n, number_rows, previous_row, rank_zip_join
from drayage.operators.rows import date_spine, expand_rows, grid, sample_by_rate
from drayage.operators.skew import heavy_hitters, hot_keys, hot_keys_of
from drayage.sources.staging import shared_dir, stage
from drayage.sources.tables import read_source
from tests.conftest import DATA


@pytest.fixture
def low_limit(spark):
    """Let 50 rows of a key count as too many."""
    spark.conf.set("spark.drayage.hotRows", "50")
    yield 50
    spark.conf.unset("spark.drayage.hotRows")


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows, a third of them under one key; v is a permutation."""
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 97).cast("string"))).alias("k"),
        ((F.col("id") * 1009) % 3000).alias("v"),
    )
    return stage(df, "skewed")


def expected_numbers(df):
    per_key = {}
    for r in df.collect():
        per_key.setdefault(r.k, []).append(r.v)
    return {(k, v): i + 1 for k, vs in per_key.items() for i, v in enumerate(sorted(vs))}


def test_bucket_range_repeatability_and_null(spark):
    df = spark.range(2000).withColumn("b", draws.hash_bucket("id", "s", 10))
    counts = {r.b: r.n for r in df.groupBy("b").agg(F.count("*").alias("n")).collect()}
    assert set(counts) == set(range(10)) and all(140 < n < 260 for n in counts.values())
    assert df.where(draws.hash_bucket("id", "s", 10) != F.col("b")).isEmpty()
    assert spark.range(1).select(draws.hash_bucket([F.lit(None).cast("string")], "s", 7).alias("b")).first().b in range(7)


def test_sampling_keeps_each_share(spark):
    df = spark.range(20000).withColumn("rate", F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.7))
    kept = {r.rate: r.n for r in sample_by_rate(df, "id", F.col("rate")).groupBy("rate").agg(F.count("*").alias("n")).collect()}
    for rate, n in kept.items():
        assert abs(n - 10000 * rate) < 3 * (10000 * rate * (1 - rate)) ** 0.5
    assert sample_by_rate(df, "id", F.lit(0)).isEmpty() and sample_by_rate(df, "id", F.lit(1)).count() == 20000


@pytest.mark.parametrize("number,width,text", [(7, 3, "X-007"), (123456, 3, "X-123456"), (0, 1, "X-0")])
def test_ids_keep_every_digit(spark, number, width, text):
    assert spark.range(1).select(draws.format_id("X-", F.lit(number), width).alias("i")).first().i == text


def test_calendar_weight_and_week(spark):
    days = [(dt.date(2024, 12, 29),), (dt.date(2024, 12, 28),), (dt.date(2025, 3, 4),), (dt.date(2025, 1, 6),)]
    df = spark.createDataFrame(days, "d date").select(
        "d", calendar.calendar_weight(F.col("d"), F.lit("busy")).cast("double").alias("w")
    )
    weights = {r.d: r.w for r in df.collect()}
    assert weights[dt.date(2024, 12, 29)] == pytest.approx(1.6 * 0.10 * 1.5)  # Sunday
    assert weights[dt.date(2024, 12, 28)] == pytest.approx(1.6 * 0.35 * 1.5)  # Saturday
    assert weights[dt.date(2025, 3, 4)] == pytest.approx(1.5)
    assert weights[dt.date(2025, 1, 6)] == pytest.approx(0.7 * 1.15 * 1.5)  # Monday


def test_time_of_day(spark):
    texts = [r.t for r in spark.createDataFrame([(0,), (425,), (1439,)], "m int").select(calendar.time_of_day(F.col("m")).alias("t")).collect()]
    assert texts == ["00:00:00", "07:05:00", "23:59:00"]


def test_costing(spark):
    row = spark.range(1).select(
        costing.plan_cost(F.lit(D("100.00")), F.lit(10), F.lit(D("0.455")), F.lit(3)).alias("cost"),
        costing.plan_duration(F.lit(4), F.lit(D("5.5")), F.lit(10)).alias("minutes"),
        costing.minutes_into_route(F.lit(3), F.lit(D("100.0")), F.lit(4)).alias("third"),
        costing.minutes_into_route(F.lit(1), F.lit(D("100.0")), F.lit(0)).alias("no_stops"),
    ).first()
    assert row.cost == D("115.05") and row.minutes == D("34.0") and row.third == 75 and row.no_stops == 100


def test_arrivals_carry_the_hour(spark):
    offset = costing.minutes_into_route(F.lit(2), F.lit(D("110.0")), F.lit(2))
    line = costing.stop_timeline(F.col("day"), offset, F.lit(20), F.lit(5))
    row = spark.createDataFrame([(dt.date(2024, 2, 29),)], "day date").select(*[c.alias(n) for n, c in line.items()]).first()
    assert row.planned_arrival == dt.datetime(2024, 2, 29, 8, 50)
    assert row.actual_arrival == dt.datetime(2024, 2, 29, 9, 10)
    assert row.actual_departure == dt.datetime(2024, 2, 29, 9, 15)


def test_what_is_read_from_source_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    day = lambda text: F.lit(text).cast("date")
    assert one(costing.delay_minutes(day("2024-01-01"), day("2024-03-05"))) == 64 // fv.DAYS_PER_DELAY_MINUTE
    assert one(costing.delay_minutes(day("2024-03-05"), day("2024-01-01"))) == 0
    assert one(costing.delay_minutes(F.lit(None).cast("date"), day("2024-01-01"))) == 0
    assert one(costing.lookup((F.lit("R"), F.lit("O")), fv.OUTCOMES)) == "skipped"
    assert one(costing.lookup((F.lit("R"), F.lit(None)), fv.OUTCOMES)) is None and one(costing.lookup((F.lit("Z"), F.lit("O")), fv.OUTCOMES)) is None
    assert one(costing.freight(F.lit(1000.0), F.lit(0.1), F.lit(0.05))) == D("4.72500000")
    assert one(costing.service_minutes(F.lit(23.0))) == 7
    assert [one(costing.layout_method(F.lit(n))) for n in (5, 6, 10, 11)] == ["manual_dispatch", "greedy_nearest", "greedy_nearest", "or_tools_cvrp"]
    assert [one(costing.stop_target(F.lit(18), F.lit(x).cast("double"))) for x in (7.2, 30.0, None)] == [8, 18, 0]


def test_spine_grid_and_first(spark):
    bounds = spark.createDataFrame([(dt.date(2024, 2, 27), dt.date(2024, 3, 1)), (dt.date(2024, 3, 2), dt.date(2024, 3, 1))], "a date, b date")
    assert [r.day.day for r in date_spine(bounds, "a", "b").collect()] == [27, 28, 29, 1]
    cells = grid(spark.range(3), size=["s", "l"], color=["r", "g"])
    assert cells.distinct().count() == 12
    assert grid(spark.range(1), a=list(range(101)), b=list(range(100))).count() == 10_100
    assert [r.id for r in first_n(spark.range(50).orderBy(F.rand(3)), ["id"], 3).collect()] == [0, 1, 2]


def test_expand_rows_edges_and_large_count(spark):
    df = spark.createDataFrame([("a", 2), ("b", 0), ("c", None), ("d", -3), ("e", 30000)], "k string, n long")
    out = expand_rows(df, "n")
    got = {r.k: (r.n, r.lo, r.hi, r.u) for r in out.groupBy("k").agg(
        F.count("*").alias("n"), F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.countDistinct("sequence").alias("u")).collect()}
    assert got == {"a": (2, 1, 2, 2), "e": (30000, 1, 30000, 30000)}


def test_numbers_with_and_without_hot_keys(spark, skewed, low_limit):
    want = expected_numbers(skewed)
    assert hot_keys(skewed, ["k"]).table.count() == 1
    for frame in (number_rows(skewed, ["v"], ["k"], "n"), number_rows(skewed, ["v"], ["k"], "n", hot=None)):
        assert {(r.k, r.v): r.n for r in frame.collect()} == want


def test_numbers_follow_descending_order_and_missing_keys(spark, low_limit):
    df = spark.range(200).select(F.when(F.col("id") % 2 == 0, "a").alias("k"), F.col("id").alias("v"))
    got = {(r.k, r.v): r.n for r in number_rows(df, [descending("v")], ["k"], "n").collect()}
    assert got["a", 198] == 1 and got["a", 0] == 100 and got[None, 199] == 1 and got[None, 1] == 100 and len(got) == 200


def test_dense_id_is_gap_free_and_ordered(spark, skewed):
    ids = dense_id(skewed, ["k", "v"], "N", 5).orderBy("k", "v").collect()
    assert [r.dense_id for r in ids] == [f"N{i + 1:05d}" for i in range(3000)]
    assert dense_id(skewed.limit(0), ["v"]).count() == 0


def test_previous_row_in_pieces_equals_one_window(spark, skewed, low_limit):
    cut = previous_row(skewed, ["k"], ["v"], ["v"], piece=7)
    whole = previous_row(skewed, ["k"], ["v"], ["v"], hot=None)
    assert sorted(map(tuple, cut.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_rank_zip_never_uses_a_row_twice(spark, skewed, low_limit):
    right = spark.range(900).select(F.when(F.col("id") < 700, "hot").otherwise("k5").alias("k"), F.col("id").alias("o"))
    pairs = rank_zip_join(skewed, right, ["k"], ["v"], ["o"])
    assert pairs.count() == 3000
    matched = pairs.where("o is not null")
    assert matched.count() == matched.select("o").distinct().count()
    assert matched.where("k = 'hot'").count() == 700  # more stops than orders
    small = min(skewed.where("k = 'k5'").count(), 200)
    assert matched.where("k = 'k5'").count() == small  # more orders than stops


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_plain_join(spark, skewed, low_limit, how):
    lookup = spark.createDataFrame([("hot", 1), ("k5", 2), ("k7", 3), ("none", 4)], "k string, x int")
    salted = lookup_join(skewed, lookup, "k", how)
    assert salted.columns == ["k", "v", "x"]
    plain = skewed.join(lookup, "k", how)
    assert sorted(map(tuple, salted.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_hot_rows_spread_over_tasks(spark, skewed, low_limit):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lookup = spark.createDataFrame([("hot", 1)], "k string, x int")
        tasks = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
        hot_only = skewed.where("k = 'hot'")
        assert tasks(hot_only.join(lookup, "k")) == [1000]
        assert max(tasks(lookup_join(hot_only, lookup, "k"))) < 400
        # global numbering: no task gets the whole table
        assert max(tasks(dense_id(skewed, ["v"]))) < 1500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_sampled_hot_keys_find_the_large_one(spark):
    df = spark.range(200000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    found = hot_keys(df, ["k"], limit=20000).table.collect()
    assert [r.k for r in found] == [0] and abs(found[0].hot_count - 66667) < 5000
    assert hot_keys(df.where("k > 0"), ["k"], limit=20000) is None


def test_staged_rows_go_to_the_configured_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    staged = stage(spark.range(5))
    assert staged.count() == 5 and shared_dir(spark) in staged.inputFiles()[0]


def test_pushdown_of_a_source_filter(spark):
    df = read_source(spark, DATA, "orders").where("o_orderkey = 5").select("o_custkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,5)" in plan and "o_totalprice" not in plan


@pytest.mark.parametrize("order", [ascending("v"), ascending("v", last=True), descending("v"), descending("v", last=False)])
def test_numbers_with_missing_values_in_the_order(spark, order, monkeypatch):
    from drayage.operators import numbering

    monkeypatch.setattr(numbering, "SAMPLE", 3)
    df = spark.range(500).select(F.when(F.col("id") % 9 != 0, (F.col("id") * 37) % 250).alias("v"), "id")
    got = number_rows(df, [order, "id"], name="n").collect()
    known = sorted((r for r in got if r.v is not None), key=lambda r: (-r.v if order.descending else r.v, r.id))
    missing = sorted((r for r in got if r.v is None), key=lambda r: r.id)
    want = known + missing if order.last else missing + known
    assert [r.n for r in want] == list(range(1, 501))


def test_numbering_stages_no_rows(spark):
    """What is written to number rows does not grow with their width."""

    def written():
        return sum(p.stat().st_size for p in pathlib.Path(shared_dir(spark)).rglob("*.parquet"))

    def staged_bytes(width):
        before = written()
        df = spark.range(3000).select("id", F.repeat(F.md5(F.col("id").cast("string")), width).alias("text"))
        assert dense_id(df, ["id"]).count() == 3000
        return written() - before

    narrow, wide = staged_bytes(1), staged_bytes(100)
    assert 0 < wide < narrow * 1.2 < 60_000


def test_heavy_hitters_are_all_found_and_counted(spark):
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 10 == 1, 8).when(F.col("id") % 10 == 2, None).otherwise(F.col("id")).alias("a"),
        (F.col("id") % 100).alias("b"),
    )
    want = {(r.a, r["count"]) for r in df.groupBy("a").count().where("count > 1000").collect()}
    found = heavy_hitters(df, ["a", "b"], limit=1000)
    assert set(found["a"]) == want and {k for k, _ in want} == {7, 8, None} and found["b"] == []
    assert heavy_hitters(df, ["a"], limit=100_000) == {"a": []}
    assert hot_keys_of(spark, "a", []) is None
    hot = hot_keys_of(spark, "a", found["a"])
    assert df.join(hot.renamed(), hot.matches(df), "left_semi").count() == sum(n for _, n in want)
