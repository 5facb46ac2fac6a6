"""Compare every report with its SQL on the same files, value by value.

python tests/parity.py DIR [name ...]
"""

import os
import sys
import tempfile
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem documents pages benchmark labels conversations".split()


def duck(directory):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{directory}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def differences(df, con, sql):
    """Empty when column names, types and all values agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    found = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    for name, kind in df.dtypes:
        if KINDS.get(kind, kind) != types[name]:
            found.append(f"type of {name}: {kind} != {types[name]}")
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs = rows_of(names, result.fetchall())
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows != {len(theirs)}")
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        found.append(f"{len(bad)} rows differ, first {bad[0]}")
    if not mine:
        found.append("no rows")
    return found


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    directory, only = sys.argv[1], sys.argv[2:]
    scratch = tempfile.mkdtemp(prefix="run-")
    builder = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", scratch)
    )
    if os.environ.get("HOT_ROWS"):
        builder = builder.config("spark.drayage.hotRows", os.environ["HOT_ROWS"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = duck(directory), e.oracle_sql()
    failed = 0
    for name, query in e.queries().items():
        if (only and name not in only) or name not in sqls:
            continue
        start = time.time()
        try:
            found = differences(query(spark, directory), con, sqls[name])
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(found)
        print(f"{'ok ' if not found else 'BAD'} {name} {time.time() - start:.2f}s", *found, flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
