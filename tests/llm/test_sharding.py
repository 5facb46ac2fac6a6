import itertools
import zlib

from pyspark.sql import functions as F

from drayage.llm import sharding
from tests.conftest import DATA


def greedy_shards(sizes, capacity):
    count, filled = 1, 0
    for n in sizes:
        if filled and filled + n > capacity:
            count, filled = count + 1, 0
        filled += n
    return count


def test_capacity_is_the_smallest_feasible(spark):
    for sizes, shards in (([5, 1, 1, 1, 5, 2, 9, 1], 3), ([7] * 10, 4), ([100, 1, 1, 1, 1], 3), ([4], 16), ([1, 2, 3], 1)):
        got = spark.createDataFrame([(sizes,)], "s array<bigint>").select(sharding.capacity_of(F.col("s"), shards)).first()[0]
        want = next(c for c in itertools.count(1) if greedy_shards(sizes, c) <= shards)
        assert got == want, (sizes, shards)


def check(rows, docs):
    texts = {}
    for r in docs:
        texts.setdefault(r.doc_id, []).append((r.text or "").encode())
    assert sorted((r.id is None, r.id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (i is None, i or 0, len(t) + 1, zlib.crc32(t)) for i, own in texts.items() for t in own
    )
    for shard in {r.shard for r in rows}:
        own = sorted(r.slot for r in rows if r.shard == shard)
        assert own == list(range(len(own)))
    groups = {}
    for r in rows:
        groups.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values())


def test_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sharding.shard(docs).collect()
    check(rows, docs.collect())
    held = {}
    for r in rows:
        held[r.shard] = held.get(r.shard, 0) + r.size
    largest = max(r.size for r in rows)
    assert set(held) <= set(range(16))
    assert max(held.values()) <= sum(held.values()) / 16 + 2 * largest


def test_odd_rows(odd_documents, no_documents):
    check(sharding.shard(odd_documents, 4).collect(), odd_documents.collect())
    assert sharding.shard(no_documents).isEmpty()


def test_no_python_in_the_plan(odd_documents, capsys):
    sharding.shard(odd_documents).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
