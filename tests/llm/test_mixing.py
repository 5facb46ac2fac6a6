import hashlib
import math

import duckdb
from pyspark.sql import functions as F

from drayage.llm import mixing, queries, queries_sql
from tests.conftest import DATA
from tests.llm.brute import WORD
from tests.parity import differences


def fair_targets(sizes, weights=(3, 1, 2), percent=150, repeats=2):
    """Targets by sharing again and again what full sources leave."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, budget = {s: 0.0 for s in order if not sizes[s]}, sum(sizes.values()) * percent / 100
    while True:
        rest = [s for s in order if s not in full]
        level = (budget - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        above = [s for s in rest if weight[s] * level >= repeats * sizes[s]]
        if not above:
            return order, full | {s: weight[s] * level for s in rest}
        full |= {s: float(repeats * sizes[s]) for s in above}


def brute(rows, weights=(3, 1, 2), percent=150, repeats=2):
    """Sorted (id, size, source_size, target, taken), by serving the queues one after the other."""
    sizes, copies, docs = {}, {}, []
    for doc, text, source in rows:
        size = len(WORD.findall(text or ""))
        sizes[source] = sizes.get(source, 0) + size
        key = (source, doc, size)
        copies[key] = copies.get(key, 0) + 1
        draw = hashlib.md5(f"{'' if doc is None else doc}|{copies[key]}|mix".encode()).hexdigest()
        docs.append((source, int(draw[:15], 16), doc is not None, doc or 0, size, copies[key]))
    order, targets = fair_targets(sizes, weights, percent, repeats)
    served, budget = [], sum(sizes.values()) * percent // 100
    for rank, source in enumerate(order):
        queue, through = sorted(d[1:] for d in docs if d[0] == source), 0
        for turn in range(repeats):
            for place, known, doc, size, copy in queue:
                words = max(0, min(size, math.ceil(targets[source]) - through))
                through += size
                if words:
                    finish = (through - size + words) / targets[source]
                    served.append((finish, rank, place, known, doc, size, copy, turn, words))
    taken, held = {}, 0
    for _, rank, _, known, doc, size, copy, _, words in sorted(served):
        key = (order[rank], doc if known else None, size, copy)
        taken[key] = taken.get(key, 0) + max(0, min(words, budget - held))
        held += words
    return sorted(
        ((doc if known else None, size, sizes[s], targets[s], taken.get((s, doc if known else None, size, copy), 0))
         for s, _, known, doc, size, copy in docs),
        key=repr,
    )


def got(services):
    return sorted((tuple(r) for r in mixing.taken(services).collect()), key=repr)


def rows_of(docs):
    return [(r.doc_id, r.text, r.source) for r in docs.collect()]


def test_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    services = mixing.queue(docs)
    assert got(services) == brute(rows_of(docs))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    assert not differences(queries.op13_mixing(spark, DATA), con, queries_sql.OP13)
    # every source comes within a few words of its target, and no row exceeds twice its size
    by_rank = {}
    for r in services.collect():
        target, held = by_rank.get(r.rank, (r.target, 0))
        by_rank[r.rank] = (target, held + r.words)
        assert 0 <= r.words <= r.size
    assert all(abs(held - target) <= len(by_rank) for target, held in by_rank.values())


def test_the_mix_is_gapless_and_even_on_the_way(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    services = mixing.queue(docs)
    mixed = mixing.in_order(services).collect()
    held, finish, by_source, longest = 0, 0.0, {}, max(r.size for r in mixed)
    budget = sum(r.words for r in mixed)
    for r in mixed:
        assert r.position == held and r.finish >= finish
        held, finish = held + r.words, r.finish
        by_source[r.rank] = by_source.get(r.rank, 0) + r.words
        if held > budget // 2 and "half" not in by_source:
            by_source["half"] = {k: v for k, v in by_source.items() if k != "half"}
    targets = {r.rank: r.target for r in mixed}
    at = by_source.pop("half")
    for rank, target in targets.items():
        assert abs(at.get(rank, 0) - target / 2) <= 2 * longest


def test_odd_rows(spark, odd_documents, no_documents):
    hot = spark.createDataFrame([(7, "a b c", None, None, None)] * 3000 + [(None, None, None, "t", None)] * 500, odd_documents.schema)
    docs = odd_documents.unionByName(hot)
    assert got(mixing.queue(docs)) == brute(rows_of(docs))
    assert got(mixing.queue(docs, weights=(5, 1), percent=40, repeats=3)) == brute(rows_of(docs), (5, 1), 40, 3)
    assert mixing.taken(mixing.queue(no_documents)).isEmpty()
    empty = spark.createDataFrame([(1, "", None, "a", 0), (2, None, None, None, 0)], odd_documents.schema)
    assert got(mixing.queue(empty)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    one = odd_documents.where("doc_id = 11").limit(1)
    assert got(mixing.queue(one)) == brute(rows_of(one))


def test_more_than_all_is_twice_all(spark, odd_documents):
    rows = got(mixing.queue(odd_documents, percent=1000))
    assert all(taken == 2 * size and target == 2 * total for _, size, total, target, taken in rows)


def test_clashing_names_and_reruns(spark, odd_documents):
    clashing = odd_documents.selectExpr(
        "*", "doc_id AS id", "text AS words", "lang AS copy", "n_chars AS size", "doc_id AS rank", "doc_id AS place", "text AS cell"
    )
    assert got(mixing.queue(clashing.repartition(5))) == got(mixing.queue(odd_documents))


def test_sources_by_code_point(spark):
    sources = ["b", "a", "é", "Z", "\U0001f600", "￮", None]
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate(sources)], "doc_id long, text string, source string")
    ranks = {r.id: r["rank"] for r in mixing.queue(docs).collect()}
    assert [sources[i] for i in sorted(ranks, key=ranks.get)] == ["Z", "a", "b", "é", "￮", "\U0001f600", None]


def test_no_python_in_the_plan(odd_documents, capsys):
    mixing.taken(mixing.queue(odd_documents)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan


def test_words_are_runs_between_white_space(spark):
    texts = ["", " ", "a", "  a\t\x0bb\x0c\r\nc ", "x\x1cy z\x85w", "日本 語", None]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    sizes = {r.id: r.size for r in mixing.measured(docs).select(F.col("id"), "size").collect()}
    assert sizes == {i: len(WORD.findall(t or "")) for i, t in enumerate(texts)}
