import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from drayage.llm import lexical
from tests.conftest import DATA
from tests.llm.brute import lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def brute(items, docs, k=10):
    """Sorted (item_id, rank, doc_id, score), by scoring every document for every item."""
    bags = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    full = [b for _, b in bags if b]
    count, total = len(full), sum(sum(b.values()) for b in full)
    df = Counter(t for b in full for t in b)
    found = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            n, score = sum(bag.values()), 0
            for term in TERM.findall(lower(text)):
                if bag[term]:
                    m = 100 - 75 + (75 * n * count) // total
                    weight = math.floor(1000 * math.log((2 * count + 2) / (2 * df[term] + 1)))
                    score += weight * ((1000000000 * bag[term]) // (1000 * bag[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scores)[:k], 1):
            found.append((item, rank, None if null else doc, -score))
    return sorted(found, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "id", "score").collect()), key=repr)


@pytest.fixture(scope="module")
def odd_items(spark):
    rows = [
        (1, "the quick2 BROWN5 fox"), (2, None), (3, ""), (4, "!!! --"), (5, "naïve 日本語 É é"), (6, "unheard of words"),
        (7, "seven3 seven3 seven3 wizards0"), (7, "seven3 seven3 seven3 wizards0"), (None, "one two x"),
        (8, " ".join(f"lazy{i} dog{i}" for i in range(11)) * 30),
    ]
    return spark.createDataFrame(rows, ITEMS)


def test_terms_are_those_of_the_pattern():
    texts = ["a_b c3 É日x\x00y\x7fz\x85w", "", "ÀA-Z don't 12345", "İstanbul ſ K"]
    for text in texts:
        assert [t.decode() for t in lexical.terms(text.encode())] == TERM.findall(lower(text))


def test_the_documents(spark):
    items, docs = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("benchmark", "documents"))
    want = brute([(r.item_id, r.text) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    assert got(lexical.search(items, docs)) == want


def test_odd_rows(spark, odd_items, odd_documents, monkeypatch):
    want = brute([tuple(r) for r in odd_items.collect()], [(r.doc_id, r.text) for r in odd_documents.collect()])
    assert got(lexical.search(odd_items, odd_documents)) == want
    # several groups, several trees in each, batches cut in halves
    monkeypatch.setattr(lexical, "GROUP_ITEMS", 3)
    monkeypatch.setattr(lexical, "TREE_ITEMS", 2)
    assert got(lexical.search(odd_items, odd_documents)) == want
    assert got(lexical.search(odd_items, odd_documents, k=1)) == [r for r in want if r[1] == 1]


def test_empty_and_clashing(spark, odd_items, odd_documents, no_documents):
    assert lexical.search(odd_items, no_documents).isEmpty()
    none = spark.createDataFrame([], ITEMS)
    empty = lexical.search(none, odd_documents)
    assert empty.isEmpty() and empty.columns == ["item_id", "rank", "id", "score"]
    extra = {"id": "doc_id", "n": "doc_id", "terms": "text", "score": "text", "item": "doc_id", "rank": "lang"}
    clashing = odd_documents.selectExpr("*", *[f"{v} AS {k}" for k, v in extra.items()])
    items = odd_items.selectExpr("*", "text AS terms", "item_id AS id", "text AS counts")
    assert got(lexical.search(items, clashing)) == got(lexical.search(odd_items, odd_documents))


def test_search_prunes_and_loses_nothing(monkeypatch):
    draw = np.random.default_rng(3)
    size = 300
    # six languages: documents and items of one share nothing with the others
    docs, items = (np.zeros((n, size), np.int64) for n in (400, 60))
    for matrix in (docs, items):
        for i in range(len(matrix)):
            matrix[i, (i % 6) * 50 + draw.choice(50, 12, replace=False)] = 1 + draw.integers(0, 3, 12)
    values = docs * draw.integers(1, 1000, size)
    columns, weights = np.arange(size), np.ones(size, np.int64)
    vocabulary = {str(i).encode(): i for i in range(size)}
    bags = [(i, [str(j).encode() for j in np.nonzero(row)[0]], row[row > 0].tolist()) for i, row in enumerate(items)]
    scores = values @ items.T
    for dense in (lexical.EXACT, 0):  # in doubles and in whole numbers
        monkeypatch.setattr(lexical, "EXACT", dense)
        tree = lexical.Items.of(bags, vocabulary, weights)
        best = lexical.Best(5, np.zeros(60, np.int64), [[] for _ in range(60)])
        below = lexical.grow(values.astype(float), lexical.DOC_LEAF)
        compared = lexical.search_matrix(values, below, list(range(400)), columns, size, tree, best)
        leaves = sum(c is None for c in tree.tree.children) * sum(c is None for c in below.children)
        assert compared < leaves / 3
        for i in range(60):
            best.trim(i)
            want = sorted((-int(scores[d, i]), False, d) for d in range(400) if scores[d, i] > 0)[:5]
            assert best.lists[i] == want


def test_node_bounds_hold():
    draw = np.random.default_rng(5)
    matrix = draw.integers(0, 50, (100, 30)) * (draw.random((100, 30)) < 0.3)
    tree = lexical.grow(matrix.astype(float), 8)
    top = tree.maxima(matrix)
    for node, rows in enumerate(tree.rows):
        assert (matrix[rows] <= top[node]).all()
        pair = tree.children[node]
        if pair:
            assert sorted([*tree.rows[pair[0]], *tree.rows[pair[1]]]) == sorted(rows)
        else:
            assert len(rows) <= 8


def test_large_batches_are_halved(monkeypatch):
    import pyarrow as pa

    draw = np.random.default_rng(7)
    rows = [sorted(draw.choice(40, 6, replace=False).tolist()) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(50)), pa.array([6] * 50), pa.array(rows, pa.list_(pa.int32())),
         pa.array([[1 + i % 3] * 6 for i in range(50)], pa.list_(pa.int64()))],
        names=["id", "n", "terms", "counts"],
    )
    corpus = lexical.Corpus(50, 300, np.arange(1, 41))
    vocabulary = {str(i).encode(): i for i in range(40)}
    tree = lexical.Items.of([(1, [b"3", b"7", b"30"], [1, 2, 1]), (2, [b"39"], [1])], vocabulary, corpus.weights)

    def best():
        out = lexical.Best(3, np.zeros(2, np.int64), [[], []])
        lexical.search_batch(batch, corpus, [tree], [out])
        for i in range(2):
            out.trim(i)
        return out.lists

    whole = best()
    monkeypatch.setattr(lexical, "MATRIX_CELLS", 100)
    assert best() == whole and all(whole)
