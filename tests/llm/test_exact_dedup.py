import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from drayage.llm import exact_dedup
from drayage.llm.exact_dedup import PatriciaTrie, common_length
from tests.llm import brute


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(brute.lower(r.text), []).append(r.doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        ordered = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        out += [(i, keep, len(ids), n == 0, sha) for n, i in enumerate(ordered)]
    return Counter(out)


def test_trie_keeps_every_key_apart():
    draw = random.Random(1)
    keys = [bytes(draw.choice(b"ab") for _ in range(12)) for _ in range(400)]
    trie = PatriciaTrie()
    for k in keys:
        node = trie.terminal(k)
        node.value = (node.value or 0) + 1
    assert dict(trie.terminals()) == Counter(keys)
    assert common_length(b"abcd", b"abxd") == 2 and common_length(b"", b"a") == 0


def test_assignments_match_brute_force(odd_documents):
    got = exact_dedup.assignments(odd_documents)
    found = Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect())
    assert found == expected(odd_documents.collect())


def test_small_budgets_change_nothing(odd_documents, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ENTRY_IDS", 3)
    got = exact_dedup.assignments(odd_documents.repartition(5))
    found = Counter((r.id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect())
    assert found == expected(odd_documents.collect())


def test_survivors_are_whole_rows_with_any_columns(odd_documents):
    clashing = odd_documents.withColumnsRenamed({"lang": "row", "source": "hash", "n_chars": "entry"}).withColumn("ids", F.array(F.lit(1)))
    got = exact_dedup.survivors(clashing)
    assert got.columns == clashing.columns
    rows = got.collect()
    kept = Counter(k[0] for k in expected(odd_documents.collect()) if k[3])
    assert Counter(r.doc_id for r in rows) == kept
    assert {r.doc_id: r.text for r in rows if r.doc_id}[3] == odd_documents.filter("doc_id = 3").first().text


def test_smallest_may_win(odd_documents):
    got = {r.id: r.keep_id for r in exact_dedup.assignments(odd_documents, largest=False).collect()}
    assert got[16] == 15 and got[8] == 7 and got[139] == 100


def test_empty_table(no_documents):
    assert exact_dedup.assignments(no_documents).isEmpty()
    assert exact_dedup.survivors(no_documents).isEmpty()
