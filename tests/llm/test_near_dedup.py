import numpy as np

from drayage.llm import near_dedup
from drayage.llm.common import stage
from drayage.llm.components import components
from drayage.llm.shingles import overlap, shingle_sets
from tests.conftest import DATA
from tests.llm import brute


def test_shingle_sets_have_the_sizes_and_overlaps_of_word_sets():
    texts = ["", " ", "one", "a b c d", "A b C d", "a b c d e f g h", "x a\tb\nc d e f g h", "é x b c d e\x0bf", "the " * 50]
    sets = shingle_sets([t.encode() for t in texts])
    plain = [brute.shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(p) for p in plain]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert overlap(sets[i], sets[j]) == len(plain[i] & plain[j])


def test_long_texts_are_hashed_in_pieces_alike():
    words = [f"w{i % 9973}" for i in range(400_000)]
    long = " ".join(words).encode()
    assert len(long) > 2_000_000
    assert len(shingle_sets([long])[0]) == len(brute.shingles(long.decode()))


def test_odd_sketch_estimates_high_similarity():
    draw = np.random.default_rng(3)
    base = draw.integers(0, 2**64, 1000, dtype=np.uint64)
    for changed in (20, 60, 120):
        other = np.concatenate([base[changed:], draw.integers(0, 2**64, changed, dtype=np.uint64)])
        a, b = (near_dedup.odd_sketch(np.unique(x)).view(np.uint64) for x in (base, other))
        flipped = int(np.bitwise_count(a ^ b).sum())
        estimate = 1 + near_dedup.SKETCH_BITS / (4 * near_dedup.SAMPLES) * np.log(1 - 2 * flipped / near_dedup.SKETCH_BITS)
        true = (1000 - changed) / (1000 + changed)
        assert abs(estimate - true) < 0.06
        assert flipped <= near_dedup.most_flipped()


def test_components_match_brute_force_on_the_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute.near_components([(r.doc_id, r.text) for r in docs.collect()])
    got = near_dedup.assignments(docs).collect()
    assert {r.id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.id == r.component_id) for r in got)


def test_odd_documents(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    want = brute.near_components([r for r in rows if r[0] is not None])
    got = near_dedup.assignments(odd_documents).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.n_shingles, r.component_id) for r in got if r.id is not None} == want
    assert all(r.kept and r.component_id is None for r in got if r.id is None)
    kept = [r.doc_id for r in near_dedup.survivors(odd_documents).collect()]
    assert set(kept) == {None} | {i for i, (_, c) in want.items() if i == c}


def test_bridges_between_stars_are_found(spark):
    """a and c are not similar, b is similar to both; and chains in any order of ids."""
    words = [f"w{i}" for i in range(120)]
    steps = [" ".join([*words[9 * k : 9 * k + 100], "end"]) for k in range(3)]
    for order in ((1, 2, 3), (1, 3, 2), (3, 1, 2), (2, 3, 1)):
        rows = list(zip(order, steps))
        got = {r.id: r.component_id for r in near_dedup.assignments(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: c for i, (_, c) in brute.near_components(rows).items()}


def test_blocks_split_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "MEMBERS", 2)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute.near_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.id: (r.n_shingles, r.component_id) for r in near_dedup.assignments(docs).collect()} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (60, 100), (70, 60), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert got == {i: 1 for i in range(1, 41)} | {50: 50, 60: 50, 70: 50, 100: 50}


def test_edges_that_form_stars_need_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr("drayage.llm.components.stage", lambda df, name: written.append(name) or stage(df, name))
    forest = [(1, i) for i in range(2, 50)] + [(i, 60) for i in range(61, 70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(forest, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 50)} | {i: 60 for i in range(60, 70)}
    assert len(written) == 1
    for more in ((49, 69), (69, 60)):  # two stars joined by their ends, and an end that is known already
        got = {r.node: r.component for r in components(spark.createDataFrame([*forest, more], "a long, b long")).collect()}
        assert got == {i: 1 if more[0] == 49 or i < 50 else 60 for i in [*range(1, 50), *range(60, 70)]}


def test_later_rounds_read_only_buckets_of_several_components(spark):
    buckets = spark.createDataFrame([(1, 2, 10), (1, 2, 11), (2, 2, 11), (2, 2, 12)], "bucket long, size long, node long")
    mixed = near_dedup._mixed(buckets, spark.createDataFrame([(11, 10)], "high long, low long"))
    assert {(r.bucket, r["size"], r.node, r.component) for r in mixed.collect()} == {(2, 2, 11, 10), (2, 2, 12, 12)}


def test_empty_table(no_documents):
    assert near_dedup.assignments(no_documents).isEmpty()
    assert near_dedup.survivors(no_documents).isEmpty()
