import hashlib

import numpy as np

from drayage.llm import fingerprints, queries
from tests.conftest import DATA


def entropy_level(window):
    counts = np.bincount([b & 63 for b in window])
    counts = counts[counts > 0]
    entropy = np.log2(len(window)) - sum(c * np.log2(c) for c in counts) / len(window)
    return min(255, max(0, entropy * 255 / 6))


def test_levels_match_plain_counts():
    text = "The quick brown fox, jumps over   the lazy dog; ".encode() * 5 + "é日本 x".encode()
    (level, hashed), (other, _) = fingerprints.windows([text, b"tiny"])
    starts = [i for i in range(len(text)) if text[i : i + 1].strip() and (i == 0 or not text[i - 1 : i].strip())]
    starts = [i for i in starts if len(text) - i >= 16 or i == 0]
    plain = [entropy_level(text[i : i + 64]) for i in starts]
    assert len(level) == len(plain) and np.abs(level - plain).max() <= 1
    assert len(other) == 1
    assert len(set(hashed.tolist())) == len({text[i : i + 64] for i in starts})


def test_chunks_do_not_change_windows(monkeypatch):
    texts = [(f"word{i} " * (i % 50 + 1)).encode() for i in range(200)]
    together = fingerprints.windows(texts)
    monkeypatch.setattr(fingerprints, "SPAN", 500)
    for (a, b), text in zip(together, texts):
        ((c, d),) = fingerprints.windows([text])
        assert (a == c).all() and (b == d).all()


def test_every_byte_lies_in_a_window(monkeypatch):
    draw = np.random.default_rng(3)
    han = "".join(map(chr, draw.integers(0x4E00, 0x9000, 700))).encode()
    mixed = b"  " + b"ab " * 5 + b"q" * 24 + b" " * 24 + b"r" + b" " * 300 + b"w" * 25 + b" z"
    for text in (han, bytes(draw.integers(65, 91, 2000, dtype=np.uint8)), b"x" * 500, mixed):
        own = set(fingerprints.windows([text])[0][1].tolist())
        for i in range(0, len(text), 7):
            changed = text[:i] + bytes([text[i] ^ 1]) + text[i + 1 :]
            assert own != set(fingerprints.windows([changed])[0][1].tolist())
        # windows follow the content, not its place, and do not depend on how a text is cut
        (later,) = fingerprints.windows([b"moved " + text])
        assert len(own & set(later[1].tolist())) >= 0.9 * len(own) - 2
        monkeypatch.setattr(fingerprints, "SPAN", 100)
        assert set(fingerprints.windows([text])[0][1].tolist()) == own
        monkeypatch.undo()


def test_texts_without_white_space_differ_behind_a_common_beginning():
    draw = np.random.default_rng(4)
    one, two = ("".join(map(chr, draw.integers(0x4E00, 0x9000, 3000))) for _ in range(2))
    ranks = np.arange(fingerprints.LEVELS)
    f, g, h = fingerprints.chains([t.encode() for t in (one, one[:30] + two[30:], fingerprints.edited(one, two))], ranks)
    assert fingerprints.likeness(f, g) < 0.2 and 0.2 < fingerprints.likeness(f, h) < 0.7


def test_short_texts_show_what_they_share():
    draw = np.random.default_rng(5)
    words = ["".join(map(chr, draw.integers(97, 123, n))) for n in draw.integers(2, 9, 4000)]
    ranks = np.arange(fingerprints.LEVELS)
    for size in (40, 70, 100, 127, 140, 200, 300, 500, 530):
        near, far = [], []
        for _ in range(30):
            one, two = (" ".join(draw.choice(words, size))[:size] for _ in range(2))
            f, g, h = fingerprints.chains([t.encode() for t in (one, two, fingerprints.edited(one, two))], ranks)
            near.append(fingerprints.likeness(f, h))
            far.append(fingerprints.likeness(f, g))
        assert 0.15 < np.mean(near) < 0.7 and np.mean(far) < 0.05, (size, np.mean(near), np.mean(far))
        assert np.mean(np.array(near) > 0.1) > 0.8, (size, sorted(near))
    assert fingerprints.likeness(*fingerprints.chains([b"tiny", b"tiny"], ranks)) == 1
    # lengths on both sides of a bound still meet
    for a, b in ((60, 70), (100, 200), (200, 600), (490, 530)):
        one = " ".join(draw.choice(words, b))[:b]
        assert fingerprints.likeness(*fingerprints.chains([one[:a].encode(), one.encode()], ranks)) > 0.3, (a, b)


def test_likeness():
    draw = np.random.default_rng(1)
    a, b = (draw.integers(0, 2**64, 500, dtype=np.uint64) for _ in range(2))
    x, y = fingerprints.bloom_chain(a), fingerprints.bloom_chain(b)
    none = fingerprints.bloom_chain(a[:0])
    assert len(x) == 4 and fingerprints.likeness(x, x) == 1 and fingerprints.likeness(x, y) < 0.1
    half = fingerprints.bloom_chain(np.concatenate([a[:240], b[:240]]))
    assert 0.3 < fingerprints.likeness(x, half) < 0.7 and fingerprints.likeness(x, half) == fingerprints.likeness(half, x)
    assert fingerprints.likeness(none, none) == 1 and fingerprints.likeness(none, x) == 0
    assert (fingerprints.parsed(fingerprints.written(x)) == x).all()


def brute(rows, ranks):
    """Neighbours by one sort of everything."""
    out = []
    for n, (i, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        changed = fingerprints.edited(text, following)
        f, g, h = fingerprints.chains([t.encode() for t in (text, changed, following)], ranks)
        sha = hashlib.sha256(changed.encode()).hexdigest()
        out.append((i, len(text), sha, fingerprints.written(f), fingerprints.written(g), fingerprints.likeness(f, g), fingerprints.likeness(f, h)))
    return out


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ranks = fingerprints.level_ranks(docs)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    want = brute(rows, ranks)
    assert sorted(tuple(r) for r in queries.op9_fingerprints(spark, DATA).collect()) == sorted(want)
    split = fingerprints.neighbours(docs.repartition(7), ranks).collect()
    assert sorted(tuple(r) for r in split) == sorted(want)
    own = {r.id: r.fingerprint for r in fingerprints.fingerprints(docs, ranks).collect()}
    assert own == {w[0]: w[3] for w in want}
    assert fingerprints.edited("abcde", "xy") == "abcxy" and fingerprints.edited("abcde", "x") == "abcx"


def test_odd_rows(odd_documents, no_documents):
    ranks = fingerprints.level_ranks(odd_documents)
    rows = fingerprints.neighbours(odd_documents, ranks).collect()
    assert len(rows) == odd_documents.count()
    assert {r.fingerprint for r in rows if r.n_chars == 0} == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    one = fingerprints.neighbours(odd_documents.filter("doc_id = 3"), ranks).collect()
    assert len(one) == 1 and one[0].near_next == 1
    assert fingerprints.neighbours(no_documents, fingerprints.level_ranks(no_documents)).isEmpty()
