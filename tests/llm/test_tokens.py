import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from drayage.llm import bpe, packing, queries
from tests.conftest import DATA

PATHS = [public_tokenizers.path(n) for n in (queries.BYTE_BPE, queries.WORD_BPE)]
ODD = [
    "", " ", "\n\n", "a\n\nb", "x  y   z ", "don't we'll I'M '' 's", "<|endoftext|>", "a <|endoftext|> b\n<|startoftext|>", "日本語　です",
    "naïve\u00a0 x", "😀 ΑΣΣ ὈΔΥΣΣΕΎΣ", "a" * 5000, "\t\tfoo\r\nbar", "!'s ?'s \x1c\x1d a\x0bb", "é café İstanbul ﬁ", "1234567 ½ ²", "_ __",
    "x" * 70 + "é" * 80, "\ufeffBOM", "a \u0000 b", "foo  ", "!!! ...\n\n  x", "&amp;'re 'll", "ſ ŉ Ÿ µ ß",
]


@pytest.fixture(scope="module", params=PATHS)
def vocab(request):
    return bpe.Vocabulary(bpe.vocabulary_text(request.param))


def library_ids(vocab, text):
    return vocab.library.encode(text, add_special_tokens=False).ids


def test_odd_texts_alone_and_together(vocab):
    want = [library_ids(vocab, t) for t in ODD]
    assert [np.frombuffer(vocab.encode([t])[0], "<u4").tolist() for t in ODD] == want
    assert [np.frombuffer(i, "<u4").tolist() for i in vocab.encode(ODD)] == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abTs'.,!0 19\n\t ré|<>-_\u00a0ü日")), max_size=40))
def test_any_text(vocab, text):
    assert np.frombuffer(vocab.encode([text])[0], "<u4").tolist() == library_ids(vocab, text)


def test_forced_cuts_are_pairs_of_no_token():
    vocab = bpe.Vocabulary(bpe.vocabulary_text(PATHS[0]))
    tokens = list(vocab.bytes_of.values())
    for a, b in ((ord("q"), ord("z")), (ord("t"), ord("h")), (ord("e"), ord(" "))):
        assert vocab.joined[a, b] == any(bytes([a, b]) in t for t in tokens)
    assert not vocab.joined[ord("e"), ord(" ")] and vocab.joined[ord("t"), ord("h")]


def test_query_matches_the_library(spark):
    library = Tokenizer.from_file(PATHS[0])
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op3_bpe(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_and_odd_rows(odd_documents, no_documents):
    coded = bpe.encode(odd_documents, PATHS[0])
    back = sorted((r.id or 0, r.text) for r in bpe.decode(coded, PATHS[0]).collect())
    assert back == sorted((r.doc_id or 0, r.text or "") for r in odd_documents.collect())
    assert bpe.encode(no_documents, PATHS[0]).isEmpty()


def packing_is_sound(rows, capacity):
    """Sequences are gapless and within capacity, and every id of every document lies in one piece."""
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return sequences, documents


def test_packing_the_documents(spark):
    library = Tokenizer.from_file(PATHS[1])
    rows = queries.op6_packing(spark, DATA).collect()
    sequences, documents = packing_is_sound(rows, 2048)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    assert {k for k in documents} == {(i, len(own)) for i, own in ids.items()}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(part) == 4 * r.length and zlib.crc32(part) == r.ids_crc32
    total = sum(map(len, ids.values()))
    assert sum(r.length for r in rows) == total
    assert len(sequences) <= total / 2048 * 1.01 + 1


def test_packing_odd_rows_and_small_groups(odd_documents, no_documents, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 10)
    packed = packing.pack(odd_documents, PATHS[1], 1, 64, with_ids=True)
    rows = packed.withColumnRenamed("id", "doc_id").collect()
    packing_is_sound(rows, 64)
    assert len({r.sequence_id >> 32 for r in rows}) > 5
    assert sum(r.start == 0 for r in rows) == odd_documents.count()
    assert all(r.doc_tokens == 1 for r in rows if r.doc_id in (4, 5, 6))
    joined = packing.sequences(packed).collect()
    assert all(len(r.ids) == 4 * r.length <= 256 for r in joined)
    assert sum(r.length for r in joined) == sum(r.length for r in rows)
    assert packing.pack(no_documents, PATHS[1], 1).isEmpty()


def test_tournament_is_first_fit():
    draw = np.random.default_rng(2)
    sizes = np.sort(draw.integers(1, 101, 300))[::-1]
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    room = []
    for size, b, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        first = next((i for i, r in enumerate(room) if r >= size), len(room))
        if first == len(room):
            room.append(100)
        assert b == first and offset == 100 - room[first]
        room[first] -= size
