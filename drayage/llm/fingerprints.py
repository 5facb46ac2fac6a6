"""Document fingerprints from improbable byte windows in chained Bloom filters.

A window is WINDOW bytes of the UTF-8 text (fewer at the end of the text).  One
starts with the text, one with each word, and within a run over LONG bytes of or
without white space one starts wherever the hash of GRAM bytes is the lowest of
NEAR in a row.  So every byte lies in a window, whatever the script.  A window's entropy, over bytes folded onto 64 symbols, is
rounded to LEVELS levels; a level is the rarer the fewer windows of the whole
corpus fall on it, which a first pass counts over all texts.  Of every RUN
windows in a row the rarest gets a point, ties going to the lower content hash,
and windows with POINTS points are the text's features; of fewer than FEW windows
all are.  Texts shorter than the lengths in SHORTER have windows of those sizes
besides, with features and filters of their own, so that short texts show what they share.
A feature sets BITS
bits of a filter; a filter that holds FULL features is closed and a new one
begins, so a fingerprint is as long as its text asks for.

The likeness of two fingerprints takes each filter of the shorter chain, finds
the filter of the other chain that shares most bits with it, beyond what chance
would share and relative to the most they could share, and takes the mean; of
the window sizes that both texts have it is the highest.

Equal texts have equal fingerprints.  Null text counts as empty; an empty text
has an empty fingerprint, which is like (1) another empty one and unlike (0) any
other.  A text of any length is read whole, a chunk of windows at a time.
Repeated rows are treated like any rows; an empty table gives no rows.  Only the
id and the text column are read.
"""

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from drayage.llm.common import chunks, map_batches, stage, text_bytes

WINDOW = 64
SHORTEST = 16
#: Bytes of a shorter window, and of the text below which it is used.
SHORTER = ((16, 512), (8, 64))
#: Two runs of at most LONG bytes and a window of less than SHORTEST lie within WINDOW bytes.
LONG = 24
GRAM = 8
NEAR = 8
LEVELS = 256
RUN = 8
POINTS = 4
FEW = RUN * 4
FILTER_BITS = 2048
BITS = 5
FULL = 160
#: Bytes whose symbols are counted at once.
SPAN = 1 << 18

_U = np.uint64
_rng = np.random.default_rng(0xF1D0)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
_BASE = 0xD1342543DE82EF95
_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True
# eight symbols are counted in the eight bytes of one number; a window holds at most 64, so none overflows
_LANES = np.zeros((8, 256), np.uint64)
for _b in range(256):
    _LANES[(_b & 63) >> 3, _b] = _U(1) << _U(8 * (_b & 7))
_C_LOG_C = np.array([c * np.log2(c) if c else 0.0 for c in range(WINDOW + 1)], np.float32)
_LOG = np.array([0.0, *np.log2(np.arange(1, WINDOW + 1))], np.float32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_known.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, SPAN + 8192), base, np.uint64)
            steps[0] = 1
            _known[name] = np.cumprod(steps, dtype=np.uint64)
    return _known["up"][:n], _known["down"][:n]


_known: dict[str, np.ndarray] = {}


def _span_windows(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy level and content hash of the windows [start, end) of some bytes."""
    counts = np.empty((len(start), 8), np.uint64)
    upto = np.zeros(len(codes) + 1, np.uint64)
    for k in range(8):
        np.cumsum(_LANES[k][codes], out=upto[1:])
        counts[:, k] = upto[end] - upto[start]
    spread = _C_LOG_C[counts.view(np.uint8)].sum(1)
    size = end - start
    entropy = _LOG[size] - spread / np.maximum(size, 1)
    level = np.clip(entropy * (LEVELS - 1) / 6, 0, LEVELS - 1).astype(np.int64)
    up, down = _powers(len(codes))
    np.cumsum(_BYTE[codes] * up, out=upto[1:])
    hashed = (upto[end] - upto[start]) * down[start] + size.astype(np.uint64)
    hashed = (hashed ^ (hashed >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    hashed = (hashed ^ (hashed >> _U(27))) * _U(0x94D049BB133111EB)
    return level, hashed ^ (hashed >> _U(31))


def _starts(codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where windows start, of texts that begin where begin says."""
    gap = _GAP[codes]
    turn = begin.copy()
    turn[1:] |= gap[1:] != gap[:-1]
    run = np.flatnonzero(turn)
    end = np.append(run, len(codes))[1:]
    start = begin | (turn & ~gap)
    long = end - run > LONG
    # the first positions of NEAR whose grams lie within a long run
    edges = np.zeros(len(codes) + 1, np.int8)
    edges[run[long]] = 1
    edges[end[long] - (NEAR + GRAM - 2)] = -1
    inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
    for low in range(0, len(codes) if long.any() else 0, SPAN):
        at = np.flatnonzero(inside[low : low + SPAN])
        if len(at):
            part = np.ascontiguousarray(codes[low : low + SPAN + NEAR + GRAM])
            grams = np.ndarray((len(part) - GRAM + 1,), "<u8", part, strides=(1,)) * _U(_BASE)
            grams = (grams ^ (grams >> _U(32))) * _U(0xBF58476D1CE4E5B9)
            start[low + at + np.lib.stride_tricks.sliding_window_view(grams, NEAR)[at].argmin(1)] = True
    return np.flatnonzero(start)


def windows(texts: list[bytes], window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels and hashes of each text's windows, in order."""
    joined = b"".join(texts)
    codes = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    begin = np.zeros(len(codes) + 1, bool)
    begin[begins] = True
    start = _starts(codes, begin[:-1])
    text_end = ends[np.searchsorted(ends, start, side="right")] if len(start) else start
    size = np.minimum(window, text_end - start)
    # the first window of a text counts however short it is
    first = np.ones(len(start), bool)
    owner = np.searchsorted(ends, start, side="right")
    first[1:] = owner[1:] != owner[:-1]
    kept = (size >= min(window, SHORTEST)) | first
    start, size, owner = start[kept], size[kept], owner[kept]
    level, hashed = np.empty(len(start), np.int64), np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(start, start[at] + SPAN)))
        low, high = int(start[at]), int((start[upto - 1] + size[upto - 1]).item())
        own = start[at:upto] - low
        level[at:upto], hashed[at:upto] = _span_windows(codes[low:high], own, own + size[at:upto])
        at = upto
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(level[a:b], hashed[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def features(level: np.ndarray, hashed: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Hashes of the windows that win POINTS of their runs, or of all when there are fewer than FEW."""
    if len(level) < FEW:
        return hashed
    rank = (rarity[level].astype(np.uint64) << _U(48)) | (hashed >> _U(16))
    won = np.lib.stride_tricks.sliding_window_view(rank, RUN).argmin(1) + np.arange(len(rank) - RUN + 1)
    points = np.bincount(won, minlength=len(rank))
    chosen = hashed[points >= POINTS]
    return chosen if len(chosen) else hashed[[int(rank.argmin())]]


def bloom_chain(chosen: np.ndarray, kind: int = 0) -> np.ndarray:
    """Filters as rows of 64-bit words, the last of which tells the kind of windows: 0 long ones, 1 and on those of SHORTER."""
    count = -(-len(chosen) // FULL)
    bits = np.zeros((count, FILTER_BITS), np.uint8)
    row = np.arange(len(chosen)) // FULL
    for k in range(BITS):
        bits[row, (chosen >> _U(11 * k)) & _U(FILTER_BITS - 1)] = 1
    return np.column_stack([np.packbits(bits, axis=1).view(np.uint64), np.full(count, kind, np.uint64)])


def written(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), np.uint64).reshape(-1, FILTER_BITS // 64 + 1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; the order does not matter."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    kinds = 1 + int(min(a[-1, -1], b[-1, -1]))
    return max(_one_kind(*(x[x[:, -1] == kind, :-1] for x in (a, b))) for kind in range(kinds))


def _one_kind(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) > len(b) or (len(a) == len(b) and a.tobytes() > b.tobytes()):
        a, b = b, a
    in_a, in_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (a, b))
    total = 0.0
    for own, n in zip(a, in_a.tolist()):
        both = np.bitwise_count(b & own).sum(1, dtype=np.int64)
        chance = n * in_b / FILTER_BITS
        most = np.minimum(n, in_b)
        total += float(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0, 1).max())
    return total / len(a)


def every_window(texts: list[bytes]) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Levels and hashes of each text's windows, for each size that it has."""
    out = [[own] for own in windows(texts)]
    for window, below in SHORTER:
        short = [i for i, t in enumerate(texts) if 0 < len(t) < below]
        for i, own in zip(short, windows([texts[i] for i in short], window)):
            out[i].append(own)
    return out


def chains(texts: list[bytes], rarity: np.ndarray) -> list[np.ndarray]:
    return [
        np.concatenate([bloom_chain(features(level, hashed, rarity), kind) for kind, (level, hashed) in enumerate(sizes)])
        for sizes in every_window(texts)
    ]


def level_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rank of each entropy level by its number of windows in all texts, rarest first: LEVELS numbers."""

    def run(batches):
        counts = np.zeros(LEVELS, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(list(map(len, texts))):
                for sizes in every_window(texts[a:b]):
                    for level, _ in sizes:
                        counts += np.bincount(level, minlength=LEVELS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["level", "n"])

    counted = map_batches(docs.select(text_bytes(text_col).alias("text")), run, "level long, n long")
    counts = np.zeros(LEVELS, np.int64)
    for row in counted.groupBy("level").agg(F.sum("n").alias("n")).collect():
        counts[row.level] = row.n
    order = np.lexsort((np.arange(LEVELS), counts))
    ranks = np.empty(LEVELS, np.int64)
    ranks[order] = np.arange(LEVELS)
    return ranks


def fingerprints(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b in chunks(list(map(len, texts))):
                out += map(written, chains(texts[a:b], ranks))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    plain = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    return map_batches(plain, run, f"id {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compare(texts: list[str], own: list[np.ndarray], ranks: np.ndarray) -> list[tuple]:
    """The result columns of every text but the last, each with the next one's text."""
    changed = [edited(t, following).encode() for t, following in zip(texts, texts[1:])]
    changed_chains: list[np.ndarray] = []
    for a, b in chunks(list(map(len, changed))):
        changed_chains += chains(changed[a:b], ranks)
    return [
        (len(t), hashlib.sha256(e).hexdigest(), written(f), written(g), likeness(f, g), likeness(f, following))
        for t, e, f, g, following in zip(texts, changed, own, changed_chains, own[1:])
    ]


def neighbours(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, by descending id: the fingerprints of its text and of its edited text, and their likenesses.

    Rows are sorted in ranges; each range compares neighbours as they pass and
    leaves its first and last row, which one small join brings together across
    ranges (after the last row comes the first).
    """
    kind = docs.schema[id_col].dataType
    text = text_bytes(text_col)
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    rows = rows.repartitionByRange(F.col("id").desc_nulls_last()).sortWithinPartitions(*order)
    results = [
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
    #: place: 0 compared, 1 the range's first row, 2 its last
    schema = T.StructType(
        [
            T.StructField("place", T.IntegerType()),
            T.StructField("range", T.IntegerType()),
            T.StructField("id", kind),
            T.StructField("text", T.BinaryType()),
            *results,
        ]
    )
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["place", "range", "id", "text", *_RESULT]

    def batch_of(place, at, ids, texts, found):
        columns = list(zip(*found)) if found else [[None] * len(ids)] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([place] * len(ids), pa.int32()),
                pa.array([at] * len(ids), pa.int32()),
                ids,
                pa.array(texts, pa.binary()),
                *(pa.array(list(c), k) for c, k in zip(columns, kinds)),
            ],
            names=names,
        )

    def run(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        held_id, held_text, held_chain = None, None, None
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            raws = [t.encode() for t in texts]
            for a, b in chunks(list(map(len, raws))):
                ids = batch.column(0).slice(a, b - a)
                some, own = texts[a:b], chains(raws[a:b], ranks)
                if held_text is None:
                    yield batch_of(1, at, ids.slice(0, 1), raws[a : a + 1], None)
                else:
                    ids, some, own = pa.concat_arrays([held_id, ids]), [held_text, *some], [held_chain, *own]
                found = _compare(some, own, ranks)
                if found:
                    yield batch_of(0, at, ids.slice(0, len(found)), [None] * len(found), found)
                held_id, held_text, held_chain = ids.slice(len(ids) - 1, 1), some[-1], own[-1]
        if held_text is not None:
            yield batch_of(2, at, held_id, [held_text.encode()], None)

    done = stage(map_batches(rows, run, schema), "fingerprints")
    # one row for each range
    ranges = done.filter("place = 1").select("range")
    following = Window.orderBy("range")
    ranges = ranges.select(
        "range", F.coalesce(F.lead("range").over(following), F.first("range").over(following)).alias("after")
    )
    last = done.filter("place = 2").select("range", "id", "text")
    first = done.filter("place = 1").select(F.col("range").alias("after"), F.col("text").alias("next_text"))
    ends = last.join(ranges, "range").join(first, "after").select("id", "text", "next_text")

    def run_ends(batches):
        for batch in batches:
            found = []
            for raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                found += _compare([t.decode("utf-8", "replace") for t in raw], chains(list(raw), ranks), ranks)
            columns = list(zip(*found)) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], names=["id", *_RESULT]
            )

    across = map_batches(ends, run_ends, T.StructType([T.StructField("id", kind), *results]))
    return done.filter("place = 0").select("id", *_RESULT).unionByName(across)
