"""Toxic texts by compression distance: two zstandard dictionaries, window by window.

One dictionary is trained on toxic text, one on ordinary text.  A window is a
word (a longer run without white space is cut into overlapping windows) or a
sequence of two or three words.  It is compressed under both, and the bytes that the toxic dictionary saves over the
ordinary one are the window's evidence, less what it needs beyond the usual
frame of a window it knows whole.  A text's score is a calibrated function
of its strongest evidence, so one window can convict a long text.

What makes short windows comparable: both dictionaries end in the same ordinary
base and every window stands between the same two strings, so both frames differ
by the window alone; and each byte is written twice, so that a literal costs
more than the reference to a match.  The words of a sequence are written letter
by letter in turn, so that none of them alone looks like the sequence.  Of a
text's sequences those are compressed whose neighbouring words are neighbours in
some learnt sequence; any other has no match in the dictionary.

The toxic dictionary is trained on words and sequences of toxic texts that occur
there significantly and much more often than in ordinary texts (a one-sided
test of the numbers of texts, false finds held at FALSE_FINDS by Benjamini and
Hochberg's rule), and on words made up of byte n-grams that do; sequences are
learnt from the texts without such a word.  It is as large as what was found
(LEAST_BYTES at least); what the trainer leaves out is put before it.  Near
copies among the training texts count once.  Training uses a bounded sample
(TRAIN_TOXIC and TRAIN_ORDINARY labelled rows, chosen by a hash of the id; of a
text over TRAIN_CHARS characters PIECES even pieces with as many characters in
all); scoring reads every whole text.  Equal texts have equal scores.

Null text counts as empty and scores like any text without evidence.  Labels
other than 0 and 1 are ignored; when a label has no row, nothing can be learnt
and every score is 0.  Repeated rows are scored alike; an empty table gives no
rows.  Only the id, the text and, in training, the label are read.
"""

import heapq
import math
import random
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, replace
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from drayage.llm.common import map_batches, text_bytes

TRAIN_TOXIC = 1500
TRAIN_ORDINARY = 4000
TRAIN_CHARS = 20_000
PIECES = 20
BASE_BYTES = 1024
LEAST_BYTES = 4096
LEVEL = 17
#: Bytes of an n-gram, the toxic texts that must hold it, and how much likelier it must be there (log).
GRAM = 5
GRAM_TEXTS = 5
GRAM_LIFT = 3.0
#: Toxic texts that must hold what is learnt, how much likelier it must be there (log), and the share of false finds.
LEAST_TEXTS = 3
LIFT = 2.3
FALSE_FINDS = 0.02
#: The largest chance of a find among words, and among sequences, many of which overlap.
CHANCE = 2e-3
SEQUENCE_CHANCE = 1e-4
#: Texts with fewer distinct words count as having so many.
LEAST_WORDS = 8
#: How many more words the ordinary dictionary is trained on, and how much larger it is.
ORDINARY_WORDS = 8
ORDINARY_SIZE = 2
#: Longer runs without white space are cut into windows of this many bytes, each half over the next.
WINDOW = 40
#: Words whose evidence a worker remembers.
REMEMBERED = 400_000
MASKED = bytes(b ^ 0x5A for b in range(256))
EDGE = b" .,;:!?\"'()[]{}<>*#&%-_/\\|=+~`^$@"


@dataclass(frozen=True)
class Model:
    """Both dictionaries, the strings around a window, the size of a known toxic window's frame, the calibration, and
    the neighbouring words of learnt sequences."""

    toxic: bytes
    ordinary: bytes
    before: bytes
    after: bytes
    floor: int
    weights: tuple[float, ...]
    neighbours: frozenset[tuple[bytes, bytes]] = frozenset()


def twice(data: bytes) -> bytes:
    """Each byte followed by its mask, so a literal costs double."""
    out = bytearray(2 * len(data))
    out[::2] = data
    out[1::2] = data.translate(MASKED)
    return bytes(out)


def windows(word: bytes) -> list[bytes]:
    """A word without its edge punctuation, or the pieces of a long one."""
    word = word.strip(EDGE)
    if len(word) <= WINDOW:
        return [word]
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def bare(text: bytes) -> list[bytes]:
    """The words of a text without edge punctuation."""
    return [w for w in (x.strip(EDGE) for x in text.split()) if w]


def in_turn(words: tuple[bytes, ...]) -> bytes:
    """The letters of words in turn, short words filled up with blanks."""
    return bytes(c for letters in zip_longest(*words, fillvalue=32) for c in letters)


class Judge:
    """Compressors of a model and the evidence they have given so far."""

    def __init__(self, model: Model):
        self.model = model
        self.toxic, self.ordinary = map(self._compressor, (model.toxic, model.ordinary))
        self.before, self.after = twice(model.before + b" "), twice(b" " + model.after)
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes):
        log = max(14, (2 * len(content) + 1024).bit_length())  # tables no larger than the dictionary needs
        settings = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
            min_match=6,
            window_log=log,
            chain_log=log - 1,
            hash_log=log - 2,
            search_log=4,
        )
        trained = zstandard.ZstdCompressionDict(twice(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        trained.precompute_compress(compression_params=settings)
        return zstandard.ZstdCompressor(dict_data=trained, compression_params=settings).compress

    def frame(self, words: list[bytes]) -> int:
        """The middle size of these words' frames under the toxic dictionary."""
        sizes = sorted(len(self.toxic(self.before + twice(w) + self.after)) for w in sorted(set(words)))
        return sizes[len(sizes) // 2] if sizes else 0

    def evidence(self, word: bytes) -> int:
        """The strongest evidence of a word's windows."""
        return max(map(self._evidence, windows(word)))

    def _evidence(self, window: bytes) -> int:
        if not window:
            return 0
        framed = self.before + twice(window) + self.after
        toxic = len(self.toxic(framed))
        return len(self.ordinary(framed)) - toxic - max(0, toxic - self.model.floor)

    def sequences(self, lowered: bytes) -> set[tuple[bytes, ...]]:
        """The text's sequences of two and three words whose neighbours are neighbours in a learnt sequence."""
        near = self.model.neighbours
        if not near:
            return set()
        words = bare(lowered)
        at = [i for i, pair in enumerate(zip(words, words[1:])) if pair in near]
        both = set(at)
        return {tuple(words[i : i + 2]) for i in at} | {tuple(words[i : i + 3]) for i in at if i + 1 in both}

    def features(self, text: str) -> tuple[float, ...]:
        """The three strongest pieces of evidence and the log of the number of words, which is alike for all short texts."""
        lowered = text.lower().encode()
        words = list(set(lowered.split()))
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for i, e in enumerate(found):
                if e is None:
                    found[i] = self.known[words[i]] = self.evidence(words[i])
        strongest: dict[bytes, int] = {}
        for e, word in heapq.nlargest(12, zip(found, words)):
            strongest.setdefault(word.strip(EDGE), max(0, e))
        for sequence in self.sequences(lowered):
            strongest[b" ".join(sequence)] = max(0, self._evidence(in_turn(sequence)))
        top = [*sorted(strongest.values(), reverse=True)[:3], 0, 0, 0][:3]
        return (*map(float, top), math.log(max(LEAST_WORDS, len(words))))

    def score(self, text: str) -> float:
        return _sigmoid(sum(w * x for w, x in zip(self.model.weights, (*self.features(text), 1.0))))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


# -- training -----------------------------------------------------------


def _fresh(texts: list[bytes]) -> list[bytes]:
    """Texts that aren't near copies of earlier ones."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = text.split()
        own = {hash(tuple(words[i : i + 4])) for i in range(max(1, len(words) - 3))}
        if len(own & seen) <= 0.2 * len(own):
            seen |= own
            out.append(text)
    return out


def _grams(text: bytes) -> np.ndarray:
    padded = np.frombuffer(text + bytes(8), np.uint8)
    every = np.ndarray((max(0, len(text) - GRAM + 1),), "<u8", padded, strides=(1,))
    return every & np.uint64((1 << (8 * GRAM)) - 1)


def _held(keys: np.ndarray, texts: Iterable[np.ndarray]) -> np.ndarray:
    """How many texts, each an array of distinct keys, hold each of the sorted keys."""
    counts = np.zeros(len(keys), np.int64)
    for own in texts if len(keys) else ():
        at = np.searchsorted(keys, own).clip(max=len(keys) - 1)
        counts[at[keys[at] == own]] += 1
    return counts


def _telling(toxic: list[np.ndarray], ordinary: Iterable[np.ndarray], others: int, chance: float) -> np.ndarray:
    """Keys, distinct within each text, that toxic texts hold significantly and much more often than the others."""
    keys, n = np.unique(np.concatenate(toxic), return_counts=True)
    keys, n = keys[n >= LEAST_TEXTS], n[n >= LEAST_TEXTS]
    if not len(keys):
        return keys
    m = _held(keys, ordinary)
    expected, share = len(toxic) / (len(toxic) + others), n / (n + m)
    rest = np.maximum(1 - share, 1e-300)
    distance = share * np.log(share / expected) + (1 - share) * np.log(rest / (1 - expected))
    p = np.where(share > expected, np.exp(-(n + m) * distance), 1.0)  # Chernoff's bound of the binomial tail
    testable = expected ** (n + m) <= chance  # the others could not be significant whatever texts hold them
    ranked = np.sort(p[testable])
    passed = ranked[ranked <= FALSE_FINDS * np.arange(1, len(ranked) + 1) / max(1, len(ranked))]
    lift = np.log((n + 0.5) / (len(toxic) + 1)) - np.log((m + 0.5) / (others + 1))
    return keys[testable & (p <= min(chance, passed.max(initial=0))) & (lift > LIFT)]


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _telling_grams(toxic: list[bytes], ordinary: list[bytes]) -> set[int]:
    """Byte n-grams of at least GRAM_TEXTS toxic texts that are much likelier there."""
    grams, counts = np.unique(np.concatenate([np.unique(_grams(t)) for t in toxic]), return_counts=True)
    grams, counts = grams[counts >= GRAM_TEXTS], counts[counts >= GRAM_TEXTS]
    elsewhere = _held(grams, (np.unique(_grams(t)) for t in ordinary))
    lift = np.log((counts + 0.5) / (len(toxic) + 1)) - np.log((elsewhere + 0.5) / (len(ordinary) + 1))
    return set(grams[lift > GRAM_LIFT].tolist())


def _words_of(toxic: list[bytes], ordinary: list[bytes]) -> Counter:
    """Telling words and the toxic texts that hold them: words that tell, or half of whose n-grams do."""

    def own(text: bytes) -> np.ndarray:
        return np.unique(_hashes(bare(text)))

    telling = set(_telling([own(t) for t in toxic], (own(t) for t in ordinary), len(ordinary), CHANCE).tolist())
    parts = _telling_grams(toxic, ordinary)

    def tells(word: bytes) -> bool:
        grams = _grams(b" " + word + b" ").tolist()
        if 2 * sum(g in parts for g in grams) >= len(grams) > 0:
            return True
        return xxhash.xxh64_intdigest(word.strip(EDGE)) in telling

    found: Counter = Counter()
    for word, n in sorted(Counter(w for t in toxic for w in set(t.split())).items()):
        if tells(word):
            found[word.strip(EDGE)] += n
    return found


def _sequence_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sequences of two and of three words, by place."""
    h, factor = _hashes(words), np.uint64(0x9E3779B97F4A7C15)
    two = h[:-1] * factor + h[1:]
    return two, two[:-1] * factor + h[2:]


def _sequences_of(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> Counter:
    """Telling sequences and the toxic texts that hold them; one is left out where more frequent ones explain its texts."""
    if not toxic:
        return Counter()

    def keys(words: list[bytes]) -> np.ndarray:
        return np.unique(np.concatenate(_sequence_keys(words)))

    chosen = _telling([keys(t) for t in toxic], (keys(t) for t in ordinary), len(ordinary), SEQUENCE_CHANCE)
    holders: dict[tuple[bytes, ...], set[int]] = {}
    for at, words in enumerate(toxic if len(chosen) else ()):
        for n, own in zip((2, 3), _sequence_keys(words)):
            for i in np.flatnonzero(np.isin(own, chosen)).tolist():
                holders.setdefault(tuple(words[i : i + n]), set()).add(at)
    held: Counter = Counter()
    explained: set[int] = set()
    for sequence, texts in sorted(holders.items(), key=lambda h: (-len(h[1]), -len(h[0]), h[0])):
        if len(texts - explained) >= LEAST_TEXTS:
            explained |= texts
            held[sequence] = len(texts)
    return held


def _dictionary(words: list[bytes], size: int, seed: int) -> bytes:
    """zstandard's choice of content for words, four of which form a sample."""
    words = [b" " + w + b" " for w in words]
    random.Random(seed).shuffle(words)
    samples = [b"".join(words[i : i + 4]) for i in range(0, len(words), 4)]
    if sum(map(len, samples)) < 8 * size:
        samples *= 1 + 8 * size // max(1, sum(map(len, samples)))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the words themselves
        return b"".join(samples)[:size]


def _calibrate(rows: list[tuple[float, ...]], labels: list[int]) -> tuple[float, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    x = np.column_stack([np.array(rows), np.ones(len(rows))])
    y, w = np.array(labels, float), np.zeros(x.shape[1])
    ridge = np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(w.tolist())


def _learn(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries of texts, not calibrated."""

    def plain(texts: list[str]) -> list[bytes]:
        return [b" " + b" ".join(t.lower().encode().split()) + b" " for t in texts]

    bad, good = _fresh(plain(toxic)), _fresh(plain(ordinary))
    draw = random.Random(8)
    common = [w for t in good for w in draw.choices(t.split() or [b""], k=30)]
    words = _words_of(bad, good)
    sequences = _sequences_of([w for w in map(bare, bad) if words.keys().isdisjoint(w)], [bare(t) for t in good])
    telling = words + Counter({in_turn(s): n for s, n in sequences.items()})
    base = _dictionary(common, BASE_BYTES, 1)
    size = max(LEAST_BYTES, sum(len(w) + 1 for w in telling))
    against = _dictionary([w for w, n in sorted(telling.items()) for _ in range(n)] or common, size, 2)
    against = b" ".join([*(w for w in sorted(telling) if b" " + w + b" " not in against), against])
    usual = draw.sample(common, min(len(common), ORDINARY_WORDS * max(1, telling.total())))
    control = _dictionary(usual, ORDINARY_SIZE * len(against), 3)
    neighbours = frozenset(pair for s in sequences for pair in zip(s, s[1:]))
    model = Model(b" " + against + base, control + base, base[-40:], base[-80:-60], 0, (), neighbours)
    return replace(model, floor=Judge(model).frame(list(telling)))


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Train on texts; None when a side is empty."""
    if not toxic or not ordinary:
        return None
    model = _learn(toxic, ordinary)
    judge = Judge(model)
    rows = [judge.features(t) for t in (*toxic, *ordinary)]
    return replace(model, weights=_calibrate(rows, [1] * len(toxic) + [0] * len(ordinary)))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic") -> Model | None:
    """Fit on a bounded sample of labelled rows."""
    ids = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("id").isNotNull())

    def sample(label: int, most: int) -> DataFrame:
        return ids.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)

    chosen = sample(1, TRAIN_TOXIC).unionAll(sample(0, TRAIN_ORDINARY))
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(chosen), "id")
    step, size = F.floor(F.length("text") / PIECES).cast("int"), TRAIN_CHARS // PIECES
    pieces = F.concat_ws(" ", *[F.col("text").substr(step * i + 1, F.lit(size)) for i in range(PIECES)])
    rows = found.select("id", "label", F.when(F.length("text") <= TRAIN_CHARS, F.col("text")).otherwise(pieces).alias("text")).collect()
    rows = sorted({(r.id, r.label, r.text) for r in rows})
    return fit([t for _, y, t in rows if y == 1], [t for _, y, t in rows if y == 0])


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and score (0 to 1, higher: toxic likelier)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        judge = Judge(model) if model else None
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            scores = [judge.score(t) if judge else 0.0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return map_batches(docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text")), run, f"id {kind}, score double")


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_bytes(text_col).alias("text"))

    def run(batches):
        judge = Judge(model) if model else None
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            kept = pa.array([not judge or judge.score(t) < threshold for t in texts])
            rows = batch.column(0).filter(kept)
            if len(rows):
                yield pa.RecordBatch.from_struct_array(rows)

    return map_batches(whole, run, docs.schema)
