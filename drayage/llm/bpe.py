"""Byte-pair encoding by forced boundaries, and decoding.

A pair of adjacent bytes that occurs inside no vocabulary token can never be
spanned by a merge, so it marks a certain cut.  Every text is cut there (and
where the vocabulary's own pre-tokenizer cuts), each fragment is encoded on
its own, and the ids are put together again.  A worker does this for a few
megabytes of text at once: all cuts come from array operations, equal fragments
are found by their bytes, and the distinct ones are merged together as rows of
a matrix.

Texts: null counts as empty; an empty text has no ids; a text of any length is
encoded whole.  Repeated rows are encoded like any other row.  Only the id and
the text column are read, so further columns, whatever their names, are ignored.
"""

import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from drayage.llm.common import chunks, map_batches, text_bytes

#: Bytes of text encoded together; a longer text is encoded alone.
TOGETHER_BYTES = 4 << 20
#: Longer fragments go to the library one by one, since a matrix row costs its square.
MATRIX_WIDTH = 64
NO_RANK = np.int32(2**31 - 1)
#: The table of merge rules has 2 ** SLOT_BITS places, several for each rule.
SLOT_BITS = 18
NO_KEY = np.uint64(2**64 - 1)
#: Keeps the first n bytes of eight.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)

# Characters whose classes and cases depend neither on the Unicode version nor on their neighbours.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\u00a1-\u012f\u0131-\u017f]*").fullmatch
SPACE, LETTER, DIGIT, OTHER = range(4)

# Endings that the pre-tokenizers split off after an apostrophe, in the order they try them.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _classes() -> np.ndarray:
    """Class of each plain character by code point."""
    kinds = {"L": LETTER, "N": DIGIT, "Z": SPACE}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x180)], np.uint8)
    table[[9, 10, 13]] = SPACE
    return table


CLASSES = _classes()


def _byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge rules and tokens of one vocabulary file (its JSON text)."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        spec = json.loads(text)
        model = spec["model"]
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        symbols = _byte_symbols()
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        back = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = np.array([vocab[s] for s in symbols], np.int32)
        self.end_ids = np.array([vocab[s + self.suffix] for s in symbols], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self._fill(np.array([vocab[a] for a, _ in merges], np.int32), np.array([vocab[b] for _, b in merges], np.int32))
        self.merged = np.array([vocab[a.removesuffix(self.suffix) + b if self.suffix else a + b] for a, b in merges], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.bytes_of: dict[int, bytes] = {}
        self.joined = np.zeros((256, 256), bool)
        for token, i in vocab.items():
            raw = bytes(back[c] for c in token.removesuffix(self.suffix) if c in back) if self.suffix else bytes(back[c] for c in token)
            self.bytes_of[i] = raw
            codes = np.frombuffer(raw, np.uint8)
            self.joined[codes[:-1], codes[1:]] = True
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.symbols = symbols
        self.back = back

    # -- fragments ------------------------------------------------------

    def _slots(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)
        return key, (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def _fill(self, left: np.ndarray, right: np.ndarray) -> None:
        """Put the merge rules into an open hash table."""
        self.keys = np.full(1 << SLOT_BITS, NO_KEY, np.uint64)
        self.ranks = np.full(1 << SLOT_BITS, NO_RANK, np.int32)
        key, slot = self._slots(left, right)
        rest = np.arange(len(key))
        while len(rest):
            free = rest[self.keys[slot[rest]] == NO_KEY]
            self.keys[slot[free]] = key[free]  # of several for one slot, one stays
            own = free[self.keys[slot[free]] == key[free]]
            self.ranks[slot[own]] = own
            rest = np.setdiff1d(rest, own, assume_unique=True)
            slot[rest] = (slot[rest] + np.uint64(1)) & np.uint64((1 << SLOT_BITS) - 1)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the rules for pairs of ids; NO_RANK where there is none."""
        key, slot = self._slots(left, right)
        found = self.keys[slot]
        rank = np.where(found == key, self.ranks[slot], NO_RANK)
        rest = np.flatnonzero((found != key) & (found != NO_KEY))
        while len(rest):
            slot[rest] = (slot[rest] + np.uint64(1)) & np.uint64((1 << SLOT_BITS) - 1)
            found = self.keys[slot[rest]]
            hit = found == key[rest]
            rank[rest[hit]] = self.ranks[slot[rest[hit]]]
            rest = rest[~hit & (found != NO_KEY)]
        return rank

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Merge each row (padded with -1) until no rule applies."""
        done = ids.copy()
        rows = np.arange(len(ids))
        rank = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        rank[ids[:, 1:] < 0] = NO_RANK
        rank = np.concatenate([rank, np.full((len(ids), 1), NO_RANK, np.int32)], 1)
        width = np.arange(ids.shape[1])
        while len(rows):
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            live = best < NO_RANK
            if not live.all():
                done[rows[~live]] = ids[~live]
                rows, ids, rank, at, best = rows[live], ids[live], rank[live], at[live], best[live]
                if not len(rows):
                    break
            here = np.arange(len(rows))
            moved = width[None, :] > at[:, None]
            ids[:, :-1] = np.where(moved[:, :-1], ids[:, 1:], ids[:, :-1])
            rank[:, :-1] = np.where(moved[:, :-1], rank[:, 1:], rank[:, :-1])
            ids[:, -1] = -1
            ids[here, at] = self.merged[best]
            before = np.maximum(at - 1, 0)
            left = np.concatenate([at, before])
            twice = np.concatenate([here, here])
            right = ids[twice, np.minimum(left + 1, len(width) - 1)]
            new = self._rank(ids[twice, left], right)
            new[(right < 0) | (left == len(width) - 1)] = NO_RANK
            rank[twice, left] = new
        return done

    def encode_fragments(self, fragments: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of fragments, each on its own."""
        out: list[bytes] = [b""] * len(fragments)
        sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
        low = 0
        for width in (2, 4, 8, 16, 32, MATRIX_WIDTH):
            own = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            for piece in np.array_split(own, len(own) * width // 500_000 + 1) if len(own) else ():
                raw = np.frombuffer(b"".join([fragments[i] for i in piece]), np.uint8)
                size = sizes[piece]
                filled = np.arange(width)[None, :] < size[:, None]
                ids = np.full((len(piece), width), -1, np.int32)
                ids[filled] = self.byte_ids[raw]
                if self.suffix:
                    ids[np.arange(len(piece)), size - 1] = self.end_ids[raw[np.cumsum(size) - 1]]
                ids = self._merge(ids)
                kept = ids >= 0
                flat = ids[kept].astype("<u4").tobytes()
                ends = np.cumsum(kept.sum(1) * 4).tolist()
                start = 0
                for i, end in zip(piece.tolist(), ends):
                    out[i] = flat[start:end]
                    start = end
        for i in np.flatnonzero(sizes > MATRIX_WIDTH).tolist():
            out[i] = self._long(fragments[i])
        return out

    def _long(self, fragment: bytes) -> bytes:
        from tokenizers import Tokenizer

        if not hasattr(self, "_model"):
            self._model = Tokenizer(self.library.model)
        text = "".join([self.symbols[b] for b in fragment])
        return np.array(self._model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    # -- texts ----------------------------------------------------------

    def _plain_starts(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens of plain texts start, and which bytes belong to none.

        codes: the texts' bytes one after the other; first: True where a text begins.
        """
        kind = CLASSES[np.minimum(codes, 127)]
        lead = np.flatnonzero(codes >= 0xC2)
        kind[lead] = kind[lead + 1] = CLASSES[((codes[lead] & 31).astype(np.int64) << 6) | (codes[lead + 1] & 63)]
        start = np.ones(len(codes) + 1, bool)
        start[1:-1] = (kind[1:] != kind[:-1]) | first[1:]
        if self.suffix:
            digits = (kind == DIGIT) & ((codes & 0xC0) != 0x80)
            start[:-1] |= digits
            dropped = kind == SPACE
        else:
            space = kind == SPACE
            last = space.copy()  # the last of some white space that other characters follow
            last[:-1] &= ~space[1:] & ~first[1:]
            last[-1] = False
            at = np.flatnonzero(last)
            start[at] = True
            start[at[codes[at] == 0x20] + 1] = False
            dropped = np.zeros(len(codes), bool)
        quote = np.flatnonzero((codes == 0x27) & start[:-1] & start[1:])
        text = codes.tobytes()
        for i in quote.tolist():
            for ending in ENDINGS:
                end = i + 1 + len(ending)
                if text.startswith(ending.encode(), i + 1) and not first[i + 1 : end].any():
                    start[i + 1] = False
                    start[end] = True
                    break
        return start, dropped

    def _other_tokens(self, text: str) -> list[bytes]:
        """Pre-tokens of a text with characters that only the library classifies surely."""
        if self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        return [bytes(map(self.back.__getitem__, t)) for t, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _encode_cut(self, codes: np.ndarray, start: np.ndarray, dropped: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Encode the fragments between the starts and put the ids of each text, up to its end, together."""
        if not self.suffix:
            start[1:-1] |= ~self.joined[codes[:-1], codes[1:]]
        at = np.flatnonzero(start)
        begin, size = at[:-1], np.diff(at)
        kept = ~dropped[begin]
        begin, size = begin[kept], size[kept]
        raw = codes.tobytes()
        which = np.empty(len(begin), np.int64)
        fragments: list[bytes] = []

        def number(own: np.ndarray, first: np.ndarray, inverse: np.ndarray) -> None:
            which[own] = inverse + len(fragments)
            fragments.extend(raw[a : a + n] for a, n in zip(begin[own][first].tolist(), size[own][first].tolist()))

        padded = np.concatenate([codes, np.zeros(16, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        head = eight[begin] & MASKS[np.minimum(size, 8)]
        for low, high in ((0, 8), (8, 16)):
            own = np.flatnonzero((size > low) & (size <= high))
            key = head[own]
            if low:  # distinct by both halves
                tail = eight[begin[own] + 8] & MASKS[size[own] - 8]
                key = key * np.uint64(0x9E3779B97F4A7C15) ^ (tail * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)) ^ tail
            _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            if low and not ((head[own] == head[own][first][inverse]) & (tail == tail[first][inverse])).all():
                _, first, inverse = np.unique(np.stack([head[own], tail], 1), axis=0, return_index=True, return_inverse=True)
            number(own, first, inverse.ravel())
        table: dict[bytes, int] = {}
        own = np.flatnonzero(size > 16)
        which[own] = [table.setdefault(raw[a : a + n], len(table)) + len(fragments) for a, n in zip(begin[own].tolist(), size[own].tolist())]
        fragments.extend(table)

        ids = self.encode_fragments(fragments)
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        offset = np.cumsum(count) - count
        each = count[which]
        upto = np.cumsum(each)
        out = flat[np.repeat(offset[which] - upto + each, each) + np.arange(upto[-1] if len(upto) else 0)].tobytes()
        marks = np.concatenate([[0], upto])[np.searchsorted(begin, ends)] * 4
        return [out[a:b] for a, b in zip([0, *marks[:-1].tolist()], marks.tolist())]

    def _encode_run(self, texts: list[str], plain: bool) -> list[bytes]:
        if plain:
            raws = [(t.lower() if self.suffix else t).encode() for t in texts]
        else:
            tokens = [self._other_tokens(t) for t in texts]
            raws = [b"".join(own) for own in tokens]
        ends = np.cumsum(list(map(len, raws)))
        if not len(ends) or not ends[-1]:
            return [b""] * len(texts)
        codes = np.frombuffer(b"".join(raws), np.uint8)
        if plain:
            first = np.zeros(len(codes) + 1, bool)
            first[np.concatenate([[0], ends])] = True
            start, dropped = self._plain_starts(codes, first[:-1])
        else:
            start, dropped = np.zeros(len(codes) + 1, bool), np.zeros(len(codes), bool)
            start[np.cumsum([0, *(len(t) for own in tokens for t in own)])] = True
        return self._encode_cut(codes, start, dropped, ends)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, together about TOGETHER_BYTES in size."""
        parts: list[str] = []
        ends = [0]
        for text in texts:
            parts += self.split_special(text) if "<|" in text else [text]
            ends.append(len(parts))
        ids = [b""] * len(parts)
        plain = [p not in self.special and _PLAIN(p) is not None for p in parts]
        for kind in (True, False):
            own = [i for i, p in enumerate(parts) if plain[i] is kind and p not in self.special]
            for i, got in zip(own, self._encode_run([parts[i] for i in own], kind)):
                ids[i] = got
        for i, p in enumerate(parts):
            if p in self.special:
                ids[i] = np.array([self.special[p]], "<u4").tobytes()
        return [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:])]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table.get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[int, Vocabulary] = {}


def vocabulary(text: str) -> Vocabulary:
    """The worker's own copy, made once."""
    key = hash(text)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(text)
    return _loaded[key]


def vocabulary_text(path: str) -> str:
    """Read on the driver; executors get the text, whose size the vocabulary bounds."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Per row: id, ids (binary, little-endian unsigned 32-bit) and, if asked, the text decoded from them."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(shared.value)
        for batch in batches:
            texts = [t.decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            ids: list[bytes] = []
            for a, b in chunks(list(map(len, texts)), TOGETHER_BYTES):
                ids += vocab.encode(texts[a:b])
            columns = [batch.column(0), pa.array(ids, pa.binary())]
            if decoded:
                columns.append(pa.array(map(vocab.decode, ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "ids", "decoded"][: len(columns)])

    plain = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("text"))
    return map_batches(plain, run, f"id {kind}, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """Per row of `encode`: id and text.  Null ids decode to an empty text; ids outside the vocabulary to nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary_text(vocabulary_path))
    kind = encoded.schema["id"].dataType.simpleString()

    def run(batches):
        vocab = vocabulary(shared.value)
        for batch in batches:
            texts = [vocab.decode(i or b"") for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return map_batches(encoded.select("id", "ids"), run, f"id {kind}, text string")
