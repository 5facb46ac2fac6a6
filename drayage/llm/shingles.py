"""Word shingles of byte texts as 64-bit hashes, many texts at a time."""

import numpy as np

from drayage.llm.common import CHUNK_BYTES

WORDS = 5

_U = np.uint64
_rng = np.random.default_rng(0x5EED)
#: A random number for each byte, equal for A-Z and a-z.
BYTE_VALUES = _rng.integers(1, 2**64, 256, dtype=np.uint64) | _U(1)
BYTE_VALUES[65:91] = BYTE_VALUES[97:123]
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    codes = np.frombuffer(text, np.uint8)
    gap = SEPARATOR[codes]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    up, down = _power(len(codes))
    upto = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[codes] * up, out=upto[1:])
    return mix((upto[end] - upto[start]) * down[start] + (end - start).astype(np.uint64)), start


def _pieces(text: bytes) -> list[bytes]:
    """A long text cut before separators, so that no piece is much longer than a chunk."""
    out, at = [], 0
    while len(text) - at > CHUNK_BYTES:
        cut = max(text.rfind(s, at + 1, at + CHUNK_BYTES) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            found = [i for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(s, at + CHUNK_BYTES)) >= 0]
            cut = min(found, default=len(text))
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def _combine(words: list[np.ndarray]) -> np.ndarray:
    hashed = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        hashed = mix(hashed * _U(0xD6E8FEB86659FD93) + w)
    return hashed


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; fewer than WORDS words make one shingle, none make none."""
    if len(texts) == 1 and len(texts[0]) > CHUNK_BYTES:
        hashes = np.concatenate([word_hashes(p)[0] for p in _pieces(texts[0])])
        ends = [len(hashes)]
    else:
        hashes, start = word_hashes(b"\n".join(texts))
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts])).tolist()
    n = len(hashes) - WORDS + 1
    whole = _combine([hashes[i : n + i] for i in range(WORDS)]) if n > 0 else hashes[:0]
    out, a = [], 0
    for b in ends:
        if b - a >= WORDS:
            out.append(np.unique(whole[a : b - WORDS + 1]))
        elif b > a:
            out.append(_combine([hashes[i : i + 1] for i in range(a, b)]))
        else:
            out.append(hashes[:0])
        a = b
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
