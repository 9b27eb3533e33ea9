"""Word shingles of whole texts as 64-bit hashes, for many texts at once.

A-Z are lower-cased and words are the runs between white space. The hash of a word is a polynomial over its bytes
modulo 2**64 (differences of one running sum over the buffer), that of a shingle a mixed sum over its words. Words of more than
``LONG_WORD`` bytes, for which equal polynomials can be constructed, are hashed by BLAKE2b. A long text is hashed in pieces of
``CHUNK_BYTES``, cut at white space, so that it takes eight bytes a word rather than forty a byte.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_DRAW = np.random.default_rng(97)
_BYTE = _DRAW.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_P = _U(int(_DRAW.integers(2**62, 2**63)) | 1)
_WORD = _DRAW.integers(1, 2**64 - 1, 64, dtype=np.uint64) | _U(1)
_INVERSE = _U(pow(int(_P), -1, 2**64))
CHUNK_BYTES = 1 << 18
LONG_WORD = 256
_GAP = re.compile(rb"[ \t-\r]")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _INVERSE)):
            steps = np.full(n + n // 2, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and where they start."""
    buf = np.frombuffer(raw.lower() + b"\n", dtype=np.uint8)
    word = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.uint64), first
    power, inverse = (x[: len(buf)] for x in _powers(len(buf) + 1))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * power, dtype=np.uint64)])
    words = mix((run[last] - run[first]) * inverse[first] + (last - first).astype(np.uint64))
    for i in np.flatnonzero(last - first > LONG_WORD).tolist():
        words[i] = int.from_bytes(hashlib.blake2b(buf[first[i] : last[i]].tobytes(), digest_size=8).digest(), "little")
    return words, first


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    total = np.zeros(max(0, len(words) - k + 1), dtype=np.uint64)
    for j in range(k):
        total += words[j : j + len(total)] * _WORD[j]
    return mix(total)


def _few(words: np.ndarray) -> np.ndarray:
    """The one shingle of fewer than ``k`` words."""
    n = len(words)
    return mix(np.array([int((words * _WORD[:n]).sum(dtype=np.uint64)) ^ (n << 56)], dtype=np.uint64)) if n else words


def _chunk(raw: list[bytes], k: int) -> list[np.ndarray]:
    words, first = _word_hashes(b"\n".join(raw))
    grams = _grams(words, k)
    upto = np.searchsorted(first, np.cumsum([len(r) + 1 for r in raw]))
    out, at = [], 0
    for end in upto.tolist():
        out.append(np.unique(grams[at : end - k + 1]) if end - at >= k else _few(words[at:end]))
        at = end
    return out


def _long(raw: bytes, k: int) -> np.ndarray:
    """The same for one text, read in pieces."""
    parts, at = [], 0
    while at < len(raw):
        gap = _GAP.search(raw, at + CHUNK_BYTES)
        end = gap.start() if gap else len(raw)
        parts.append(_word_hashes(raw[at:end])[0])
        at = end
    words = np.concatenate(parts)
    return np.unique(_grams(words, k)) if len(words) >= k else _few(words)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles of ``k`` words, sorted; all words as one if there are fewer; empty without words."""
    raw: list[bytes] = []
    size = 0
    for t in texts:
        own = (t or "").encode("utf-8", "surrogatepass")
        if raw and size + len(own) > CHUNK_BYTES:
            yield from _chunk(raw, k)
            raw, size = [], 0
        if len(own) > CHUNK_BYTES:
            yield _long(own, k)
        else:
            raw.append(own)
            size += len(own)
    if raw:
        yield from _chunk(raw, k)
