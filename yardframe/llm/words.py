"""Words, shingles and windows of many texts at once, as numpy arrays of 64-bit hashes.

Texts are joined to one byte array. A word is a run of bytes that are no separators; its hash is a
polynomial over random byte values modulo 2**64, read from prefix sums, so no Python loop runs per
word. Hashes are the same in every process. Equal hashes of different words or shingles have a chance of
2**-64 a pair; operators that must be exact compare the words' bytes as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SPACES = bytes([0x20, *range(0x09, 0x0E)])  # [\x20\x09-\x0D]
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_FACTOR = pow(0x9E3779B97F4A7C15, 1, 1 << 64) | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_SLICE = 1 << 20


def byte_table(separators: bytes, lower: bool) -> bytes:
    """Translation to bytes in which a separator is 0x20 and A-Z may be lowered."""
    table = bytearray(range(256))
    if lower:
        table[65:91] = LOWER
    for b in separators:
        table[b] = 0x20
    return bytes(table)


SPACED = byte_table(SPACES, lower=False)
SPACED_LOWER = byte_table(SPACES, lower=True)
#: Words are runs of 0-9, a-z and everything beyond ASCII.
ALNUM_LOWER = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, 1 << 64))
        filled += step
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a run of texts. Word i covers data[start[i]:end[i]]; text t owns words first[t]:first[t + 1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split_words(texts: list[str | None], table: bytes) -> Words:
    raw = [(t or "").encode("utf-8", "surrogatepass").translate(table) for t in texts]
    joined = b" ".join([*raw, b""]) if raw else b""
    data = np.frombuffer(joined, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 0x20
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    lengths = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    edges = np.concatenate([[0], np.cumsum(lengths)])
    first = np.searchsorted(start, edges)
    return Words(data, start, end, _hashes(data, start, end), first)


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    span = int(min(len(data), _SLICE + (end - start).max()))
    power, inverse = _powers(_FACTOR, span + 1), _powers(_INVERSE, span + 1)
    at = 0
    while at < len(start):  # slices of whole words bound the temporary arrays
        origin = int(start[at])
        upto = max(at + 1, int(np.searchsorted(end, origin + span, side="right")))
        s, e = start[at:upto] - origin, end[at:upto] - origin
        piece = _VALUES[data[origin : origin + int(e[-1])]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * power[: len(piece)], dtype=np.uint64)])
        out[at:upto] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number and first word (within its text) of all runs of `size` words inside one text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = words.counts()
    text = np.repeat(np.arange(len(counts)), counts)
    ok = np.flatnonzero(text[:n] == text[size - 1 :])
    return gram_hashes(words.hash, size)[ok], text[ok], ok - words.first[text[ok]]


def gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` values of h (also over text borders)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size <= 8:
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out = out * np.uint64(_FACTOR) + h[j : n + j]
        return mix(out)
    power, inverse = _powers(_FACTOR, len(h) + 1), _powers(_INVERSE, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)])
    return mix((sums[size:] - sums[:n]) * inverse)


def pieces(texts: list[str | None], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `chars` characters each; a longer text stands alone."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and held + n > chars:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)
