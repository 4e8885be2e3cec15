"""Periodic stretches of words: maximal runs by Lyndon roots from suffix grouping.

1. A stretch of period q and length >= max(min_length, min_exponent * q) consists of word `GRAM`-grams that come again in
   the same text. Words covered by such grams form segments; every run lies in one segment, so texts without
   a repeated gram are done at once and nothing is lost.
2. A segment's suffixes are grouped as in phase one of Baier's suffix sorter (CPM 2016): groups start as equal first
   words and, from the highest down, split lower groups by the number of suffixes that lean on them. The
   length of a group's common context at the end is the Lyndon array. It is taken under both orders of the words.
3. By the runs theorem (Bannai et al. 2017) each run has a Lyndon root under one of the orders that starts where the
   array says. Every such root is extended to both sides by longest common extensions: binary search on
   prefix sums modulo two primes, then compared word by word for each run found.

A null text has no words and no runs. Rows are independent of each other: repeated ids and texts give repeated rows;
an empty table gives none. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardframe.llm.words import gram_hashes

GRAM = 8
PRIMES = (2147483647, 2147483629)
_BASES = (1186868477, 744590413)

Words = list[bytes]


def lyndon_array(codes: list[int]) -> list[int]:
    """Length of the longest Lyndon word at each position, words compared by code (0 to m - 1, all in use).

    Groups are intervals of `placed`; a group's number is where its interval starts, so higher groups
    have higher numbers. A part that leaves a group takes the end of its interval.
    """
    n = len(codes)
    placed = sorted(range(n), key=codes.__getitem__)
    group, where, context, before = [0] * n, [0] * n, [1] * n, [-1] * n
    ends: dict[int, int] = {}
    start = 0
    for at, i in enumerate(placed):
        if codes[i] != codes[placed[start]]:
            ends[start] = at
            start = at
        group[i], where[i] = start, at
    ends[start] = n
    last = n - 1
    while last >= 0:
        current = group[placed[last]]
        members = sorted(placed[current : last + 1])
        length = context[members[0]]
        leaning: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= current:
                p = before[p]
            before[i] = p
            if p >= 0:
                leaning[p] = leaning.get(p, 0) + 1
        parts: dict[tuple[int, int], list[int]] = {}
        for p, times in leaning.items():
            parts.setdefault((times, group[p]), []).append(p)
        for times, old in sorted(parts, reverse=True):
            part = parts[times, old]
            end = ends[old]
            new = end - len(part)
            inside = [p for p in part if where[p] >= new]
            if len(inside) < len(part):
                taken = {where[p] for p in inside}
                free = (at for at in range(new, end) if at not in taken)
                for p in part:
                    if where[p] < new:
                        at = next(free)
                        other, hole = placed[at], where[p]
                        placed[at], where[p] = p, at
                        placed[hole], where[other] = other, hole
            if new > old:
                ends[old], ends[new] = new, end
            for p in part:
                group[p] = new
                context[p] += times * length
        last = current - 1
    return context


def _modular_powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        step = min(filled, n - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(base, filled, prime)) % np.uint64(prime)
        filled += step
    return out


class Extensions:
    """Longest common extensions of positions of a word sequence, to the right and to the left."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums, self.powers = [], []
        for prime, base in zip(PRIMES, _BASES, strict=True):
            power = _modular_powers(base, self.n + 1, prime)
            terms = (codes.astype(np.uint64) + np.uint64(1)) * power[:-1] % np.uint64(prime)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))
            self.powers.append(power)

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the `size` words at a and at b (a <= b) have equal sums in both fields."""
        alike = np.ones(len(a), bool)
        for prime, sums, power in zip(PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            left, right = (sums[a + size] - sums[a]) % p, (sums[b + size] - sums[b]) % p
            alike &= left * power[b - a] % p == right
        return alike

    def _longest(self, limit: np.ndarray, test: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros(len(limit), np.int64), limit.copy()
        while (low < high).any():
            middle = (low + high + 1) >> 1
            good = test(middle)
            low, high = np.where(good, middle, low), np.where(good, high, np.minimum(high, middle - 1))
        return low

    def right(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._longest(self.n - b, lambda size: self.same(a, b, size))

    def left(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common length of the words that end before a and before b."""
        return self._longest(a.copy(), lambda size: self.same(a - size, b - size, size))


def _checked(codes: np.ndarray, start: int, end: int, period: int, root: int) -> tuple[int, int]:
    """Start and end of the run, found again word by word where equal sums misled."""
    if (codes[start : end - period] == codes[start + period : end]).all():
        return start, end
    equal = codes[:-period] == codes[period:]
    right = np.flatnonzero(~equal[root:])
    left = np.flatnonzero(~equal[:root])
    return int(left[-1]) + 1 if len(left) else 0, period + (root + int(right[0]) if len(right) else len(equal))


def segment_runs(words: Words, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    seen: dict[bytes, int] = {}
    codes = [seen.setdefault(w, len(seen)) for w in words]
    values = np.array(codes, np.int64)
    extensions = Extensions(values)
    found: dict[tuple[int, int], int] = {}
    for order in (codes, (len(seen) - 1 - values).tolist()):
        period = np.array(lyndon_array(order), np.int64)
        at = np.flatnonzero((period * min_exponent <= len(codes)) & (np.arange(len(codes)) + period < len(codes)))
        period = period[at]
        left, right = extensions.left(at, at + period), extensions.right(at, at + period)
        length = left + period + right
        for k in np.flatnonzero(length >= np.maximum(min_length, min_exponent * period)).tolist():
            p = int(period[k])
            start = int(at[k] - left[k])
            if (start, p) not in found:
                start, end = _checked(values, start, start + int(length[k]), p, int(at[k]))
                if end - start >= max(min_length, min_exponent * p):
                    found[start, p] = end - start
    return [(start, length, p) for (start, p), length in found.items()]


def repeated_segments(words: Words, gram: int, min_length: int) -> list[tuple[int, int]]:
    """Stretches of at least min_length words that are all covered by grams found more than once in the text."""
    if len(words) < min_length:
        return []
    grams = gram_hashes(np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64), gram)
    order = np.argsort(grams)
    ranked = grams[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return []
    again = np.zeros(len(grams) + 1, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(step, at, 1)
    np.add.at(step, at + gram, -1)
    inside = np.concatenate([[0], (np.cumsum(step[:-1]) > 0).astype(np.int8), [0]])
    edges = np.diff(inside)
    return [(int(a), int(b)) for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True) if b - a >= min_length]


def runs_of(words: Words, min_length: int = 24, min_exponent: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period.

    The gram is so short that each gram of a run comes again one period away: a run of length
    L >= 3q and L >= 24 has L >= 2q + 8.
    """
    gram = min(GRAM, max(1, min_length // min_exponent))
    out = []
    for a, b in repeated_segments(words, gram, min_length):
        out.extend((a + start, length, period) for start, length, period in segment_runs(words[a:b], min_length, min_exponent))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    drop = np.cumsum(step[:-1]) > 0
    return [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]


def periodic_runs(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_length: int = 24, min_exponent: int = 3,
                  prepare: Callable[[object, Words], Words] | None = None) -> DataFrame:
    """For each row: key, n_words, runs (start, length, period of every run), collapsed (text with each run cut to one period).

    Words are runs of characters other than [\\x20\\x09-\\x0D]. min_exponent is 3 at least. `prepare` may change a text's
    words before the search.
    """
    if min_exponent < 3:
        raise ValueError("runs of an exponent below 3 are not searched for")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, offsets, flat, texts = [], [0], [], []
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                if prepare is not None:
                    words = prepare(k, words)
                runs = runs_of(words, min_length, min_exponent)
                counts.append(len(words))
                flat.extend(runs)
                offsets.append(len(flat))
                texts.append(b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass"))
            values = np.array(flat, np.int64).reshape(-1, 3)
            structs = pa.StructArray.from_arrays([pa.array(values[:, i]) for i in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs),
                 pa.array(texts, pa.string())], ["key", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return rows.mapInArrow(search, schema).withColumnRenamed("key", key)
