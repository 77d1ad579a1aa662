"""Periodic runs of words: stretches in which words a fixed distance apart are equal.

A run of period ``q`` is a maximal stretch in which every word equals the word ``q`` places
on, ``q`` is its smallest period, and its length is at least ``max(MIN_WORDS, MIN_REPEATS * q)``.

Method: a run of at least four periods covers a block of ``q`` equal words at some multiple of
``2 q``.  So all (period, grid point) pairs of this harmonic grid, n log n / 2 of them, are
laid out in NumPy arrays; prefix hashes of the words (modulo two primes) compare the blocks of
all pairs at once, and the longest common extensions of those that agree, forwards and
backwards, are found by one binary search over all of them.  Hashes never miss a run; every run
found is then verified word by word, and measured by words where a hash had been wrong.  Of
equal stretches the smallest period stays.  Long texts are worked off in blocks of pairs.

Defined cases: a null text and one without a word have no run; very long texts are read
whole; repeated rows are treated alike; an empty table gives an empty result; columns of any
name may be present (``keep`` names those that are returned).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_REPEATS = 6, 4
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Primes below 2 ** 31 and bases of the two prefix hashes.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)
RUN = ("start", "length", "period")
#: Pairs worked on at once.
BLOCK = 1 << 19


class Prefixes:
    """Hashes of all stretches of ``ids`` from prefix sums of id x base ** place."""

    def __init__(self, ids: np.ndarray) -> None:
        n = len(ids)
        self.powers, self.sums = [], []
        for prime, base in zip(PRIMES, BASES):
            power, step = np.ones(n + 1, dtype=np.int64), base
            done = 1
            while done <= n:  # doubling: the powers known, times the next one
                more = min(done, n + 1 - done)
                power[done : done + more] = power[:more] * step % prime
                done, step = done + more, step * step % prime
            total = np.zeros(n + 1, dtype=np.int64)
            np.cumsum((ids + 1) % prime * power[:n] % prime, out=total[1:])
            self.powers.append(power)
            self.sums.append(total % prime)

    def equal(self, at: np.ndarray, by: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Stretches of ``length`` words at ``at`` and ``at + by`` have the same hash."""
        out = np.ones(len(at), dtype=bool)
        for prime, power, total in zip(PRIMES, self.powers, self.sums):
            left = (total[at + length] - total[at]) % prime * power[by] % prime
            out &= left == (total[at + by + length] - total[at + by]) % prime
        return out


def _longest(most: np.ndarray, holds) -> np.ndarray:
    """By element: the largest length up to ``most`` for which ``holds`` (monotone, true at 0)."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        middle = (low + high + 1) // 2
        fits = holds(middle)
        low = np.where(open_ & fits, middle, low)
        high = np.where(open_ & ~fits, middle - 1, high)
    return low


def _measured(ids: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The stretch of period ``q`` about ``at`` by comparing words: (start, end)."""
    same = ids[:-q] == ids[q:]
    stop = np.flatnonzero(~same[at:])
    back = np.flatnonzero(~same[:at][::-1])
    return int(at - (back[0] if len(back) else at)), int(at + (stop[0] if len(stop) else len(same) - at)) + q


def _grid(n: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(period, grid point) pairs with 2 x period words from the point on, in blocks."""
    q = 1
    while q <= n // least:
        take = np.arange(q, n // least + 1)
        counts = n // (2 * take)
        upto = max(1, int(np.searchsorted(np.cumsum(counts), BLOCK, side="right")))
        take, counts = take[:upto], counts[:upto]
        period = np.repeat(take, counts)
        first = np.cumsum(counts) - counts
        yield period, (np.arange(len(period)) - np.repeat(first, counts)) * 2 * period
        q += upto


def find_runs(words: list[str], min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> np.ndarray:
    """Runs as rows (start, length, period), by start, then period.  ``min_repeats`` is 4 or more."""
    if min_repeats < 4:
        raise ValueError("the grid finds runs of four periods and more")
    n = len(words)
    if n < max(min_words, min_repeats):
        return np.zeros((0, 3), dtype=np.int64)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=n)
    prefixes, found = Prefixes(ids), []
    for period, point in _grid(n, min_repeats):
        near = ids[point] == ids[point + period]  # no block is equal whose first words differ
        period, point = period[near], point[near]
        hit = prefixes.equal(point, period, period)
        period, point = period[hit], point[hit]
        if not len(point):
            continue
        ahead = _longest(n - period - point, lambda m: prefixes.equal(point, period, m))
        behind = _longest(point.copy(), lambda m: prefixes.equal(point - m, period, m))
        start, end = point - behind, point + period + ahead
        long = end - start >= np.maximum(min_words, min_repeats * period)
        rows = np.stack([start, end, period, point], axis=1)[long]
        _, once = np.unique(rows[:, :3], axis=0, return_index=True)
        found.append(rows[once])
    periods: dict[tuple[int, int], list[int]] = {}
    points: dict[tuple[int, int, int], int] = {}
    for start, end, q, point in np.concatenate(found).tolist() if found else []:
        periods.setdefault((start, end), []).append(q)
        points[start, end, q] = point
    smallest: dict[tuple[int, int], int] = {}
    for (start, end), own in periods.items():
        for q in sorted(own):
            if (ids[start : end - q] == ids[start + q : end]).all():
                smallest[start, end] = min(q, smallest.get((start, end), q))
                break
            s, e = _measured(ids, points[start, end, q], q)  # a hash was wrong
            if e - s >= max(min_words, min_repeats * q):
                smallest[s, e] = min(q, smallest.get((s, e), q))
    out = [(s, e - s, q) for (s, e), q in smallest.items()]
    out.sort(key=lambda r: (r[0], r[2]))
    return np.array(out, dtype=np.int64).reshape(-1, 3)


def strongest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period (ties: smallest start, then period)."""
    if not len(runs):
        return None
    return tuple(min(runs.tolist(), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])))


def collapsed(words: list[str], runs: np.ndarray) -> list[str]:
    """The words that no run contains after its first period."""
    if not len(runs):
        return words
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return [w for w, inside in zip(words, np.cumsum(edge[:-1])) if not inside]


def periodic_runs(docs: DataFrame, text: Column | str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``row`` (struct of ``keep``), runs (array of start, length, period), best (the strongest, or null), collapsed (text)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, best, left = [], [], []
            for t in batch.column("text"):
                words = _WORD.findall(t.as_py()) if t.is_valid else []
                own = find_runs(words)
                runs.append([dict(zip(RUN, r)) for r in own.tolist()])
                strong = strongest(own)
                best.append(strong and dict(zip(RUN, strong)))
                left.append(" ".join(collapsed(words, own)))
            arrays = [batch.column("row"), pa.array(runs, pa.list_(kind)), pa.array(best, kind), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "runs", "best", "collapsed"])

    kind = pa.struct([(c, pa.int64()) for c in RUN])
    rows = docs.select(F.struct(*keep).alias("row"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    run = "struct<start:bigint,length:bigint,period:bigint>"
    return rows.mapInArrow(scan, f"row {rows.schema['row'].dataType.simpleString()}, runs array<{run}>, best {run}, collapsed string")
