"""Periodic run detection: online dyadic square catching.

A run is a stretch of words with smallest period q that is at least ``max(LEAST, TIMES * q)`` words long and that no
neighbouring word extends.  ``Catchers`` reads words in the order of the text.  For every b = 8, 16, 32, ... each completed
block of b words (starting at a multiple of b) is a catcher of the squares with periods from b to 2b - 1 (the smallest ones also of
1 to 7): when a word is appended, the suffix of b words that it completes is compared with the block that is then in reach, by
fingerprints of whole blocks.  A run of period q repeats more than 2q words q places later, so one of its blocks
is caught.  A hit opens a suffix comparison for that period, checked word by word back to where it begins and carried on by every
appended word until one differs; squares of one period that touch merge into one run.  Stretches that a
known run explains (its period divides theirs) are not compared again.  Appending is done for many words at once, so
all fingerprints of a level are compared together; appending one by one gives the same runs.

Work is proportional to words times levels (the longest period is a third of a text), and to the lengths of squares.
Words are told apart by 64-bit hashes; fingerprints only nominate, words decide.

Defined cases: a null or empty text has no words and no run; a null doc_id counts as the text '' for the check sum; each row
is judged alone, so repeated rows get equal values; an empty table gives no rows; very long texts are
split into words piece by piece; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import mapped, parts, table, texts
from ._words import pieces, word_hashes

#: Words and periods that a run has at least.
LEAST, TIMES = 24, 3
#: Words of the smallest block.
BLOCK = 8
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base of the fingerprints and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(n - 1, 1).bit_length()
            for name, base in (("up", _BASE), ("down", _BACK)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


class Catchers:
    """Finds runs in the words appended so far; ``runs`` closes the text and returns (start, length, period), sorted."""

    def __init__(self, least: int = LEAST, times: int = TIMES):
        self.powers, self.least, self.times = _Powers(), least, times
        self.words = np.zeros(0, np.uint64)
        self.sums = np.zeros(1, np.uint64)  # sums[i]: words before i, each times its power
        self.open: dict[int, tuple[int, int]] = {}  # period -> (start, end) of the stretch whose comparison still holds
        self.closed: dict[tuple[int, int], int] = {}  # (start, end) -> smallest period
        self.cover = np.zeros(0, np.int32)  # a period known at each place (0: none) ...
        self.until = np.zeros(0, np.int64)  # ... and where its stretch ends

    def append(self, words: np.ndarray, since: Callable[[int], int] = lambda b: 0) -> None:
        """Append words; squares of periods from b on are only sought from ``since(b)`` on."""
        old, n = len(self.words), len(self.words) + len(words)
        if n == old:
            return
        up, down = self.powers.get(n + 1)
        self.words = np.concatenate([self.words, words])
        self.sums = np.concatenate([self.sums, self.sums[-1] + np.cumsum(words * up[old:n], dtype=np.uint64)])
        self.cover = np.concatenate([self.cover, np.zeros(len(words), np.int32)])
        self.until = np.concatenate([self.until, np.zeros(len(words), np.int64)])
        for period, (start, end) in sorted(self.open.items()):
            if end == old:
                self._advance(period, start, end)
        b = BLOCK
        while 3 * b <= n or b == BLOCK:
            first, last = max(old - b + 1, since(b), 0), n - b
            if first <= last:
                self._level(b, first, last, down)
            b *= 2

    def _level(self, b: int, first: int, last: int, down: np.ndarray) -> None:
        """Compare the suffixes that start at first..last with the catchers of b words in reach."""
        base = max(first // b - 1, 0) * b  # the earliest block that is met
        prints = (self.sums[base + b : last + b + 1] - self.sums[base : last + 1]) * down[base : last + 1]
        blocks = prints[::b]
        own = prints[first - base :]
        places = np.arange(first, last + 1)
        for back in (0, 1) if b == BLOCK else (1,):
            at = places // b - base // b - back  # the block's number
            hit = np.flatnonzero((blocks[np.maximum(at, 0)] == own) & (at >= 0))
            if not len(hit):
                continue
            begin = (at[hit] + base // b) * b
            period = places[hit] - begin
            begin, period = begin[period > 0], period[period > 0]
            known = self.cover[begin]
            told = (known > 0) & (period % np.maximum(known, 1) == 0) & (self.until[begin] >= begin + period + b)
            begin, period = begin[~told], period[~told]
            for k in np.lexsort((begin, period)).tolist():
                self._caught(int(begin[k]), int(period[k]), b)

    def _caught(self, begin: int, period: int, b: int) -> None:
        """The block of b words at ``begin`` seems to come again ``period`` words later."""
        now = self.open.get(period)
        if now and now[0] <= begin and begin + period + b <= now[1]:
            return  # the comparison that is open went over it
        known = int(self.cover[begin])
        if known and period % known == 0 and self.until[begin] >= begin + period + b:
            return
        w = self.words
        if not np.array_equal(w[begin : begin + b], w[begin + period : begin + period + b]):
            return  # equal fingerprints of different words
        start, step = begin, 16
        while start:  # back to the first of the words that agree
            low = max(start - step, 0)
            same = w[low:start] == w[low + period : start + period]
            if not same.all():
                start = low + int(np.flatnonzero(~same)[-1]) + 1
                break
            start, step = low, step * 2
        self._advance(period, start, begin + period + b)

    def _advance(self, period: int, start: int, end: int) -> None:
        """Carry a suffix comparison on over the words that are there; close it where one differs."""
        w, n, step = self.words, len(self.words), 16
        came = self.open.pop(period, None)
        if came and came[0] != start:
            self._close(period, *came)
        while end < n:
            high = min(end + step, n)
            same = w[end:high] == w[end - period : high - period]
            if not same.all():
                end += int(np.flatnonzero(~same)[0])
                self._close(period, start, end)
                return
            end, step = high, step * 2
        self.open[period] = start, end
        self._mark(period, start, end)

    def _mark(self, period: int, start: int, end: int) -> None:
        if end - start >= 2 * period:
            new = (self.cover[start:end] == 0) | (self.until[start:end] < end)
            self.cover[start:end][new] = period
            self.until[start:end][new] = end

    def _close(self, period: int, start: int, end: int) -> None:
        self._mark(period, start, end)
        if end - start >= max(self.least, self.times * period):
            self.closed[start, end] = min(period, self.closed.get((start, end), period))

    def runs(self) -> list[tuple[int, int, int]]:
        for period, (start, end) in self.open.items():
            self._close(period, start, end)
        self.open = {}
        return sorted((start, end - start, period) for (start, end), period in self.closed.items())


def runs_of(texts_: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs of each of several texts (arrays of hashes of words).

    The texts follow each other in one sequence, short ones first, with a word between them that occurs nowhere else; a level
    starts at the first text that is long enough for its periods.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts_]
    order = sorted((i for i in range(len(texts_)) if len(texts_[i]) >= LEAST), key=lambda i: len(texts_[i]))
    if not order:
        return out
    rng = np.random.default_rng(12)
    between = rng.integers(0, 1 << 63, len(order), dtype=np.uint64)
    lengths = np.array([len(texts_[i]) for i in order])
    ends = np.cumsum(lengths + 1)
    starts = ends - lengths - 1
    everything = np.empty(ends[-1], np.uint64)
    for k, i in enumerate(order):
        everything[starts[k] : ends[k] - 1] = texts_[i]
        everything[ends[k] - 1] = between[k]

    def since(b: int) -> int:
        k = int(np.searchsorted(lengths, TIMES * b if b > BLOCK else 0))
        return int(starts[k]) if k < len(starts) else len(everything)

    found = Catchers()
    found.append(everything, since)
    for start, length, period in found.runs():
        k = int(np.searchsorted(starts, start, side="right")) - 1
        out[order[k]].append((start - int(starts[k]), length, period))
    return out



def reordered(n: int, doc_id: int | None) -> np.ndarray | None:
    """Places of the words that a tenth of the documents have instead of their own; None: their own."""
    h = zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period; ties: smallest start, then period."""
    top = None
    for start, length, period in runs:  # sorted by start
        if top is None or (more := length * top[2] - top[1] * period) > 0 or (more == 0 and (start, period) < (top[0], top[2])):
            top = start, length, period
    return top


def left(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    gone = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return np.cumsum(gone[:n]) == 0


def spoken(text: bytes) -> Iterator[list[bytes]]:
    for piece in pieces(text):
        yield piece.split()


def described(made: list[bytes], ids: list[int | None]) -> list[tuple]:
    """For each text: n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words, n_dropped."""
    hashes, sizes = word_hashes().of(made)
    ends = np.cumsum(sizes)
    orders = [reordered(n, doc) for n, doc in zip(sizes.tolist(), ids, strict=True)]
    arrays = []
    for n, end, places in zip(sizes.tolist(), ends.tolist(), orders, strict=True):
        own = hashes[end - n : end]
        arrays.append(own if places is None else own[places])
    out = []
    for text, n, places, runs in zip(made, sizes.tolist(), orders, runs_of(arrays), strict=True):
        sha, dropped = hashlib.sha256(), 0
        if places is None and not runs:
            first = True
            for words in spoken(text):
                if words:
                    sha.update(b"" if first else b" ")
                    sha.update(b" ".join(words))
                    first = False
        else:
            words = [w for some in spoken(text) for w in some]
            stay = np.flatnonzero(left(n, runs))
            dropped = n - len(stay)
            stay = (stay if places is None else places[stay]).tolist()
            for at in range(0, len(stay), 1 << 16):
                sha.update(b" " * (at > 0) + b" ".join([words[i] for i in stay[at : at + (1 << 16)]]))
        listed = hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest()
        top = best(runs)
        figures = (None,) * 4 if top is None else (*top, 1000 * top[1] // top[2])
        out.append((len(runs), *figures, listed, sha.hexdigest(), n, dropped))
    return out


_COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words", "n_dropped")


def find(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of ``described``, one row for each row of ``docs``."""

    def run(batches):
        for batch in (part for whole in batches for part in parts(whole)):
            rows = described(texts(batch), batch.column("doc_id").to_pylist())
            columns = [pa.array(c, pa.string() if name.endswith("sha256") else pa.int64()) for name, c in zip(_COLUMNS, zip(*rows, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *_COLUMNS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, run, "doc_id long, " + ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in _COLUMNS))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
