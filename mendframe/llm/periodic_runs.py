"""Periodic runs of words, by online catching of squares at power-of-two blocks.

A run is a stretch of words with smallest period q that no neighbour extends. For
every size L = 1, 2, 4, ... each completed block of L words gets a catcher that
waits for the block's content to come again q = L .. 2L-1 words on. A catch is a
repeat of at least L words; comparing suffixes to its left and words to its right,
as far as words have been appended, makes it a stretch with period q. Stretches
of one place merge into the one with the smallest period.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mendframe.llm.common import map_batches, mixed, packed

EXPONENT = 4  # times that a run holds its period, at least
SHORTEST = 6  # words of a run, at least
APPENDED = 1 << 16  # words taken at once; bounds what one level compares at a time

_PRIME = np.int64((1 << 31) - 1)
_KEPT_POWERS = 1 << 16  # powers remembered between texts


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo the prime, by doubling."""
    made = np.ones(max(n, 1), np.int64)
    known = 1
    while known < n:
        more = min(known, n - known)
        made[known : known + more] = made[:more] * np.int64(pow(base, known, int(_PRIME))) % _PRIME
        known += more
    return made


@functools.lru_cache(maxsize=4)
def _remembered(base: int) -> np.ndarray:
    return _powers(base, _KEPT_POWERS)


def _first_powers(base: int, n: int) -> np.ndarray:
    return _remembered(base)[:n] if n <= _KEPT_POWERS else _powers(base, n)


class SquareCatcher:
    """Runs of a sequence of numbers to which more can be appended at any time.

    Equality of word sequences is judged by a 31-bit polynomial, which never misses
    an equal pair; ``runs`` compares what it reports word by word, and the sequence
    is read anew with another polynomial if that ever disagrees.
    """

    def __init__(self, exponent: int = EXPONENT, shortest: int = SHORTEST, attempt: int = 0) -> None:
        if exponent < 3:
            raise ValueError("catchers of this spacing find runs of three periods or more")
        self.exponent, self.shortest, self.attempt = exponent, shortest, attempt
        self.base = int(mixed(np.array([attempt + 1], np.uint64))[0] % np.uint64(int(_PRIME) - 1000)) + 500
        self.inverse = pow(self.base, int(_PRIME) - 2, int(_PRIME))
        self.words = np.zeros(0, np.int64)
        self.sums = np.zeros(1, np.int64)  # sums[i]: polynomial of the first i words
        self.caught_to: list[int] = []  # per level, the number of blocks whose catchers are through
        self.open = np.zeros((0, 3), np.int64)  # (start, end, period) that reach the last word
        self.closed: list[np.ndarray] = []

    def append(self, words: np.ndarray) -> None:
        """Take more words, as non-negative numbers, and advance every catcher."""
        for at in range(0, len(words), APPENDED):
            self._append(words[at : at + APPENDED].astype(np.int64))

    def _append(self, words: np.ndarray) -> None:
        old, self.words = len(self.words), np.concatenate([self.words, words])
        n = len(self.words)
        self.down = _first_powers(self.inverse, n + 1)
        drawn = (mixed(words.astype(np.uint64) + np.uint64(1 + self.attempt)) >> np.uint64(33)).astype(np.int64)
        terms = drawn * _first_powers(self.base, n)[old:] % _PRIME
        self.sums = np.concatenate([self.sums, (self.sums[-1] + np.cumsum(terms)) % _PRIME])
        again = self.open.copy()
        again[:, 1] += self._common_after(again[:, 1] - again[:, 2], again[:, 1])
        self._merge([again, *self._catches(last=False)])

    def _hashes(self, at: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) % _PRIME * self.down[at] % _PRIME

    def _catches(self, last: bool) -> list[np.ndarray]:
        """Stretches around new catches. ``last``: no word follows, so half-filled zones count too."""
        found, n, level = [], len(self.words), 0
        while (size := 1 << level) * 3 <= n:
            if level == len(self.caught_to):
                self.caught_to.append(0)
            done = self.caught_to[level]
            blocks = (n - 2 * size) // size + 1 if last else (n + 1) // size - 2  # zones with a word, or filled
            if blocks > done:
                first, past = done * size, min((blocks + 1) * size, n - size + 1)
                hashes = (self.sums[first + size : past + size] - self.sums[first:past]) % _PRIME * self.down[first:past] % _PRIME
                grid = np.full((blocks + 1 - done, size), -1, np.int64)
                grid.ravel()[: past - first] = hashes
                block, ahead = np.nonzero(grid[1:] == grid[:-1, :1])
                if len(block):
                    found.append(self._stretches((block + done) * size, size + ahead, size))
                self.caught_to[level] = blocks
            level += 1
        return found

    def _stretches(self, at: np.ndarray, period: np.ndarray, size: int) -> np.ndarray:
        """(start, end, period) around blocks that come again; a chain of blocks of one period is one catch."""
        order = np.lexsort((at, period))
        at, period = at[order], period[order]
        follows = np.zeros(len(at), bool)
        follows[1:] = (period[1:] == period[:-1]) & (at[1:] == at[:-1] + size)
        at, period = at[~follows], period[~follows]
        start = at - self._common_before(at, at + period)
        end = at + period + size
        return np.stack([start, end + self._common_after(end - period, end), period], axis=1)

    def _common_after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that agree from places a and b > a on, as far as words are known."""
        common, n = np.zeros(len(a), np.int64), len(self.words)
        for bit in reversed(range(n.bit_length() if len(a) else 0)):
            step = np.int64(1 << bit)
            fits = np.flatnonzero(b + common + step <= n)
            x, y = (a + common)[fits], (b + common)[fits]
            common[fits[self._hashes(x, step) == self._hashes(y, step)]] += step
        return common

    def _common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common suffix of what stands before places a < b."""
        common = np.zeros(len(a), np.int64)
        for bit in reversed(range(len(self.words).bit_length() if len(a) else 0)):
            step = np.int64(1 << bit)
            fits = np.flatnonzero(a - common - step >= 0)
            x, y = (a - common)[fits] - step, (b - common)[fits] - step
            common[fits[self._hashes(x, step) == self._hashes(y, step)]] += step
        return common

    def _merge(self, found: list[np.ndarray]) -> None:
        """Keep one stretch per place, that of the smallest period; the ones that end at the last word stay open."""
        if not any(len(x) for x in found):
            self.open = self.open[:0]
            return
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
        grows = rows[:, 1] == len(self.words)
        # a stretch under two periods may share its place with unrelated ones, so only true squares merge
        square = rows[:, 1] - rows[:, 0] >= 2 * rows[:, 2]
        self.open = rows[grows & (new | ~square)]
        ended = rows[new & ~grows]
        self.closed.append(ended[self._long(ended)])

    def _long(self, rows: np.ndarray) -> np.ndarray:
        length = rows[:, 1] - rows[:, 0]
        return length >= np.maximum(self.shortest, self.exponent * rows[:, 2])

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run so far, by start, then period."""
        pending, caught = self.open.copy(), list(self.caught_to)
        rows = [*self.closed, pending[self._long(pending)]]
        rows += [x[self._long(x)] for x in self._catches(last=True)]
        self.caught_to = caught  # words may still follow
        best: dict[tuple[int, int], int] = {}
        for start, end, period in np.concatenate(rows).tolist():
            best[start, end] = min(period, best.get((start, end), period))
        if not all(self._true(*place, period) for place, period in best.items()):
            other = SquareCatcher(self.exponent, self.shortest, self.attempt + 1)
            other.append(self.words)
            return other.runs()
        return sorted((start, end - start, period) for (start, end), period in best.items())

    def _true(self, start: int, end: int, period: int) -> bool:
        x = self.words
        return bool(
            (x[start : end - period] == x[start + period : end]).all()
            and (start == 0 or x[start - 1] != x[start + period - 1])
            and (end == len(x) or x[end] != x[end - period])
        )


def runs_of(words: list[bytes], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a list of words."""
    if len(words) < shortest:
        return []
    numbers: dict[bytes, int] = {}
    catcher = SquareCatcher(exponent, shortest)
    catcher.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    return catcher.runs()


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept).tolist()] if runs else words


_RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
_FOUND = [
    T.StructField("runs", T.ArrayType(_RUN)), T.StructField("n_words", T.LongType()), T.StructField("collapsed", T.StringType())
]


def find_runs(rows: DataFrame, text: Column, exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """Every row as ``_in`` with its ``runs``, the word count ``n_words`` and the text without repeats, ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+`` and compared as they are. A text belongs to one
    row and one task, whatever its length; memory is some hundred bytes a word. A NULL
    or blank text has no runs and collapses to empty text. Repeated rows are judged
    each for itself; the caller's columns, whatever their names, stay inside ``_in``.
    """
    work = packed(rows, text=text)
    made = T.StructType([work.schema["_in"], *_FOUND])
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, counts, left = [], [], []
        for value in batch.column("text").to_pylist():
            words = value.encode().split() if value else []
            runs = runs_of(words, exponent, shortest)
            found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            counts.append(len(words))
            left.append(b" ".join(without_repeats(words, runs)).decode())
        return pa.RecordBatch.from_arrays(
            [batch.column("_in"), pa.array(found, run_type), pa.array(counts, pa.int64()), pa.array(left, pa.string())],
            ["_in", "runs", "n_words", "collapsed"],
        )

    return map_batches(work, judge, made)


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period; of equals the earliest, then that of the smallest period."""

    def better(best: Column, run: Column) -> Column:
        gain = run["length"] * best["period"] - best["length"] * run["period"]
        return F.when(best.isNull() | (gain > 0), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast(_RUN), better)


def digest_runs(rows: DataFrame, text: Column) -> DataFrame:
    """Per row its id, the number of runs, the strongest run and digests of all runs and of the collapsed text."""
    needed = rows.select(F.col("doc_id"), text.alias("text"))
    found = find_runs(needed, F.col("text")).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        F.col("_in.doc_id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_tails(text: Column, doc_id: Column) -> Column:
    """The text, its tail made periodic in one document of ten, as drawn from the id (NULL: empty text).

    h = crc32(id): if h % 10 = 0, word i >= a becomes word a + (i - a) % p, with
    g = h div 10, a = g % n and p = 1 + (n - a) div (3 + g % 8). Other texts stay as they are.
    """
    draw = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    words = F.array_remove(F.split(spaced, " "), "")
    g = F.floor(draw / 10)

    def tail(split: Column) -> Column:
        n = F.size(split)
        a = (g % n).cast("int")
        period = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % period)
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(split, place(i))), " ")

    # the list is bound once by the outer transform, not split again for every word
    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(F.lit(""))), F.lit(0))
    return F.when(draw % 10 == 0, planted).otherwise(text)
