"""Benchmark decontamination: pigeonhole pieces, then Myers bit-parallel edit distance."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from mendframe.llm.common import BATCH_ROWS

ERROR_RATE = 0.05  # edits allowed per character of an item
BLOCK_CHARS = 8 << 20  # characters of items that one pass over the documents holds

_blank = re.compile(r"\s+")
_MATCH = "item_id long, distance int, match_start long, match_end long"


def normalised(text: str | None) -> str:
    """Lower-case text with every run of white space as one blank."""
    return _blank.sub(" ", (text or "").lower()).strip()


def budget(item: str, error_rate: float = ERROR_RATE) -> int:
    return math.floor(len(item) * error_rate)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): edits + 1 pieces, of which any match within the budget holds one unchanged."""
    edges = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


class Pattern:
    """Finds where a text comes closest to an item, one bit per character of the item."""

    def __init__(self, item: str) -> None:
        self.length = len(item)
        self.all = (1 << self.length) - 1
        self.top = 1 << (self.length - 1)
        self.at: dict[str, int] = defaultdict(int)
        for i, letter in enumerate(item):
            self.at[letter] |= 1 << i
        self.at = dict(self.at)

    def closest(self, text: str) -> tuple[int, int]:
        """(edits, end) of the substring of ``text`` nearest to the item, the earliest of equals."""
        plus, minus, score = self.all, 0, self.length
        best, best_end = score, 0
        get, everything, top = self.at.get, self.all, self.top
        for end, letter in enumerate(text, 1):
            equal = get(letter, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (everything & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = up << 1, down << 1  # a match may start anywhere: no carry into the first row
            plus = everything & (down | ~(vertical | up))
            minus = up & vertical & everything
            if score < best:
                best, best_end = score, end
        return best, best_end


class Matcher:
    """All items of one block behind one automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float) -> None:
        self.items = items
        self.edits = [budget(text, error_rate) for _, text in items]
        self.patterns: dict[int, Pattern] = {}
        where = defaultdict(list)
        for number, (_, text) in enumerate(items):
            for offset, piece in pieces(text, self.edits[number]):
                where[piece].append((number, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in where.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item number, edits, start, end) of the best match of each item within its budget.

        Windows around the piece hits of an item that overlap are one window, so
        no stretch of text is read twice for an item.
        """
        hits: dict[int, set[tuple[int, int]]] = defaultdict(set)
        for last, (length, found) in self.automaton.iter(text):
            first = last - length + 1
            for number, offset in found:
                edits, size = self.edits[number], len(self.items[number][1])
                hits[number].add((max(0, first - offset - edits), first - offset + size + edits))
        for number in sorted(hits):
            best: tuple[int, int, int] | None = None
            for low, high in _merged(hits[number]):
                match = self._verified(number, text, low, high)
                if match and (best is None or match < best):
                    best = match
                if best and best[0] == 0:
                    break
            if best:
                yield number, *best

    def _verified(self, number: int, text: str, low: int, high: int) -> tuple[int, int, int] | None:
        item = self.items[number][1]
        exact = text.find(item, low, high)
        while exact >= 0:
            if self.edits[number] or _whole(text, exact, exact + len(item)):
                return 0, exact, exact + len(item)
            exact = text.find(item, exact + 1, high)
        if not self.edits[number]:
            return None
        pattern = self.patterns.get(number) or self.patterns.setdefault(number, Pattern(item))
        edits, end = pattern.closest(text[low:high])
        if edits > self.edits[number]:
            return None
        reverse = Pattern(item[::-1])
        _, back = reverse.closest(text[max(0, low + end - len(item) - edits) : low + end][::-1])
        return edits, low + end - back, low + end


def _merged(windows: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Windows from left to right, overlapping ones as one."""
    start = stop = None
    for low, high in sorted(windows):
        if stop is None or low > stop:
            if stop is not None:
                yield start, stop
            start, stop = low, high
        else:
            stop = max(stop, high)
    if stop is not None:
        yield start, stop


def _whole(text: str, start: int, end: int) -> bool:
    """Whether a match starts and ends at the edges of words."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (
        end < len(text) and text[end].isalnum() and text[end - 1].isalnum()
    )


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """(id, normalised text) of all items, in blocks of bounded size."""
    block, size, current, seen = [], 0, None, set()
    rows = benchmark.where("item_id is not null").select("item_id", "text").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator(prefetchPartitions=False):
        text = normalised(row["text"])
        if row["item_id"] != current:
            current, seen = row["item_id"], set()
        if not text or text in seen:
            continue
        seen.add(text)
        block.append((current, text))
        size += len(text)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """(doc_id, item_id, distance, match_start, match_end): the best match of each item in each document.

    Documents and items are compared lower-case with single blanks. An item of n
    characters may differ in floor(error_rate * n) edits. It is split into one more
    piece than that; where a document holds a piece unchanged, Myers' bit-parallel
    automaton measures the distance around it. Spans count characters of the
    normalised document. Items too short for any edit must match whole words.

    Items are sent to the tasks in blocks of ``block_chars``; the documents are read
    once per block and only their ids are given out, so nothing is shuffled. NULL and
    empty texts match nothing; an item without text or id is no item; repeated
    documents are reported once each; items with the same id are reported by id and
    text. Empty tables give no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", "text")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    found: DataFrame | None = None
    for block in _blocks(benchmark, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, error_rate)
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(start, BATCH_ROWS)
                    at, rows = [], []
                    for i, text in enumerate(part.column(1)):
                        for number, edits, low, high in matcher.matches(normalised(text.as_py())):
                            at.append(i)
                            rows.append((matcher.items[number][0], edits, low, high))
                    if rows:
                        item, edits, low, high = zip(*rows)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(at)), pa.array(item, pa.int64()), pa.array(edits, pa.int32()),
                             pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                            ["doc_id", "item_id", "distance", "match_start", "match_end"],
                        )

        hits = keyed.mapInArrow(search, f"doc_id {kind}, {_MATCH}")
        found = hits if found is None else found.unionByName(hits)
    return found if found is not None else spark.createDataFrame([], f"doc_id {kind}, {_MATCH}")


def contaminated(docs: DataFrame, benchmark: DataFrame, flag: str = "_contaminated", **options) -> DataFrame:
    """``docs`` plus a flag: whether the row's own text holds any item; decided in one pass, without a join."""
    rows = docs.withColumn(flag, F.lit(False))
    for block in _blocks(benchmark, options.get("block_chars", BLOCK_CHARS)):
        holds = _holds(docs.sparkSession.sparkContext.broadcast(block), options.get("error_rate", ERROR_RATE))
        rows = rows.withColumn(flag, F.col(flag) | holds(F.col("text")))
    return rows


def _holds(sent: Broadcast, error_rate: float):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        matcher = Matcher(sent.value, error_rate)
        return pd.Series([any(True for _ in matcher.matches(normalised(x))) for x in texts], dtype=bool)

    return holds
