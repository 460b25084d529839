"""Brown class-based bigrams: distributed exchange clustering and text scoring."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from mendframe.functions import tables
from mendframe.llm.common import ascii_words, flat_words, fold  # noqa: F401 (tests take ascii_words from here)

FOLDS, HELD_OUT = 7, 2
END = b"\n"  # ends every text; no word holds white space
CLASSES = 64  # classes among which words are exchanged
CLUSTERED = 4_096  # most frequent words, exchanged by both neighbours; all others by the word before
DICTIONARY = 200_000  # most frequent words whose counts every task holds
LONGEST = 64  # bytes of a word in the dictionary; with DICTIONARY this bounds what is broadcast
ROUNDS = 6
REST_ROUNDS = 2  # rounds of the words outside the most frequent after their first choice
BLOCK = 64  # clustered words whose statistics travel together
COUNTED = 4_000_000  # tokens a task counts before it gives its counts out
FLUSH = 1_500_000  # words outside whose contexts a task counts before it gives them out
BATCH_ROWS = 10_000  # rows of text that a task looks at together, at most
CHUNK = 2_000_000  # bytes of text that a task looks at together, about
LOOKED_UP = 1_200_000  # words that a task looks up at once, as each time the dictionary is hashed anew
CELLS = 2_048  # cells of words that are weighed together
SHORT = 64  # sizes up to this have their logarithms in a table
FEW = 8  # as do the cells of words with counts up to this
PRIOR = 20.0  # observations that the class distribution is worth against the transitions

PUNCTUATION, SCRIPTS, LENGTHS = 4, 8, 3
SHAPES = PUNCTUATION * SCRIPTS * LENGTHS
LETTERS = CLASSES + 1 + SHAPES  # all classes: exchanged, end of text, shapes; a byte holds one


# by the last byte: a letter, a digit or non-ASCII; a full stop; a comma; anything else
_ENDINGS = np.array(
    [SCRIPTS * LENGTHS * (0 if b > 127 or chr(b).isalnum() else 1 if b == 46 else 2 if b == 44 else 3) for b in range(256)], np.int64
)


def shapes(words: pa.Array) -> np.ndarray:
    """What unseen words are told by, and any but the most frequent as the word before: ending, first non-ASCII letter, length."""
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[: edges[-1]] if len(words) else np.zeros(0, np.uint8)
    first, past = edges[:-1], edges[1:]
    size = past - first
    found = _ENDINGS[data[past - 1]] + (size > 7) + (size > 12)
    foreign = np.append(np.flatnonzero(data > 127), len(data))
    at = foreign[np.searchsorted(foreign, first)]
    told = np.flatnonzero(at < past)
    letter = data[at[told]].astype(np.int64) * 31 + data[at[told] + 1]
    found[told] += (1 + letter % (SCRIPTS - 1)) * LENGTHS
    return found


def shape(word: bytes) -> int:
    """The shape of one word."""
    return int(shapes(pa.array([word], pa.binary()))[0])


def _strings(words: list[bytes]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _runs(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, words of all rows in lower case, words of each row) of runs of rows; a long text is a run of its own."""
    for start in range(0, len(texts), BATCH_ROWS):
        part = texts.slice(start, BATCH_ROWS)
        reach = np.cumsum(pc.fill_null(pc.binary_length(part), 0).to_numpy().astype(np.int64))
        edges = [0, *(np.flatnonzero(np.diff(reach // CHUNK)) + 1).tolist(), len(part)]
        for low, high in zip(edges, edges[1:]):
            yield start + low, *flat_words(pc.ascii_lower(part.slice(low, high - low)))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over whole texts, the end of each text counted as a word; NULL counts as empty text."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, rows = [], 0, 0
        for batch in batches:
            for _, flat, lengths in _runs(batch.column(0)):
                held.append(flat)
                size, rows = size + len(flat), rows + len(lengths)
                if size > COUNTED:
                    yield given(held, rows)
                    held, size, rows = [], 0, 0
        if rows:
            yield given(held, rows)

    def given(held: list[pa.Array], rows: int) -> pa.RecordBatch:
        found = pa.chunked_array(held, pa.string()).value_counts()
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([found.field(0), _strings([END])]), pa.concat_arrays([found.field(1), pa.array([rows], pa.int64())])],
            ["word", "n"],
        )

    counted = texts.select("text").mapInArrow(tally, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("c"))


def _tokens(texts: pa.Array, words: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
    """(first row, tokens of each row, units of all, their words outside) of runs of rows.

    A unit is the place of a word in ``words``, where END is first, and behind them all the shape of a word outside.
    """

    def looked_up() -> Iterator[tuple[int, pa.Array, np.ndarray, pa.Array]]:
        held, size = [], 0
        for run in _runs(texts):
            held.append(run)
            size += len(run[1])
            if size > LOOKED_UP:
                yield from found_in(held)
                held, size = [], 0
        if held:
            yield from found_in(held)

    def found_in(held: list[tuple[int, pa.Array, np.ndarray]]) -> Iterator[tuple[int, pa.Array, np.ndarray, pa.Array]]:
        found = pc.index_in(pa.chunked_array([flat for _, flat, _ in held]), value_set=words).combine_chunks()
        at = 0
        for first, flat, lengths in held:
            yield first, flat, lengths, found.slice(at, len(flat))
            at += len(flat)

    for first, flat, lengths, found in looked_up():
        missing = pc.is_null(found)
        missed = flat.filter(missing)
        inner = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        inner[np.flatnonzero(missing.to_numpy(zero_copy_only=False))] = shapes(missed) + len(words)
        lengths = lengths + 1
        units, inside = np.zeros(len(flat) + len(lengths), np.int64), np.ones(len(flat) + len(lengths), bool)
        inside[np.cumsum(lengths) - 1] = False
        units[inside] = inner
        yield first, lengths, units, missed


@dataclass
class Model:
    """Everything of bounded size that scoring needs; counts and classes of rarer words stay in ``placed``."""

    vocabulary: DataFrame  # (word, c), all words
    placed: DataFrame  # (word, c, class), all but the clustered words
    tokens: int
    types: int
    words: list[bytes]  # the dictionary, most frequent first
    counts: np.ndarray  # of the dictionary
    classes: np.ndarray  # of the clustered words
    chosen: np.ndarray  # classes of the other words of the dictionary
    transitions: np.ndarray  # counts of (class or shape of the word before, class)
    unseen: np.ndarray  # counts of (class or shape of the word before, shape) over the words that occur once
    lone_types: np.ndarray  # words that occur once, by shape

    def log_transitions(self) -> np.ndarray:
        """log10 P(class | word before), drawn towards the distribution of classes.

        Unseen words, by their shapes, are as likely as words that were seen once (Good-Turing).
        """
        counts = self.transitions.copy()
        counts[:, CLASSES + 1 :] += self.unseen
        seen = counts.sum(axis=0) + 1.0
        base = seen / seen.sum()
        rows = counts.sum(axis=1, keepdims=True)
        return np.log10((counts + PRIOR * base) / (rows + PRIOR))

    def class_log(self) -> np.ndarray:
        """log10 of what the words of a class share: its tokens; for shapes as many unseen words as occur once, and one."""
        return np.log10(np.concatenate((np.maximum(self.transitions.sum(axis=0)[: CLASSES + 1], 1.0), self.lone_types + 1.0)))

    def word_classes(self) -> np.ndarray:
        """Class of every dictionary word, then of the shapes."""
        return np.concatenate((self.classes, self.chosen, np.arange(CLASSES + 1, LETTERS)))

    def before_classes(self) -> np.ndarray:
        """What every dictionary word is as the word before: its class if clustered, else its shape; then the shapes."""
        rest = CLASSES + 1 + shapes(_strings(self.words[len(self.classes) :]))
        return np.concatenate((self.classes, rest, np.arange(CLASSES + 1, LETTERS)))

    def emissions(self) -> np.ndarray:
        """log10 P(word | class) of every dictionary word; 0 for the shapes."""
        own = np.log10(np.maximum(self.counts, 1)) - self.class_log()[self.word_classes()[: len(self.words)]]
        return np.concatenate((own, np.zeros(SHAPES)))

    def base_log(self) -> float:
        return float(np.log10(self.tokens + self.types + 1.0))


def _encoded(texts: DataFrame, words: list[bytes]) -> DataFrame:
    """The training texts as numbers of two bytes, each text ending in END, and their words outside ``words``; a row per run of texts."""
    sent = texts.sparkSession.sparkContext.broadcast(_strings(words))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, at, missed in _tokens(batch.column(0), sent.value):
                all_missed = pa.ListArray.from_arrays(pa.array([0, len(missed)], pa.int32()), missed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pc.binary_join(all_missed, " ")], ["units", "missed"]
                )

    return texts.select("text").mapInArrow(encode, "units binary, missed string")


_COUNTS = "block int, places binary, counts binary"


def _counted(encoded: DataFrame, classes: np.ndarray) -> DataFrame:
    """(block, places, counts): how often each class comes after, then before, each word of a block of words and shapes.

    A task counts over its texts and gives the counts out by blocks. Blocks are sorted and
    stream through: a task adds up one block at a time, however many tasks counted. The
    result has the size of the words, not of the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(classes) * LETTERS
        total = np.zeros(2 * cells, np.int64)
        for batch in batches:
            for row in batch.column(0):
                units = np.frombuffer(row.as_buffer(), np.uint16).astype(np.int64)
                own = classes[units]
                units *= LETTERS
                total[own[0]] += 1  # comes after END, which ends every text and is unit 0
                total[:cells] += np.bincount(units[:-1] + own[1:], minlength=cells)
                total[cells + units[0] + CLASSES] += 1
                total[cells:] += np.bincount(units[1:] + own[:-1], minlength=cells)
        total = total.reshape(2, len(classes), LETTERS)
        yield given((block, total[:, block : block + BLOCK].ravel()) for block in range(0, len(classes), BLOCK))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, None
        for batch in batches:
            for block, places, counts in _blocks(batch):
                if block != current:
                    if current is not None:
                        yield given([(current, total)])
                    current, total = block, np.zeros(2 * min(BLOCK, len(classes) - block) * LETTERS, np.int64)
                total[places] += counts
        if current is not None:
            yield given([(current, total)])

    def given(totals) -> pa.RecordBatch:
        found = [(block, at, total[at]) for block, total in totals if len(at := np.flatnonzero(total))]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block for block, _, _ in found], pa.int32()),
                pa.array([at.astype(np.int32).tobytes() for _, at, _ in found], pa.binary()),
                pa.array([counts.tobytes() for _, _, counts in found], pa.binary()),
            ],
            ["block", "places", "counts"],
        )

    counted = encoded.select("units").mapInArrow(count, _COUNTS)
    return counted.repartition("block").sortWithinPartitions("block").mapInArrow(add, _COUNTS)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for block, places, counts in zip(*(batch.column(i) for i in range(3))):
        yield block.as_py(), np.frombuffer(places.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.int64)


def _transitions(counted: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class pairs over the whole training corpus."""

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(LETTERS * LETTERS, np.int64)
        for block, places, counts in _blocks(batch):
            after = np.searchsorted(places, min(BLOCK, len(classes) - block) * LETTERS)
            words, cells = np.divmod(places[:after].astype(np.int64), LETTERS)
            total += np.bincount(classes[block + words] * LETTERS + cells, counts[:after], LETTERS * LETTERS).astype(np.int64)
        return total

    return _cells(counted, matrix, (LETTERS, LETTERS))


def _information(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def objective(transitions: np.ndarray) -> float:
    """Log-likelihood of the corpus under the classes, but for a constant; exchanges raise it."""
    return float(
        _information(transitions).sum() - _information(transitions.sum(axis=0)).sum() - _information(transitions.sum(axis=1)).sum()
    )


def best_moves(after: np.ndarray, before: np.ndarray, own: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best class of each word, and the gain over its own; counts of its classes after and before it."""
    size = np.concatenate((after, before), axis=1).sum(axis=1, keepdims=True) / 2
    rows, columns = transitions[:CLASSES], transitions[:, :CLASSES].T
    row_sums, column_sums = transitions.sum(axis=1)[:CLASSES], transitions.sum(axis=0)[:CLASSES]
    joined = (
        _information(rows[None] + after[:, None]).sum(axis=2) - _information(rows).sum(axis=1)
        + _information(columns[None] + before[:, None]).sum(axis=2) - _information(columns).sum(axis=1)
        - _information(row_sums + size) + _information(row_sums)
        - _information(column_sums + size) + _information(column_sums)
    )
    mine = np.arange(len(own))
    left_rows, left_columns = np.maximum(rows[own] - after, 0), np.maximum(columns[own] - before, 0)
    left_row_sum, left_column_sum = row_sums[own] - size[:, 0], column_sums[own] - size[:, 0]
    joined[mine, own] = (
        (_information(rows[own]) - _information(left_rows)).sum(axis=1)
        + (_information(columns[own]) - _information(left_columns)).sum(axis=1)
        - _information(row_sums[own]) + _information(np.maximum(left_row_sum, 0))
        - _information(column_sums[own]) + _information(np.maximum(left_column_sum, 0))
    )
    best = joined.argmax(axis=1)
    return best, joined[mine, best] - joined[mine, own]


def _exchange(counted: DataFrame, classes: np.ndarray, transitions: np.ndarray, turn: int, share: int) -> np.ndarray:
    """One round: one in ``share`` clustered words moves to its best class, all against the same counts. Only classes come back."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, places, counts in _blocks(batch):
                total = np.zeros(2 * min(BLOCK, len(classes) - block) * LETTERS)
                total[places] = counts
                yield moved(block, total)

    def moved(block: int, total: np.ndarray) -> pa.RecordBatch:
        after, before = total.reshape(2, -1, LETTERS)
        numbers = np.arange(block, block + len(after))
        free = np.flatnonzero((numbers % share == turn % share) & (classes[numbers] < CLASSES))
        best, gain = best_moves(after[free], before[free], classes[numbers[free]], transitions)
        better = gain > 1e-6
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers[free][better]), pa.array(best[better].astype(np.int64))], ["word", "class"]
        )

    changed = classes.copy()
    for row in counted.mapInArrow(move, "word long, class long").collect():  # at most one per clustered word
        changed[row["word"]] = row["class"]
    return changed


# ---- words outside the most frequent


_CONTEXTS = "word string, cells binary, counts binary"


def _binary(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary values, each the bytes of values[edges[i]:edges[i + 1]]."""
    places = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of binary values one after another, and how many each value has."""
    places = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    held = np.frombuffer(data, np.uint8)[places[0] : places[-1]] if data else np.zeros(0, np.uint8)
    return np.frombuffer(held.tobytes(), kind), np.diff(places) // np.dtype(kind).itemsize


def _contexts_of(words: pa.Array, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per word of (word, cells, counts), from the counts of sorted keys: the word's number times LETTERS, and the cell."""
    edges = np.searchsorted(keys, np.arange(len(words) + 1) * LETTERS)
    return pa.RecordBatch.from_arrays(
        [words, _binary((keys % LETTERS).astype(np.uint8), edges), _binary(counts.astype(np.int64), edges)], ["word", "cells", "counts"]
    )


def _summed(words: pa.Array, owners: np.ndarray, cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """One row per word of (word, cells, counts), from cells of words told by the number of the word."""
    keys, at = np.unique(owners * LETTERS + cells, return_inverse=True)
    return _contexts_of(words, keys, np.bincount(at, counts, len(keys)))


def _contexts(encoded: DataFrame, clustered: int, classes: np.ndarray) -> DataFrame:
    """(word, cells, counts): how often each word outside the clustered comes after each class, or shape of a word outside.

    A task gives its counts out in one row per word and run of tokens. Rows of a word meet
    sorted by its hash, a number, and are added up as they stream through.
    """

    letters = classes.astype(np.uint8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, befores, size = [], [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                units = np.frombuffer(batch.column(0)[at].as_buffer(), np.uint16)
                before = np.concatenate((letters[:1], letters[units[:-1]]))  # every text ends in END, which is first
                befores.append(before[units >= clustered])
                missed, _ = flat_words(batch.column(1).slice(at, 1))
                held.append(missed)
                size += len(missed)
                if size > FLUSH:
                    yield given(held, befores)
                    held, befores, size = [], [], 0
        if size:
            yield given(held, befores)

    def given(held: list[pa.Array], befores: list[np.ndarray]) -> pa.RecordBatch:
        coded = pa.concat_arrays(held).dictionary_encode()
        owners = coded.indices.to_numpy().astype(np.int64)
        keys, counts = np.unique(owners * LETTERS + np.concatenate(befores), return_counts=True)
        return _contexts_of(coded.dictionary, keys, counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks().to_batches()[0]
            coded = rows.column(0).dictionary_encode()
            cells, sizes = _numbers(rows.column(1), np.uint8)
            counts, _ = _numbers(rows.column(2), np.int64)
            added = _summed(coded.dictionary, np.repeat(coded.indices.to_numpy().astype(np.int64), sizes), cells, counts)
            # in the order of the hashes; more rows may follow for the words of the last hash, rarely more than one
            hashes = rows.column(3).to_numpy()
            done = int(coded.indices.to_numpy()[np.searchsorted(hashes, hashes[-1]) :].min())
            if done:
                yield added.slice(0, done)
            open_words = added.slice(done)
            last = pa.RecordBatch.from_arrays([*open_words.columns, pa.array(np.full(open_words.num_rows, hashes[-1]))], schema=batch.schema)
        if last is not None:
            yield last.select(["word", "cells", "counts"])

    given_out = encoded.mapInArrow(count, _CONTEXTS).withColumn("hash", F.xxhash64("word"))
    return given_out.repartition("hash").sortWithinPartitions("hash").mapInArrow(add, _CONTEXTS)


class _Choice:
    """Best classes of words by what comes before them, against fixed counts of (before, class)."""

    def __init__(self, table: np.ndarray) -> None:
        self.table, self.sums = table, table.sum(axis=0)
        self.held, self.held_sums = _information(table), _information(self.sums)
        self.few = np.stack([_information(table + n) - self.held for n in range(FEW + 1)])
        self.once = self.few[1]
        many = np.arange(SHORT + 1)[:, None]
        self.share = _information(self.sums + many) - self.held_sums
        self.lone = (self.once - self.share[1]).argmax(axis=1)  # of words that occur once

    def joined(self, cells: np.ndarray, counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """What each word adds to the likelihood in each class, its own counts not among the fixed ones."""
        gains = self.few[np.minimum(counts, FEW), cells]
        more = np.flatnonzero(counts > FEW)
        gains[more] = _information(self.table[cells[more]] + counts[more, None]) - self.held[cells[more]]
        shared = self.share[np.minimum(sizes, SHORT)]
        long = np.flatnonzero(sizes > SHORT)
        shared[long] = _information(self.sums + sizes[long, None]) - self.held_sums
        return np.add.reduceat(gains, starts, axis=0) - shared

    def first(self, cells: np.ndarray, counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.joined(cells, counts, starts, sizes).argmax(axis=1)

    def again(self, own: np.ndarray, cells: np.ndarray, counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best class of words whose counts are among the fixed ones, in their own class."""
        gain = self.joined(cells, counts, starts, sizes)
        mine = np.repeat(own, np.diff(np.append(starts, len(cells))))
        held = self.held[cells, mine] - _information(np.maximum(self.table[cells, mine] - counts, 0))
        staying = np.add.reduceat(held, starts) - self.held_sums[own] + _information(np.maximum(self.sums[own] - sizes, 0))
        row = np.arange(len(own))
        gain[row, own] = staying
        best = gain.argmax(axis=1)
        return np.where(gain[row, best] > staying + 1e-6, best, own)


def _chosen(batch: pa.RecordBatch, steps: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(class, tokens, cells, counts, owner of each cell) of the words of a batch after all steps.

    In the first step every word takes a class, in each later one every other word may move.
    """
    cells, lengths = _numbers(batch.column("cells"), np.uint8)
    counts, _ = _numbers(batch.column("counts"), np.int64)
    cells = cells.astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    sizes = np.add.reduceat(counts, starts)
    lots = batch.column("lot").to_numpy()
    found = np.zeros(len(sizes), np.int64)
    choices = [_Choice(table) for table in steps]
    for step, choice in enumerate(choices):
        free = np.ones(len(sizes), bool) if step == 0 else lots == step % 2
        if step == 0:
            lone = np.flatnonzero(sizes == 1)
            found[lone] = choice.lone[cells[starts[lone]]]
            free[lone] = False
        free = np.flatnonzero(free)
        reach = np.cumsum(lengths[free])
        cuts = np.searchsorted(reach, np.arange(CELLS, reach[-1], CELLS)) if len(free) else []
        for words in np.split(free, np.unique(cuts)):
            if not len(words):
                continue
            size = lengths[words]
            own_starts = np.cumsum(size) - size
            places = np.arange(size.sum()) - np.repeat(own_starts, size) + np.repeat(starts[words], size)
            context = cells[places], counts[places], own_starts, sizes[words]
            found[words] = choice.first(*context) if step == 0 else choice.again(found[words], *context)
    return found, sizes, cells, counts, np.repeat(np.arange(len(sizes)), lengths)


def _cells(rows: DataFrame, function, shape: tuple[int, int]) -> np.ndarray:
    """Sum of the matrices that ``function`` makes of Arrow batches; one per task is added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape[0] * shape[1], np.int64)
        for batch in batches:
            if batch.num_rows:
                total += function(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    total = np.zeros(shape[0] * shape[1])
    for row in rows.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        total[row["cell"]] = row["n"]  # at most the cells of the matrix
    return total.reshape(shape)


def place_rest(contexts: DataFrame, head: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(word, c, class) of every word of (word, cells, counts), and the counts (before, class) of all words.

    Predictive exchange: a word takes the class that raises the likelihood of the words after
    their predecessors most. What comes before is fixed, so the corpus is not read again: a
    round is one pass over the table of contexts, against the counts of the round before.
    ``head`` are the counts without these words.
    """
    rows = contexts.withColumn("lot", F.pmod(F.xxhash64("word"), F.lit(2)))
    steps = [head]

    def counted(steps: list[np.ndarray]) -> np.ndarray:
        def matrix(batch: pa.RecordBatch) -> np.ndarray:
            found, _, cells, counts, owners = _chosen(batch, steps)
            return np.bincount(cells * CLASSES + found[owners], counts, LETTERS * CLASSES).astype(np.int64)

        return head + _cells(rows, matrix, (LETTERS, CLASSES))

    def likelihood(table: np.ndarray) -> float:
        return float(_information(table).sum() - _information(table.sum(axis=0)).sum())

    total = counted(steps)
    for _ in range(rounds):
        after = counted([*steps, total])
        if likelihood(after) <= likelihood(total):  # too many moved at once: the round is taken back
            break
        steps, total = [*steps, total], after

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, sizes, *_ = _chosen(batch, steps)
                yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(sizes), pa.array(found.astype(np.int32))], ["word", "c", "class"])

    return rows.mapInArrow(place, "word string, c long, class int"), total


def _seen_once(contexts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of (before, shape) over the words that occur once, and their number by shape."""

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        before, _ = _numbers(batch.column("cells"), np.uint8)
        return np.bincount(before.astype(np.int64) * SHAPES + shapes(batch.column("word")), minlength=LETTERS * SHAPES)

    once = contexts.where((F.length("cells") == 1) & (F.col("counts") == F.lit(np.int64(1).tobytes())))
    unseen = _cells(once.select("word", "cells"), matrix, (LETTERS, SHAPES))
    return unseen, unseen.sum(axis=0)


def _most_frequent(vocabulary: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """Words with their counts, most frequent first, as far down as ``DICTIONARY`` words hold.

    Counts fall into steps of a sixteenth of a power of two. A histogram over the steps,
    some hundred rows, says down to which step whole steps fit; only their words come
    to the driver.
    """
    step = F.floor(16 * F.log2("c")).cast("int")
    fits, lowest = 0, None
    for row in sorted(vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True):
        fits += row["n"]
        if fits > DICTIONARY:
            break
        lowest = row["step"]
    if lowest is None:
        return [], np.zeros(0, np.int64)
    found = vocabulary.where(step >= lowest).select("word", "c").toArrow()
    held = sorted(zip(found["word"].to_pylist(), found["c"].to_pylist()), key=lambda x: (-x[1], x[0]))
    return [word.encode() for word, _ in held], np.array([c for _, c in held], np.int64)


def learn(texts: DataFrame, rounds: int = ROUNDS) -> Model:
    """Count, cluster, and count again over the whole training texts (column text).

    The class counts of the clustered words are the only ones that the rounds need, so
    the corpus is written once as numbers and each round reads those. Every other word then
    takes a class by the words before it.
    """
    vocabulary = tables.cut(count_words(texts), "vocabulary")
    tokens, types = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words, counts = _most_frequent(vocabulary.where(F.octet_length("word") <= LONGEST))
    if END in words:  # first, whatever its rank
        at = words.index(END)
        words.insert(0, words.pop(at))
        counts = np.concatenate((counts[at : at + 1], np.delete(counts, at)))
    else:
        words.insert(0, END)
        counts = np.concatenate(([0], counts))
    clustered = min(CLUSTERED, len(words))
    shapes_at = clustered
    classes = np.concatenate((
        [CLASSES], np.arange(clustered - 1) % CLASSES, np.arange(CLASSES + 1, LETTERS),
    )).astype(np.int64)
    encoded = tables.cut(_encoded(texts, words[:clustered]), "encoded")
    counted = tables.cut(_counted(encoded, classes), "counted")
    transitions = _transitions(counted, classes)
    share = 2
    for turn in range(rounds):
        moved = _exchange(counted, classes, transitions, turn, share)
        recounted = tables.cut(_counted(encoded, moved), "counted")
        after = _transitions(recounted, moved)
        if objective(after) >= objective(transitions):
            classes, transitions, counted = moved, after, recounted
        else:  # too many moved at once: take the round back, move fewer from now on
            share *= 2

    contexts = tables.cut(_contexts(encoded, clustered, classes), "contexts")
    placed, table = place_rest(contexts, transitions[:, :CLASSES], min(rounds, REST_ROUNDS))
    placed = tables.cut(placed, "placed")
    ending = np.zeros((LETTERS, LETTERS))
    ending[:, :CLASSES], ending[:, CLASSES] = table, transitions[:, CLASSES]
    unseen, lone_types = _seen_once(contexts)
    known = {}
    if clustered < len(words):  # whole steps of counts are in the dictionary, so its least count tells its words
        held = placed.where((F.col("c") >= int(counts[-1])) & (F.octet_length("word") <= LONGEST)).select("word", "class").toArrow()
        known = dict(zip(held["word"].to_pylist(), held["class"].to_pylist()))
    chosen = np.array([known[word.decode()] for word in words[clustered:]], np.int64)
    return Model(vocabulary, placed, tokens, types, words, counts, classes[:shapes_at], chosen, ending, unseen, lone_types)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, ...) of every row's whole text.

    ``score`` is the sum of log10 P(class | word before) + log10 P(word | class). Words of
    the dictionary are scored where the text is; of the others a task gives out (word, before,
    times) per text, whose counts and classes come by a join. Rows are told apart
    by a written row number, so repeated and NULL ids are scored row by row. NULL and empty
    texts are one end token. With nothing learned, every word is unknown.
    """
    spark = docs.sparkSession
    base = np.log10(model.counts + 1.0) - model.base_log()
    steps = model.log_transitions()
    sent = spark.sparkContext.broadcast((
        _strings(model.words), np.concatenate((base, np.zeros(SHAPES))), model.before_classes(), model.word_classes(), model.emissions(),
        np.concatenate((model.counts > 0, np.zeros(SHAPES, bool))), steps,
    ))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, befores, classes, emissions, known, steps = sent.value
        for batch in batches:
            for first, lengths, at, missed in _tokens(batch.column(1), words):
                ends = np.cumsum(lengths)
                starts = ends - lengths
                before = np.concatenate(([CLASSES], befores[at[:-1]]))  # every text ends in END, whose class this is
                own = np.where(at < len(words), emissions[at] + steps[before, classes[at]], 0.0)
                missing = np.flatnonzero(at >= len(words))
                rare = outside(missed, np.searchsorted(ends, missing, "right"), before[missing], len(lengths))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(lengths)), pa.array(lengths, pa.int64()),
                     pa.array(np.add.reduceat(known[at].astype(np.int64), starts)), pa.array(np.add.reduceat(base[at], starts)),
                     pa.array(np.add.reduceat(own, starts)), rare],
                    ["_row", "n", "seen", "base", "score", "rare"],
                )

    def outside(missed: pa.Array, rows: np.ndarray, before: np.ndarray, count: int) -> pa.Array:
        """A list per row of (word, before, shape, n)."""
        coded = missed.dictionary_encode()
        width = (len(coded.dictionary) + 1) * LETTERS
        keys, n = np.unique(rows * width + coded.indices.to_numpy() * np.int64(LETTERS) + before, return_counts=True)
        numbers, before = np.divmod(keys % width, LETTERS)
        fields = [
            coded.dictionary.take(pa.array(numbers)), pa.array(before.astype(np.int32)),
            pa.array(shapes(coded.dictionary)[numbers].astype(np.int32)), pa.array(n.astype(np.int64)),
        ]
        edges = np.searchsorted(keys, np.arange(count + 1) * width).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(fields, ["word", "before", "shape", "n"]))

    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    local = tables.cut(
        numbered.select(F.struct("_row", "doc_id").alias("_row"), "text").mapInArrow(
            scored,
            f"_row struct<_row:long,doc_id:{docs.schema['doc_id'].dataType.simpleString()}>, n long, seen long, base double, "
            "score double, rare array<struct<word:string,before:int,shape:int,n:long>>",
        ).select("_row.*", "n", "seen", "base", "score", "rare"),
        "scored",
    )
    paths = spark.createDataFrame(
        [(i, k, x) for i, row in enumerate((steps - model.class_log()).tolist()) for k, x in enumerate(row)], "before int, class int, step double"
    )
    rare = local.select("_row", F.inline("rare")).join(model.placed, "word", "left").withColumn(
        "class", F.coalesce("class", F.lit(CLASSES + 1) + F.col("shape"))
    ).join(F.broadcast(paths), ["before", "class"])
    sums = rare.groupBy("_row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("_seen"),
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)) - F.lit(model.base_log()))).alias("_base"),
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(1))) + F.col("step"))).alias("_score"),
    )
    return local.drop("rare").join(sums, "_row", "left").select(
        "doc_id", F.col("n").alias("n_tokens"), (F.col("seen") + F.coalesce("_seen", F.lit(0))).alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold, then score all of them."""
    held = fold(F.col("doc_id"), FOLDS) == HELD_OUT
    model = learn(docs.where(~held).select("text"))
    return score(docs.select("doc_id", "text"), model).withColumn("held_out", held).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))
    )
