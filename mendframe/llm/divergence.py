"""Divergence of the sources of a language, by cube partitioning.

The work is a cube of groups x groups x terms for each language. It is cut into cells
of a block of groups, another block of groups and a block of terms. A slice, the
probabilities of one block of groups over one block of terms, is copied to the cells
that need it; a cell compares its two blocks of groups over its own terms only, and
the partial divergences are summed along the term axis.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mendframe.functions import tables

MIN_DOCUMENTS = 30  # documents of a language that hold a kept term, at least
SMOOTHING = 5  # added to every count
SCALE = 1_000_000_000  # probabilities are whole numbers of this part
GROUPS = 64  # groups of a block, about
TERMS = 4_096  # terms of a block, about
TOP_TERMS = 50
PENDING = 200_000  # counts that a task gathers before it gives them out

_TERM_BYTES = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_COUNTS = pa.schema([
    ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64()),
])


def terms_of(text: str | None) -> list[bytes]:
    """Matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in UTF-8, only A-Z lower-cased.

    All bytes of a character beyond ASCII are 0x80 or more, so the bytes decide.
    """
    return text.encode().translate(_TERM_BYTES).split(b" ") if text else []


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group.

    Every group has a row with a NULL term, so one without any term is there, too.
    NULL text, lang and source count as empty text. Tasks add up a bounded number
    of counts before they give them out, so a hot group or term leaves each task in
    few rows; repeated rows are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple[str, str], Counter] = {}
        documents: dict[tuple[str, str], Counter] = {}
        pending = 0

        def gathered() -> Iterator[pa.RecordBatch]:
            for group, counts in uses.items():
                held = documents[group]
                names = list(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([group[0]] * (len(names) + 1), pa.string()), pa.array([group[1]] * (len(names) + 1), pa.string()),
                        pa.array([None, *(w.decode() for w in names)], pa.string()),
                        pa.array([0, *counts.values()], pa.int64()), pa.array([0, *(held[w] for w in names)], pa.int64()),
                    ],
                    schema=_COUNTS,
                )

        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("text", "lang", "source"))
            for text, lang, source in zip(*columns):
                group = lang or "", source or ""
                if group not in uses:
                    uses[group], documents[group] = Counter(), Counter()
                counts = uses[group]
                before = len(counts)
                found = terms_of(text)
                counts.update(found)
                held = set(found)
                documents[group].update(held)
                if b"" in held:  # what splitting leaves between two separators
                    del counts[b""], documents[group][b""]
                pending += max(len(counts) - before, 0)
                if pending >= PENDING:
                    yield from gathered()
                    uses, documents, pending = {}, {}, 0
        yield from gathered()

    parts = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _scaled(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * kept)), exact for counts of up to 18 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * wide(count + SMOOTHING)
    return F.call_function("div", top, wide(total + SMOOTHING * kept)) + 1


def profiles(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, probabilities, languages), written tables.

    groups: (lang, source, floor, kept): ``floor`` is the probability of a kept term
    that the group lacks, ``kept`` the number of kept terms of the language.
    probabilities: (lang, source, term, p) of the kept terms that a group holds;
    languages: (lang, term, q), the same of the whole language.
    """
    counts = tables.cut(count_terms(docs), "counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    kept = tables.cut(terms.where(F.col("docs") >= min_documents).select("lang", "term", "all_n"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_total"))
    held = tables.cut(tables.lookup(counts.where("term is not null"), kept.select("lang", "term"), ["lang", "term"], "inner"), "held")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = counts.where("term is null").select("lang", "source")
    groups = tables.cut(
        every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
            "lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
            F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        ),
        "groups",
    )
    known = groups.select("lang", "source", "total", "kept")
    probabilities = tables.lookup(held, known, ["lang", "source"], "inner").select(
        "lang", "source", "term", _scaled(F.col("n"), F.col("total"), F.col("kept")).alias("p")
    )
    languages = tables.lookup(kept, sizes, ["lang"], "inner").select(
        "lang", "term", _scaled(F.col("all_n"), F.col("lang_total"), F.col("kept")).alias("q")
    )
    floors = groups.select(
        "lang", "source", F.when(F.col("kept") > 0, _scaled(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0)).alias("floor"), "kept"
    )
    return floors, tables.cut(probabilities, "probabilities"), tables.cut(languages, "languages")


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def cells(groups: DataFrame, probabilities: DataFrame, groups_a_block: int = GROUPS, terms_a_block: int = TERMS) -> DataFrame:
    """The slices of every cell: (lang, row, col, part, source, floor, term, p).

    ``row <= col`` are blocks of groups, ``part`` a block of terms; each number of blocks
    follows the number of groups and kept terms of the language. A slice goes to one cell
    per block of groups, so the copies grow with the groups over ``groups_a_block``. Each
    group has a row without a term in every cell, which also says how the other rows'
    groups stand: cells without any term have their groups.
    """
    blocks = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / groups_a_block).cast("int").alias("rows"),
        F.greatest(F.ceil(F.max("kept") / terms_a_block), F.lit(1)).cast("int").alias("parts"),
    )
    sized = tables.cut(
        groups.join(blocks, "lang").withColumn("block", _block(F.col("source"), F.col("rows"))), "sized"
    )
    none = F.lit(None)
    headers = sized.select(
        "lang", "source", "floor", "block", "rows", none.cast("string").alias("term"), none.cast("bigint").alias("p"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    known = sized.select("lang", "source", "floor", "block", "rows", "parts")
    filled = tables.lookup(probabilities, known, ["lang", "source"], "inner").select(
        "lang", "source", "floor", "block", "rows", "term", "p", _block(F.col("term"), F.col("parts")).alias("part")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("rows") - 1))
    return headers.unionByName(filled).withColumn("other", other).select(
        "lang", F.least("block", "other").alias("row"), F.greatest("block", "other").alias("col"), "part",
        "block", "source", "floor", "term", "p",
    )


def compare_cell(cell: pa.Table) -> pa.Table:
    """(lang, source, item, distance, seen) of every pair between a cell's two blocks.

    ``distance`` sums the differences over the ``seen`` terms that any group of the cell holds.
    """
    lang, row, col = (cell.column(name)[0].as_py() for name in ("lang", "row", "col"))
    terms = cell.column("term").combine_chunks().dictionary_encode()
    sources = cell.column("source").combine_chunks().dictionary_encode()
    names, group = sources.dictionary.to_pylist(), sources.indices.to_numpy()
    floors, blocks = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    floors[group] = cell.column("floor").to_numpy()
    blocks[group] = cell.column("block").to_numpy()
    seen = len(terms.dictionary)
    table = np.repeat(floors[:, None], seen, axis=1)
    has = terms.indices.is_valid().to_numpy(zero_copy_only=False)
    table[group[has], terms.indices.drop_null().to_numpy()] = cell.column("p").combine_chunks().drop_null().to_numpy()
    left, right = np.flatnonzero(blocks == row), np.flatnonzero(blocks == col)
    made: list[tuple[int, int, int]] = []
    for i in left.tolist():
        distances = np.abs(table[right] - table[i]).sum(axis=1).tolist()
        for j, distance in zip(right.tolist(), distances):
            if row != col:
                made += [(i, j, distance), (j, i, distance)]
            elif i != j:
                made.append((i, j, distance))
    return pa.table({
        "lang": pa.array([lang] * len(made), pa.string()),
        "source": pa.array([names[i] for i, _, _ in made], pa.string()),
        "item": pa.array([names[j] for _, j, _ in made], pa.string()),
        "distance": pa.array([d for _, _, d in made], pa.int64()),
        "seen": pa.array([seen] * len(made), pa.int64()),
    })


def divergences(groups: DataFrame, probabilities: DataFrame, groups_a_block: int = GROUPS, terms_a_block: int = TERMS) -> DataFrame:
    """(lang, source, item, value): summed differences of each two groups of a language over all its kept terms.

    Terms that neither of a cell's groups holds differ by the groups' floors alone and are
    added in one product at the end. A language with a single source gives no row.
    """
    keys = ["lang", "row", "col", "part"]
    parts = cells(groups, probabilities, groups_a_block, terms_a_block).groupBy(*keys).applyInArrow(
        compare_cell, "lang string, source string, item string, distance bigint, seen bigint"
    )
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("distance").alias("distance"), F.sum("seen").alias("seen"))
    mine = groups.select("lang", "source", "floor", "kept")
    theirs = groups.select("lang", F.col("source").alias("item"), F.col("floor").alias("item_floor"))
    both = sums.join(mine, ["lang", "source"]).join(theirs, ["lang", "item"])
    unseen = (F.col("kept") - F.col("seen")) * F.abs(F.col("floor") - F.col("item_floor"))
    return both.select("lang", "source", "item", (F.col("distance") + unseen).alias("value"))


def leading_terms(probabilities: DataFrame, languages: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a group holds and uses more than its language, by how much."""
    both = tables.lookup(probabilities, languages, ["lang", "term"], "inner")
    return both.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def audit(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS,
    groups_a_block: int = GROUPS, terms_a_block: int = TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) over ``documents``.

    Part ``pair`` ranks for each group the other sources of its language by divergence,
    all of them; part ``term`` the ``top_terms`` terms that a group uses more than its
    language. Equal values rank by item. NULL lang, source and text count as empty text,
    ids and other columns are not read, an empty table gives no rows.
    """
    groups, probabilities, languages = profiles(docs, min_documents)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = divergences(groups, probabilities, groups_a_block, terms_a_block).withColumn("rank", F.row_number().over(order))
    terms = leading_terms(probabilities, languages).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank"
    )
