"""Quality rules with risk-controlled thresholds; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from mendframe.functions import tables
from mendframe.llm.common import packed, words

SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r "
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3  # words of a repeated window

RISK = 0.05  # false rejections allowed among the good documents of a stratum
CONFIDENCE_LOSS = 0.05  # chance that any stratum exceeds its risk

# Rule: a share of two counts that must not be above a cutoff; cutoffs from lenient to strict.
RULES: dict[str, tuple[str, str, tuple[float, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03, 0.02, 0.01)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "repeats": ("n_repeat_words", "n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "long_words": ("word_chars", "n_words", (50.0, 30.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.0)),
    "same_words": ("n_same_words", "n_words", (0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.6, 0.5)),
}


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules use, from whole texts; a NULL text counts nothing.

    Each intermediate array is a column of its own projection, so that it is
    built once per row. Windows are compared by 64-bit hashes of their words;
    sorting (hash, position) inside the row finds the repeated ones, and only
    rows that have any are sorted.
    """
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    filled = F.filter(lines, lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    staged = docs.withColumn("_words", words(F.col(text))).withColumn("_lines", filled)
    n = F.size("_words")
    windows = F.when(
        n >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), n - WINDOW),
            lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW))),
        ),
    )
    bare = F.translate(F.coalesce(F.col(text), F.lit("")), BLANKS, "")
    staged = (
        staged.withColumn("_windows", windows)
        .withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(bare).cast("long"))
        .withColumn("n_symbols", (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_same_words", (n - F.size(F.array_distinct("_words"))).cast("long"))
        .drop("_words", "_lines")
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    pairs = F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    staged = staged.withColumn("_pairs", pairs).drop("_windows")

    def repeated(pair: Column, at: Column) -> Column:
        before = (at > 0) & (F.get("_pairs", at - 1)["h"] == pair["h"])
        return F.when(before | (F.get("_pairs", at + 1)["h"] == pair["h"]), pair["i"])

    starts = F.sort_array(F.array_compact(F.transform("_pairs", repeated)))
    staged = staged.withColumn("_starts", starts).drop("_pairs")
    covered = F.aggregate(
        F.transform("_starts", lambda s, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - s, F.lit(WINDOW)))),
        F.lit(0), lambda total, x: total + x,
    )
    return staged.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def log_gamma(z: Column) -> Column:
    """ln gamma for z >= 1: Stirling's series, moved up by eight."""
    shifted = z + 8
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    series = 1 / (12 * shifted) - 1 / (360 * shifted**3) + 1 / (1260 * shifted**5) - 1 / (1680 * shifted**7)
    return (shifted - 0.5) * F.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_tail(n: Column, x: Column, risk: float) -> Column:
    """Exact P(Binomial(n, risk) <= x), rounded upwards; 1 where x >= n * risk.

    Terms fall geometrically below the mode, so they are summed from x downwards
    until what is left, bounded by a geometric series, is added whole.
    """
    n, x = n.cast("double"), x.cast("double")
    odds = risk / (1 - risk)
    log_first = (
        log_gamma(n + 1) - log_gamma(x + 1) - log_gamma(n - x + 1) + x * math.log(risk) + (n - x) * math.log1p(-risk)
    )
    steps = F.least(x, 16 * F.sqrt(n * risk) + 64).cast("long")

    def add(state: Column, j: Column) -> Column:
        at = x - j + 1
        term = state["term"] * at / ((n - at + 1) * odds)
        return F.struct(term.alias("term"), (state["total"] + term).alias("total"))

    summed = F.aggregate(
        F.when(steps >= 1, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), add,
    )
    ratio = x / ((n - x + 1) * odds)
    return F.when(x >= n * risk, F.lit(1.0)).otherwise(
        F.exp(log_first) * (summed["total"] + F.when(steps < x, summed["term"] * ratio / (1 - ratio)).otherwise(F.lit(0.0)))
    )


def _share(rule: str) -> Column:
    part, whole, _ = RULES[rule]
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def select_cutoffs(
    features: DataFrame, labels: DataFrame, risk: float = RISK, loss: float = CONFIDENCE_LOSS
) -> DataFrame:
    """(stratum, rule, cutoff, n_good, n_rejected, n_caught): the best safe cutoff of each rule, where any is safe.

    ``features``: doc_id, stratum, base_failed and counts; ``labels``: (doc_id, quality).
    The holdout of a stratum is its labelled documents that pass the base rules; a
    document is good if any of its labels has quality 1. A cutoff is safe if the exact
    binomial test rejects "its false rejections among good documents exceed
    risk / rules". Cutoffs are tested from lenient to strict and testing stops at the
    first failure, so a rule's cutoffs need no correction among themselves; over rules
    and strata the level is divided (Bonferroni). All safe cutoffs hold at once, so any
    may be chosen: the one that rejects most bad documents in excess of good ones, the
    more lenient of equals, and none where no excess is left. Except with probability
    ``loss``, no stratum loses more than ``risk`` of its good documents to all rules
    together. A stratum with too few labels gets no cutoff and rejects nothing. Counts
    are sums over (stratum, rule, cutoff), combined map-side.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max("quality").alias("quality")
    )
    held = tables.lookup(features.where(~F.col("base_failed")), known, ["doc_id"], how="inner")
    strata = features.select("stratum").distinct().agg(F.count("*").alias("strata"))
    trials = [
        F.struct(F.lit(rule).alias("rule"), F.lit(step).alias("step"), F.lit(cutoff).alias("cutoff"),
                 (_share(rule) > cutoff).cast("int").alias("over"))
        for rule, (_, _, cutoffs) in RULES.items() for step, cutoff in enumerate(cutoffs)
    ]
    good = (F.col("quality") == 1).cast("int")
    counted = (
        held.select("stratum", good.alias("good"), F.inline(F.array(*trials)))
        .groupBy("stratum", "rule", "step", "cutoff")
        .agg(
            F.sum("good").alias("n_good"),
            F.sum(F.col("over") * F.col("good")).alias("n_rejected"),
            F.sum(F.col("over") * (1 - F.col("good"))).alias("n_caught"),
        )
    )
    tested = counted.crossJoin(F.broadcast(strata)).withColumn(  # one row on the right
        "safe",
        binomial_tail(F.col("n_good"), F.col("n_rejected"), risk / len(RULES)) <= loss / len(RULES) / F.col("strata"),
    )
    so_far = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    excess = F.col("n_caught") - F.col("n_rejected")
    return (
        tested.withColumn("open", F.min("safe").over(so_far)).where("open").where(excess > 0)
        .groupBy("stratum", "rule")
        .agg(F.max_by(F.struct("cutoff", "n_good", "n_rejected", "n_caught"), F.struct(excess, -F.col("step"))).alias("best"))
        .select("stratum", "rule", "best.*")
    )


def judge(docs: DataFrame, labels: DataFrame, whole_rows: bool = False, stratum: str = "lang") -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row of ``docs``, beside its doc_id.

    ``n_rules`` counts the cutoffs exceeded; ``whole_rows`` adds the row itself as a
    struct ``_in``. A stratum is a value of ``stratum``; NULL and empty are one. Repeated
    rows stay; a row without id is never in the holdout. Without labels only the base
    rules reject. An empty table stays empty.
    """
    rows = packed(docs, doc_id=F.col("doc_id"), text=F.col("text"), stratum=F.coalesce(F.col(stratum), F.lit("")))
    if not whole_rows:
        rows = rows.drop("_in")
    counted = with_features(rows).drop("text").withColumn("base_failed", base_failed())
    judged = tables.cut(counted, "judged")
    cutoffs = select_cutoffs(judged.drop("_in"), labels)
    per_stratum = cutoffs.groupBy("stratum").agg(
        *(F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"_max_{rule}") for rule in RULES)
    )
    known = tables.lookup(judged, tables.cut(per_stratum, "cutoffs"), ["stratum"])
    exceeded = sum(
        (F.coalesce(_share(rule) > F.col(f"_max_{rule}"), F.lit(False)).cast("int") for rule in RULES), F.lit(0)
    )
    return known.withColumn("n_rules", exceeded).select(
        *(["_in"] if whole_rows else []),
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_rules",
        (~F.col("base_failed") & (F.col("n_rules") == 0)).alias("kept"),
    )
