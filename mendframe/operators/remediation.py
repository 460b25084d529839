"""One remediation per cluster: remembered, deterministic, answered, or quarantined.

All tables here have one row per cluster. The order of the routes is memory,
deterministic rule, external answer, quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mendframe import settings as S
from mendframe.functions import tables, text as tx

DECISION = (
    "struct<transformation_type:string,code:string,confidence_score:double,reasoning:string,"
    "fallback_value:string,model_used:string,cache_hit:boolean,raw_response:string>"
)


def sample_values(rows: Column) -> Column:
    """Up to five distinct values of the sample rows, first seen first; NULL is ``None``."""

    def candidates(row: Column) -> Column:
        choice = F.when(F.map_contains_key(row, "value"), F.array(row["value"]))
        for key in S.SAMPLE_VALUE_KEYS:
            choice = choice.when(F.map_contains_key(row, key), F.array(row[key]))
        return choice.otherwise(F.map_values(row))

    texts = F.transform(F.flatten(F.transform(rows, candidates)), lambda v: F.coalesce(v, F.lit("None")))
    return F.slice(F.array_distinct(texts), 1, S.SAMPLE_VALUES)


def _has_value(text: Column) -> Column:
    return ~F.lower(text).isin(*S.MISSING_SAMPLE)


def anomaly_family(values: Column) -> Column:
    """date_format, type_cast, null_fill or string_corrupt, from the sample values."""
    present = F.filter(values, _has_value)
    needed = F.greatest(F.lit(1), F.ceil(F.size(present) * F.lit(S.FAMILY_SHARE)))
    dates = F.size(F.filter(present, lambda v: v.rlike(S.SAMPLE_DATE_REGEX)))
    numbers = F.size(F.filter(
        present,
        lambda v: tx.strip(F.regexp_replace(v, "[, ]", "")).rlike(S.SAMPLE_NUMBER_REGEX),
    ))
    return (
        F.when(F.size(present) == 0, F.lit("null_fill"))
        .when(dates >= needed, F.lit("date_format"))
        .when(numbers >= needed, F.lit("type_cast"))
        .when(F.size(present) < F.size(values), F.lit("null_fill"))
        .otherwise(F.lit("string_corrupt"))
    )


def hint_counts(rows: Column) -> Column:
    """How often each error type and hint occurs in the sample rows."""
    labels = F.filter(
        F.flatten(F.transform(rows, lambda r: F.array(r["error_type"], r["anomaly_hint"]))),
        lambda v: v.isNotNull() & (v != ""),
    )
    return F.map_from_entries(
        F.transform(
            F.array_distinct(labels),
            lambda label: F.struct(label, F.size(F.filter(labels, lambda v: v == label))),
        )
    )


def with_profile(clusters: DataFrame) -> DataFrame:
    """Add sample values, family and the profile columns; fill missing identity."""
    if "cluster_uid" not in clusters.columns:
        clusters = clusters.withColumn("cluster_uid", F.lit(None).cast("string"))

    def filled(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names), F.lit("cluster_unknown"))

    base = clusters.withColumn("cluster_uid", filled("cluster_uid", "cluster_id", "pattern_key"))
    base = base.withColumn("sample_values", sample_values(F.col("sample_rows")))
    base = base.withColumn("inferred_anomaly_type", anomaly_family(F.col("sample_values")))
    values = F.size("sample_values")
    family = F.col("inferred_anomaly_type")
    null_share = F.when(
        values > 0, F.round(1.0 - F.size(F.filter("sample_values", _has_value)) / values, 3)
    ).otherwise(F.lit(0.0))
    unique_share = F.when(
        values > 0, F.round(F.size(F.array_distinct("sample_values")) / values, 3)
    ).otherwise(F.lit(0.0))
    base = base.withColumn("hint_distribution", hint_counts(F.col("sample_rows")))
    return base.select(
        "*",
        F.size("sample_rows").alias("sample_count"),
        unique_share.alias("unique_sample_ratio"),
        null_share.alias("null_ratio"),
        F.when(F.col("size") >= S.SEVERITY_HIGH_SIZE, F.lit("high"))
        .when((F.col("size") >= S.SEVERITY_MEDIUM_SIZE) | family.isin("string_corrupt", "date_format"),
              F.lit("medium"))
        .otherwise(F.lit("low")).alias("estimated_severity"),
        F.map_contains_key("hint_distribution", S.DUPLICATE_ERROR[0]).alias("is_duplicate"),
        (family.isin(*S.FAST_FAMILIES) | F.map_contains_key("hint_distribution", S.DUPLICATE_ERROR[0]))
        .alias("is_fast_path"),
    )


def _decision(kind, code, confidence, reasoning, fallback, model, cache_hit, raw) -> Column:
    fields = dict(
        transformation_type=kind, code=code, confidence_score=confidence, reasoning=reasoning,
        fallback_value=fallback, model_used=model, cache_hit=cache_hit, raw_response=raw,
    )
    return F.struct(*(value.alias(name) for name, value in fields.items())).cast(DECISION)


def deterministic_decision() -> Column:
    """Decision of the first matching fixed rule, NULL when none applies."""
    chain = None
    for family, kind, code, confidence, reasoning, uses_sample, route in S.DETERMINISTIC_RULES:
        applies = F.col("is_duplicate") if family == "duplicate" else F.col("inferred_anomaly_type") == family
        first = F.coalesce(F.get("sample_values", F.lit(0)), F.lit("null")) if uses_sample else F.lit("null")
        body = F.to_json(F.struct(
            F.lit(kind).alias("transformation_type"), F.lit(code).alias("code"),
            F.lit(confidence).alias("confidence_score"), F.lit(reasoning).alias("reasoning"),
            first.alias("fallback_value"),
        ))
        decision = _decision(
            F.lit(kind), F.lit(code), F.lit(confidence), F.lit(reasoning), first, F.lit(route),
            F.col("cache_hit"), body,
        )
        chain = F.when(applies, decision) if chain is None else chain.when(applies, decision)
    return chain


def static_answers(profiled: DataFrame) -> DataFrame:
    """(pattern_key, raw): fixed stand-in answers, for runs without a model.

    When ``top_rule`` is present it is quoted in the reasoning.
    """
    top_rule = F.coalesce(F.col("top_rule"), F.lit("")) if "top_rule" in profiled.columns else F.lit("")
    choice = None
    for family, kind, code, confidence, reasoning in S.STATIC_ANSWERS:
        answer = F.to_json(F.struct(
            F.lit(kind).alias("transformation_type"), F.lit(code).alias("code"),
            F.lit(confidence).alias("confidence_score"),
            tx.strip(F.concat(F.lit(reasoning + " "), top_rule)).alias("reasoning"),
            F.lit("null").alias("fallback_value"),
        ))
        applies = F.col("inferred_anomaly_type") == family
        choice = F.when(applies, answer) if choice is None else choice.when(applies, answer)
    return profiled.groupBy("pattern_key").agg(F.min(choice).alias("raw")).withColumn(
        "model_used", F.lit("mock/static")
    )


def json_object(text: Column) -> Column:
    """Text of the first balanced ``{...}``, NULL when there is none.

    The text is split at closing braces; the object ends at the first piece
    where as many braces were closed as opened.
    """
    start = F.locate("{", text)
    pieces = F.split(F.substring(text, start, F.length(text)), r"\}")
    opened = F.transform(pieces, lambda p: F.length(p) - F.length(F.replace(p, F.lit("{"), F.lit(""))))
    state = F.aggregate(
        opened,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("end")),
        lambda s, n: F.struct(
            (s["depth"] + n - 1).alias("depth"),
            (s["seen"] + 1).alias("seen"),
            F.when((s["end"] == 0) & (s["depth"] + n - 1 == 0), s["seen"] + 1).otherwise(s["end"]).alias("end"),
        ),
    )
    # the piece after the last brace closes nothing
    closed = (start > 0) & (state["end"] > 0) & (state["end"] < F.size(pieces))
    return F.when(closed, F.concat(F.concat_ws("}", F.slice(pieces, 1, state["end"])), F.lit("}")))


def parse_responses(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``parsed`` (a decision struct) to a table of raw answers.

    Whatever cannot be used becomes a quarantine decision with the reason.
    Needs ``model_used`` and ``cache_hit``.
    """
    clean = tx.strip(F.col(raw))
    fence = clean.startswith("```")
    inner = F.regexp_replace(F.btrim(clean, F.lit("`")), "^json", "")
    clean = F.when(fence, tx.strip(inner)).otherwise(clean)
    whole = clean.startswith("{") & clean.endswith("}")
    kind = "map<string,string>"
    rows = responses.withColumn("_text", clean)
    rows = rows.withColumn(
        "_data",
        F.coalesce(
            F.when(whole, F.from_json("_text", kind, {"mode": "PERMISSIVE"})),
            F.from_json(json_object(F.col("_text")), kind, {"mode": "PERMISSIVE"}),
        ),
    )
    data = F.col("_data")

    def value(name: str, default: str) -> Column:
        """Text of a key: its default when absent, ``None`` when it is null."""
        return F.when(F.map_contains_key(data, name), F.coalesce(data[name], F.lit("None"))).otherwise(
            F.lit(default)
        )

    given = value("confidence_score", "0.0")
    confidence = F.when(F.lower(given) == "true", F.lit(1.0)).when(
        F.lower(given) == "false", F.lit(0.0)
    ).otherwise(tx.strip(given).try_cast("double"))
    transformation, code = value("transformation_type", "rule"), value("code", S.IDENTITY_CODE)
    reason = (
        F.when(data.isNull(), F.lit("Parse error: no JSON object in response"))
        .when(confidence.isNull(), F.lit("Parse error: confidence_score is not a number"))
        .when(~transformation.isin(*S.TRANSFORMATION_TYPES),
              F.concat(F.lit("Invalid transformation_type: "), transformation))
        .when(transformation.isin("lambda", "rule") & ~code.contains("lambda"),
              F.lit("Invalid code format: lambda expression required."))
        .when(confidence < S.CONFIDENCE_FLOOR,
              F.format_string("Low confidence remediation (%.2f).", confidence))
    )
    accepted = _decision(
        transformation, code, confidence, value("reasoning", ""), value("fallback_value", "null"),
        F.col("model_used"), F.col("cache_hit"), F.col(raw),
    )
    parsed = F.when(reason.isNotNull(), quarantine_decision(F.col("model_used"), F.col(raw), reason)).otherwise(
        accepted
    )
    return rows.withColumn("parsed", parsed).drop("_text", "_data")


def quarantine_decision(model: Column, raw: Column, reason: Column) -> Column:
    return _decision(
        F.lit("quarantine"), F.lit(S.IDENTITY_CODE), F.lit(0.0), reason, F.lit("null"), model,
        F.col("cache_hit"), raw,
    )


def guardrail_plan(kind: Column, confidence: Column, family: Column) -> dict[str, Column]:
    """Action, risk, review flag and checks of a decision."""
    quarantine, staging = kind == "quarantine", confidence < S.AUTO_APPLY_CONFIDENCE

    def pick(make) -> Column:
        plans = S.GUARDRAIL_PLANS
        return (
            F.when(quarantine, make(plans["quarantine"]))
            .when(staging, make(plans["staging"]))
            .otherwise(make(plans["auto"]))
        )

    return {
        "guardrail_action": pick(lambda p: F.lit(p[0])),
        "risk_level": pick(lambda p: F.lit(p[1])),
        "requires_human_review": F.when(quarantine, F.lit(True)).otherwise(
            F.coalesce(staging & (family == "string_corrupt"), F.lit(False))
        ),
        "validation_checks": pick(lambda p: F.array(*map(F.lit, p[2]))),
    }


def best_memories(
    profiled: DataFrame, memory: DataFrame, weights: dict[str, float], k: int, need: str | None = None
) -> DataFrame:
    """Best ``k`` memory rows per cluster by weighted equality of key columns.

    ``memory`` needs ``mem_ord`` (append order) and the weighted columns. Each
    memory row is first kept only if it is among the first k, by age, of one of
    its key combinations; anything else is beaten by k older rows that match
    at least as much. So a key shared by most of the memory costs k rows per
    combination, and the join never pairs whole groups. ``need`` limits the
    combinations to those with that column. Pass a written ``memory``: its rows are counted first.
    """
    names = list(weights)
    combos = [
        [n for i, n in enumerate(names) if bits >> i & 1] for bits in range(1, 2 ** len(names))
    ]
    combos = [c for c in combos if need is None or need in c]

    def keys() -> Column:
        return F.array(*(
            F.struct(
                F.lit(i).alias("combo"),
                F.to_json(F.struct(*(F.col(n) for n in combo)), {"ignoreNullFields": "false"}).alias("key"),
            )
            for i, combo in enumerate(combos)
        ))

    others = [c for c in memory.columns if c not in names and c != "mem_ord"]
    # every combination of a task's rows is sorted there, so tasks get a fixed number of rows
    parts = -(-memory.count() // S.MEMORY_ROWS)
    dealt = memory
    if parts > 1:
        dealt = memory.withColumn("_at", F.monotonically_increasing_id()).repartition(parts, "_at").drop("_at")
    packed = dealt.select(
        *names, "mem_ord", F.struct("mem_ord", *names, *others).alias("memory")
    ).select(F.inline(keys()), "mem_ord", "memory")
    heads = tables.first_per_key(packed, ["combo", "key"], ["mem_ord"], k)
    # at most k rows per combination are left to collect
    heads = heads.groupBy("combo", "key").agg(F.collect_list(F.struct("mem_ord", "memory")).alias("heads"))
    asked = profiled.select("cluster_id", *names, F.inline(keys()))
    met = tables.lookup(asked, tables.cut(heads, "heads"), ["combo", "key"], "inner")
    pairs = met.select("cluster_id", *names, F.inline("heads")).dropDuplicates(["cluster_id", "mem_ord"])
    score = F.lit(0.0)
    for name, weight in weights.items():
        score = score + F.when(
            F.col(name).eqNullSafe(F.col(f"memory.{name}")), F.lit(weight)
        ).otherwise(F.lit(0.0))
    scored = pairs.withColumn("score", F.round(score, 4))
    return tables.first_per_key(
        scored.select("cluster_id", "score", "mem_ord", "memory"),
        ["cluster_id"], [F.desc("score"), "mem_ord"], k,
    )


def remembered_decisions(profiled: DataFrame, memory: DataFrame) -> DataFrame:
    """(cluster_id, remembered): reuse of the best earlier remediation of the same pattern.

    Only the single best row counts; if it is unusable there is no hit.
    """
    best = best_memories(profiled, memory, S.REUSE_WEIGHTS, 1, need="pattern_key")
    row = F.col("memory")

    def given(name: str, default: str) -> Column:
        if name not in memory.columns:
            return F.lit(default)
        return F.coalesce(row[name].cast("string"), F.lit("None"))

    confidence = F.coalesce(row["confidence_score"].cast("double"), F.lit(0.0))
    usable = (confidence >= S.CONFIDENCE_FLOOR) & row["transformation_type"].isin(*S.TRANSFORMATION_TYPES)
    decision = _decision(
        row["transformation_type"], given("code", S.IDENTITY_CODE), confidence,
        given("reasoning", "Loaded remediation from pattern cache."), given("fallback_value", "null"),
        F.lit("cache/remediation_memory"), F.lit(True), F.to_json(row),
    )
    return best.where(usable).select("cluster_id", decision.alias("remembered"))


def remediate(
    profiled: DataFrame, memory: DataFrame | None = None, responses: DataFrame | None = None
) -> DataFrame:
    """One remediation per cluster.

    ``responses`` holds external answers as (pattern_key, raw[, model_used, answered_at]);
    of several answers the newest counts. A cluster that needs one and has none is quarantined.
    """
    rows = profiled
    none = F.lit(None).cast(DECISION)
    if memory is not None:
        rows = rows.join(remembered_decisions(profiled, memory), "cluster_id", "left")
    else:
        rows = rows.withColumn("remembered", none)
    if responses is not None:
        model = F.col("model_used") if "model_used" in responses.columns else F.lit("external")
        age = [F.col("answered_at")] if "answered_at" in responses.columns else []
        answer = F.struct("raw", model.alias("model_used"))
        answers = responses.groupBy("pattern_key").agg(F.max_by(answer, F.struct(*age, answer)).alias("answer"))
        rows = rows.join(answers, "pattern_key", "left").select(*rows.columns, "answer.raw", "answer.model_used")
        rows = parse_responses(rows).withColumn("answered", F.when(F.col("raw").isNotNull(), F.col("parsed")))
    else:
        rows = rows.withColumn("answered", none)
    missing = quarantine_decision(
        F.lit("none"), F.lit(""), F.lit("Provider failure: no response for this pattern")
    )
    chosen = F.coalesce("remembered", deterministic_decision(), "answered", missing)
    rows = rows.withColumn("_chosen", chosen)
    plan = guardrail_plan(
        F.col("_chosen.transformation_type"), F.col("_chosen.confidence_score"), F.col("inferred_anomaly_type")
    )
    kept = [c for c in ("cluster_ord",) if c in rows.columns]
    decided = ("transformation_type", "code", "confidence_score", "reasoning", "fallback_value",
               "model_used", "cache_hit", "raw_response")
    columns = {name: F.col(f"_chosen.{name}") for name in decided} | plan
    return rows.select(
        *(columns[c].alias(c) if c in columns else F.col(c) for c in S.REMEDIATION_COLUMNS), *kept
    )


def memory_records(remediations: DataFrame, recorded_at: str) -> DataFrame:
    """Rows to append to the remediation memory."""
    stamp = "".join(ch for ch in recorded_at if ch.isdigit())
    return remediations.select(
        F.concat(F.lit(f"rem_{stamp}_"), "cluster_uid").alias("memory_id"),
        F.lit(recorded_at).alias("timestamp_utc"),
        "cluster_id", "cluster_uid", "pattern_key", "target_column", "inferred_anomaly_type",
        "transformation_type", "code", "confidence_score", "reasoning", "guardrail_action", "risk_level",
    )


def memory_document(records: DataFrame) -> DataFrame:
    """(id, document, metadata) of memory rows for the vector table."""
    return records.select(
        F.col("memory_id").alias("id"),
        F.to_json(F.struct(
            "target_column",
            F.col("inferred_anomaly_type").alias("anomaly_type"),
            F.col("transformation_type").alias("action"),
            "reasoning",
            F.col("confidence_score").alias("confidence"),
        )).alias("document"),
        F.create_map(*(
            x for c in ("cluster_uid", "pattern_key", "target_column", "inferred_anomaly_type",
                        "transformation_type", "confidence_score")
            for x in (F.lit(c), F.col(c).cast("string"))
        )).alias("metadata"),
    )


def remediation_summary(remediations: DataFrame, provider: str = "table") -> DataFrame:
    """One row: status and counts."""
    total = F.count("*")
    quarantined = F.count_if(F.col("transformation_type") == "quarantine")
    return remediations.agg(
        F.when(total == 0, F.lit("no_clusters")).otherwise(F.lit("completed")).alias("status"),
        total.alias("total"),
        (total - quarantined).alias("remediated"),
        quarantined.alias("quarantined"),
        F.count_if("requires_human_review").alias("requires_human_review"),
        F.lit(provider).alias("provider"),
    )
