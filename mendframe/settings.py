"""Configuration: fixed vocabularies, thresholds, rule tables and validation specs.

Everything here is small driver-side data that is turned into Column
expressions or literals when a plan is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

# --------------------------------------------------------------------------
# Fixed values. They define the results and must not change.
# --------------------------------------------------------------------------

# Characters removed from both ends of a cell before it is judged.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Four different vocabularies of "no value"; each stage has its own.
MISSING_CELL = ("", "null", "none", "nan", "n/a", "na")  # stripped, lower case
MISSING_SAMPLE = ("none", "nan", "null", "")  # lower case, not stripped
MISSING_INPUT = ("null", "None", "none", "NULL", "N/A", "n/a", "")  # exact text

EMAIL_REGEX = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
DATE_REGEX = r"(?:\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}|\p{Nd}{2}/\p{Nd}{2}/\p{Nd}{4}|\p{Nd}{2}-\p{Nd}{2}-\p{Nd}{4})"
# a plain decimal number in which commas may stand anywhere
NUMERIC_REGEX = r",*+(?:-,*+)?+(?:\p{Nd},*+)++(?:\.,*+(?:\p{Nd},*+)++)?+"

# Looser shapes used when guessing the family of a group of samples.
SAMPLE_DATE_REGEX = (
    r"\p{Nd}{1,4}[-/.]\p{Nd}{1,2}[-/.]\p{Nd}{1,4}|[A-Za-z]+ \p{Nd}{1,2} \p{Nd}{4}"
)
SAMPLE_NUMBER_REGEX = r"^-?\p{Nd}+([.,]\p{Nd}+)?$"
TOKEN_REGEX = r"([a-z0-9_]+)"

# Column-name fragments that imply a type; the first type that matches wins.
TYPE_NAME_HINTS = (
    ("email", ("email",)),
    ("date", ("date", "dob", "timestamp")),
    ("numeric", ("amount", "price", "cost", "total", "qty", "quantity", "num", "score")),
)

# error type and hint per failing logical type.
TYPE_ERRORS = {
    "email": ("email_format_error", "email token malformed address"),
    "date": ("date_format_error", "date token format mismatch"),
    "numeric": ("numeric_format_error", "amount contains numeric separator noise"),
}
NULL_ERROR = ("null_block_error", "value is missing or sentinel null")
DUPLICATE_ERROR = ("duplicate_value_error", "duplicate value detected in unique column")
MALFORMED_ERROR = ("malformed_row_error", "row has more or fewer cells than the header")
MALFORMED = "_malformed"  # text of a row that is no proper record, NULL for all others
ROW_ID_COLUMNS = ("id", "row_id", "record_id")
SOURCE_PHASE = "phase1_ingestion"

SIMILARITY_THRESHOLD = 0.85
SAMPLE_ROWS = 5
SAMPLE_VALUES = 5
SAMPLE_VALUE_KEYS = ("column_name", "date", "email", "phone", "amount", "value")
TARGET_COLUMN_KEYS = ("column_name", "field", "column")
FAMILY_SHARE = 0.6
SEVERITY_MEDIUM_SIZE = 10
SEVERITY_HIGH_SIZE = 25

CONFIDENCE_FLOOR = 0.75
AUTO_APPLY_CONFIDENCE = 0.85
RETRIEVAL_TOP_K = 5
STATIC_RULE_WEIGHT = 0.3
BLEND_WEIGHTS = {"source": 0.2, "keyword": 0.3, "vector": 0.5}
HISTORY_WEIGHTS = {"pattern_key": 0.7, "inferred_anomaly_type": 0.2, "target_column": 0.1}
REUSE_WEIGHTS = {"pattern_key": 1.0, "inferred_anomaly_type": 0.2, "target_column": 0.2}
TRANSFORMATION_TYPES = ("lambda", "rule", "quarantine")
FAST_FAMILIES = ("date_format", "type_cast", "null_fill")

IDENTITY_CODE = "lambda x: x"
KEEP_NULL_CODE = "lambda x: x if x is not None else None"
STRIP_COMMAS_CODE = "lambda x: None if x is None else str(x).replace(',', '').strip()"
DROP_COMMAS_CODE = "lambda x: None if x is None else str(x).replace(',', '')"

# family, type, code, confidence, reasoning, fallback is first sample, route.
# "duplicate" is tested first, the rest by inferred family.
DETERMINISTIC_RULES = (
    (
        "duplicate", "rule", IDENTITY_CODE, 0.93,
        "Detected duplicate-value cluster and selected a no-mutation deterministic hold rule.",
        True, "deterministic/duplicate_hold",
    ),
    (
        "date_format", "rule", IDENTITY_CODE, 0.91,
        "Detected date-format cluster and selected a deterministic staging rule for guarded downstream handling.",
        True, "deterministic/date_format",
    ),
    (
        "type_cast", "lambda", STRIP_COMMAS_CODE, 0.92,
        "Detected numeric formatting noise and selected deterministic string normalization.",
        False, "deterministic/type_cast",
    ),
    (
        "null_fill", "rule", KEEP_NULL_CODE, 0.9,
        "Detected null-heavy cluster and selected a null-preserving deterministic rule.",
        False, "deterministic/null_fill",
    ),
)

# family, type, code, confidence, reasoning of the stand-in answers that need no model.
STATIC_ANSWERS = (
    ("date_format", "rule", IDENTITY_CODE, 0.82,
     "Detected mixed date-like values and selected a conservative rule."),
    ("null_fill", "rule", KEEP_NULL_CODE, 0.78,
     "Detected mostly null-like values and chose a null-preserving rule."),
    ("type_cast", "lambda", DROP_COMMAS_CODE, 0.8,
     "Detected numeric-looking values with formatting noise and proposed safe normalization."),
    ("string_corrupt", "quarantine", IDENTITY_CODE, 0.4,
     "Pattern is ambiguous, so the cluster should be quarantined."),
)

# action, risk and checks per remediation class.
GUARDRAIL_PLANS = {
    "quarantine": ("quarantine", "high", ("schema_check", "null_safety_check", "manual_approval")),
    "staging": ("staging_only", "medium",
                ("schema_check", "roundtrip_consistency_check", "null_safety_check")),
    "auto": ("auto_apply_with_audit", "low", ("schema_check", "determinism_check")),
}

REMEDIATION_COLUMNS = (
    "cluster_id", "cluster_uid", "transformation_type", "code", "confidence_score", "reasoning",
    "fallback_value", "inferred_anomaly_type", "model_used", "size", "cache_hit", "pattern_key",
    "guardrail_action", "risk_level", "requires_human_review", "validation_checks", "raw_response",
    "target_column",
)

# A remediation to execute also names its members; what the model said and the target are optional.
CONTRACT_FIELDS = (*(c for c in REMEDIATION_COLUMNS if c not in ("raw_response", "target_column")), "member_ids")

GUARDRAIL_POLICY = {
    "min_confidence_for_review_pass": 0.75,
    "min_confidence_for_promotion": 0.9,
    "max_quarantine_ratio": 0.4,
    "max_execution_failure_ratio": 0.15,
    "max_unmatched_member_ratio": 0.2,
    "max_bad_row_ratio": 0.6,
    "block_high_risk": True,
}
PROMOTION_POLICY = {
    "require_zero_review_items": True,
    "require_zero_quarantined_items": True,
    "require_phase5_completed": True,
    "require_guardrail_artifact": True,
}

# --------------------------------------------------------------------------
# Tuning. These change plans, never results.
# --------------------------------------------------------------------------

BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20
TRUSTED_FILE_BYTES = 4 << 20  # a written table of this file size is small without a measurement
ONE_TASK_ROWS = 200_000  # narrow rows that one task may sort
HOT_KEYS = 1_000  # heaviest keys that are taken out of a shuffle join
SALTS = 1_024
LEADER_BATCH = 1_024  # undecided vectors that one task settles at a time
MEMORY_ROWS = 20_000  # remembered remediations that one task sorts by all their key combinations
KNN_BLOCK_ROWS = 20_000
BLOCK_CELLS = 2_000_000  # array elements of one block held in a task
SAMPLE_LOOKAHEAD = 50  # rows per cluster looked at first for distinct samples
SHAPES_A_PASS = 32  # shapes of repairs compiled into one plan


def merge_policy(defaults: Mapping[str, Any], overrides: Mapping[str, Any] | None) -> dict[str, Any]:
    """Defaults with the caller's overrides on top."""
    return {**defaults, **(overrides or {})}


def type_from_name(column: str) -> str | None:
    """Logical type implied by a column name."""
    name = column.lower()
    for logical, fragments in TYPE_NAME_HINTS:
        if any(fragment in name for fragment in fragments):
            return logical
    return None


def type_error(logical: str) -> tuple[str, str]:
    """Error type and hint for a value that fails its logical type."""
    return TYPE_ERRORS.get(
        logical,
        ("type_validation_error", f"value does not match expected {logical} format"),
    )


@dataclass(frozen=True)
class ValidationSpec:
    """Compiled validation rules: declared types, required and unique columns."""

    types: Mapping[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    unique_listed: bool = False

    @classmethod
    def build(
        cls,
        schema: Mapping[str, Any] | None = None,
        required_columns: Iterable[str] | None = None,
    ) -> "ValidationSpec":
        """Compile ``{"columns": {name: {type, required, unique}}, "unique_columns": [...]}``.

        An explicit ``required_columns`` list, even an empty one, beats the
        flags in the schema; so does ``unique_columns``.
        """
        schema = schema or {}
        declared = schema.get("columns")
        entries = {
            str(name): entry
            for name, entry in (declared.items() if isinstance(declared, Mapping) else ())
            if isinstance(entry, Mapping)
        }
        types = {
            name: entry["type"].strip().lower()
            for name, entry in entries.items()
            if isinstance(entry.get("type"), str) and entry["type"].strip()
        }

        def flagged(flag: str) -> tuple[str, ...]:
            return tuple(name for name, entry in entries.items() if entry.get(flag) is True)

        listed = schema.get("unique_columns")
        has_list = isinstance(listed, (list, tuple))
        return cls(
            types=types,
            required=flagged("required") if required_columns is None
            else tuple(map(str, required_columns)),
            unique=tuple(map(str, listed)) if has_list else flagged("unique"),
            unique_listed=bool(has_list and listed),
        )

    def logical_type(self, column: str) -> str | None:
        """Declared type if there is one, else the type implied by the name."""
        return self.types.get(column) or type_from_name(column)

    def rule_names(self) -> list[str]:
        """Rules reported as applied; ``duplicate`` only for an explicit list."""
        return sorted(["date", "email", "numeric", "required"] + ["duplicate"] * self.unique_listed)
