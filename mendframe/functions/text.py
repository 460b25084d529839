"""Text predicates and projections as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mendframe import settings as S


# the characters of settings.WHITESPACE as a class
_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
EDGE = f"^{_SPACE}|{_SPACE}$"


def _stripped_match(text: Column, regex: str) -> Column:
    """Full match of the stripped text, without building it."""
    return text.rlike(f"^{_SPACE}*+{regex}{_SPACE}*+$")


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends (plain ``trim`` drops only spaces).

    Trimming a character set is slow, so it is done only where an end needs it.
    """
    return F.when(text.rlike(EDGE), F.btrim(text, F.lit(S.WHITESPACE))).otherwise(text)


def is_missing(text: Column) -> Column:
    """True for NULL and for the sentinel texts that stand for no value."""
    words = "|".join(word for word in S.MISSING_CELL if word)
    return text.isNull() | _stripped_match(text, f"(?:(?i){words})?+")


def is_email(text: Column) -> Column:
    return _stripped_match(text, S.EMAIL_REGEX)


def is_date_shape(text: Column) -> Column:
    """Shape only: ``31/31/2024`` passes."""
    return _stripped_match(text, S.DATE_REGEX)


def is_number(text: Column) -> Column:
    """A plain decimal number once all commas are removed."""
    return _stripped_match(text, S.NUMERIC_REGEX)


FORMAT_CHECKS = {"email": is_email, "date": is_date_shape, "numeric": is_number}


def dedup_key(text: Column) -> Column:
    """Key under which two values count as the same; NULL for missing values."""
    return F.when(~is_missing(text), F.lower(strip(text)))


def tokens(text: Column) -> Column:
    """Distinct lower-case word tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(S.TOKEN_REGEX)))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of two token sets, 0 when either is empty."""
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right))
    )


def key_value_text(values: dict[str, Column]) -> Column:
    """``a=1 b=2`` over sorted names; NULL prints as ``None``."""
    return F.concat_ws(
        " ",
        *(F.concat(F.lit(f"{name}="), F.coalesce(values[name], F.lit("None"))) for name in sorted(values)),
    )


def text_number(hex_digits: Column) -> Column:
    """Hex text of at most 15 digits as an exact decimal."""
    return F.conv(hex_digits, 16, 10).cast("decimal(38,0)")


def decimal_text(column: Column, places: int) -> Column:
    """Number as text with a fixed number of places."""
    return F.format_string(f"%.{places}f", column)
