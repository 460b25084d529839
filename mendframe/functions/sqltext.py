"""Expressions as SQL text, written with the names of ``pyspark.sql.functions``.

A compiled repair has thousands of small parts. Building each as a Column costs a call
into the JVM; here they are text, and one ``expr`` hands a whole step over.
"""

from __future__ import annotations

import decimal
import inspect
import itertools
import math
from collections.abc import Callable
from typing import Any

_names = itertools.count()


class Sql:
    """A piece of SQL in brackets of its own."""

    __slots__ = ("text", "name")
    __hash__ = None  # type: ignore[assignment]

    def __init__(self, text: str, name: str | None = None) -> None:
        self.text, self.name = text, name

    def _with(self, sign: str, other: Any) -> Sql:
        return Sql(f"({self.text} {sign} {lit(other).text})")

    def __add__(self, other): return self._with("+", other)  # noqa: E704
    def __sub__(self, other): return self._with("-", other)  # noqa: E704
    def __mul__(self, other): return self._with("*", other)  # noqa: E704
    def __truediv__(self, other): return self._with("/", other)  # noqa: E704
    def __mod__(self, other): return self._with("%", other)  # noqa: E704
    def __eq__(self, other): return self._with("=", other)  # noqa: E704
    def __ne__(self, other): return self._with("<>", other)  # noqa: E704
    def __lt__(self, other): return self._with("<", other)  # noqa: E704
    def __le__(self, other): return self._with("<=", other)  # noqa: E704
    def __gt__(self, other): return self._with(">", other)  # noqa: E704
    def __ge__(self, other): return self._with(">=", other)  # noqa: E704
    def __and__(self, other): return self._with("AND", other)  # noqa: E704
    def __or__(self, other): return self._with("OR", other)  # noqa: E704
    def __rmul__(self, other): return lit(other) * self  # noqa: E704
    def __invert__(self): return Sql(f"(NOT {self.text})")  # noqa: E704
    def __neg__(self): return Sql(f"(- {self.text})")  # noqa: E704

    def __getitem__(self, key: Any) -> Sql:
        return Sql(f"{self.text}.`{key}`" if isinstance(key, str) else f"{self.text}[{lit(key).text}]")

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self.text} AS {kind})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"TRY_CAST({self.text} AS {kind})")

    def alias(self, name: str) -> Sql:
        return Sql(self.text, name)

    def isin(self, *values: Any) -> Sql:
        return Sql(f"({self.text} IN ({', '.join(lit(v).text for v in values)}))")

    def between(self, low: Any, high: Any) -> Sql:
        return (self >= low) & (self <= high)

    def isNull(self) -> Sql:
        return Sql(f"({self.text} IS NULL)")

    def isNotNull(self) -> Sql:
        return Sql(f"({self.text} IS NOT NULL)")

    def rlike(self, pattern: str) -> Sql:
        return Sql(f"({self.text} RLIKE {lit(pattern).text})")

    def contains(self, other: Any) -> Sql:
        return call("contains", self, other)

    def startswith(self, other: Any) -> Sql:
        return call("startswith", self, other)


class Case(Sql):
    """CASE with the branches so far; NULL where none holds."""

    __slots__ = ("branches",)

    def __init__(self, branches: str) -> None:
        super().__init__(f"CASE{branches} END")
        self.branches = branches

    def when(self, test: Sql, value: Any) -> Case:
        return Case(f"{self.branches} WHEN {test.text} THEN {lit(value).text}")

    def otherwise(self, value: Any) -> Sql:
        return Sql(f"CASE{self.branches} ELSE {lit(value).text} END")


def lit(value: Any) -> Sql:
    if isinstance(value, Sql):
        return value
    if value is None:
        return Sql("NULL")
    if isinstance(value, bool):
        return Sql(str(value).upper())
    if isinstance(value, int):
        return Sql(str(value) if abs(value) < 1 << 31 else f"{value}L")
    if isinstance(value, float):
        usual = math.isfinite(value) and math.copysign(1, value) > 0  # a minus sign would be an operation
        return Sql(f"{value!r}D" if usual else f"CAST('{value}' AS DOUBLE)")
    if isinstance(value, decimal.Decimal):
        return Sql(f"{value}BD")
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return Sql(f"'{escaped}'")


def col(name: str) -> Sql:
    return Sql(f"`{name}`")


def when(test: Sql, value: Any) -> Case:
    return Case("").when(test, value)


def call(name: str, *arguments: Any) -> Sql:
    return Sql(f"{name}({', '.join(lit(a).text for a in arguments)})")


def _lambda(body: Callable[..., Sql]) -> str:
    names = [f"v{next(_names)}" for _ in inspect.signature(body).parameters]
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"  # the grammar has no brackets around one name
    return f"{head} -> {lit(body(*map(Sql, names))).text}"


def transform(items: Sql, body: Callable[..., Sql]) -> Sql:
    return Sql(f"transform({items.text}, {_lambda(body)})")


def aggregate(items: Sql, start: Sql, body: Callable[..., Sql]) -> Sql:
    return Sql(f"aggregate({items.text}, {start.text}, {_lambda(body)})")


def struct(*parts: Sql) -> Sql:
    return Sql(f"named_struct({', '.join(f'{lit(p.name).text}, {p.text}' for p in parts)})")


def __getattr__(name: str) -> Callable[..., Sql]:
    """Any other function goes by its own name."""
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *arguments: call(name, *arguments)
