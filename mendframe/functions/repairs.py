"""Repairs as Columns: a compiler from checked repair trees to Spark expressions.

A repair is a small program over one value. Its constants are taken out, which leaves
a shape; codes of one shape share one set of expressions and bring their constants along
by a join. A value of a repair is one of NULL, boolean, whole number, float or text, which
may differ from row to row, so every step gives a register: a kind, the value under that
kind, and the reason why the step failed. Steps of equal depth of all shapes share their
registers. Operations never raise: a failure is a value like any other, passed on by what
uses it and dropped where a branch is not taken.
"""

from __future__ import annotations

import ast
import copy
import decimal
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from mendframe import settings as S
from mendframe.functions import sqltext as F
from mendframe.functions import text as tx
from mendframe.functions.sqltext import Sql

NONE, BOOL, INT, FLOAT, STR = range(5)
_NAMES = {NONE: "NoneType", BOOL: "bool", INT: "int", FLOAT: "float", STR: "str"}
_INT = "decimal(38,0)"  # whole numbers have up to 38 digits
_DIGITS = 38
RESULT_CHARS = 64 << 20  # characters that a repeated text may have

# Texts of failures.
MISSING_OPERAND = "operation on a missing value"
TOO_LARGE = "the number has more than 38 digits"
TOO_LONG = "the result does not fit into memory"
NO_VALUE = "a repair must return a value"
ONE_VALUE = "a repair takes one value"
ZERO = "division by zero"
TOO_DEEP = "round() takes up to 22 places"


@dataclass(frozen=True)
class Term:
    """A value: the kinds it may have, which it has (``k``, needless for a single kind), the value per kind, its failure."""

    kinds: frozenset[int]
    k: Sql | None = None
    i: Sql | None = None  # booleans are 0 and 1
    f: Sql | None = None
    s: Sql | None = None
    e: Sql | None = None  # None: never fails
    items: tuple[Term, ...] | None = None  # of a list or tuple
    keys: tuple[Term, ...] | None = None  # of a dict, beside its items

    def has(self, *kinds: int) -> Sql:
        """Whether the value is of one of the kinds."""
        if self.kinds <= set(kinds):
            return F.lit(True)
        inside = sorted(self.kinds & set(kinds))
        return self.kind().isin(*inside) if inside else F.lit(False)

    def kind(self) -> Sql:
        return F.lit(min(self.kinds)).cast("tinyint") if len(self.kinds) == 1 else self.k

    def under(self, kind: int) -> Sql:
        """The value, if it is of that kind; numbers widen."""
        if kind == FLOAT:
            if FLOAT not in self.kinds:
                return self.i.cast("double")
            return self.f if not self.kinds & {BOOL, INT} else F.when(self.has(FLOAT), self.f).otherwise(self.i.cast("double"))
        return self.s if kind == STR else self.i

    @property
    def plain(self) -> bool:
        return self.items is None


def none() -> Term:
    return Term(frozenset([NONE]))


def truth_value(holds: Sql, error: Sql | None = None) -> Term:
    return Term(frozenset([BOOL]), i=holds.cast("int").cast(_INT), e=error)


def whole(value: Sql, error: Sql | None = None) -> Term:
    return Term(frozenset([INT]), i=value, e=error)


def floating(value: Sql, error: Sql | None = None) -> Term:
    return Term(frozenset([FLOAT]), f=value, e=error)


def textual(value: Sql, error: Sql | None = None) -> Term:
    return Term(frozenset([STR]), s=value, e=error)


def failure(reason: str) -> Term:
    return Term(frozenset([NONE]), e=F.lit(reason))


def first_error(*errors: Sql | None) -> Sql | None:
    known = [e for e in errors if e is not None]
    return None if not known else known[0] if len(known) == 1 else F.coalesce(*known)


def failing(test: Sql, reason: str | Sql) -> Sql:
    return F.when(test, F.lit(reason) if isinstance(reason, str) else reason)


@dataclass
class Cases:
    """A value by conditions, tried in order; what meets none of them fails with ``otherwise``."""

    otherwise: Sql
    arms: list[tuple[Sql, Term]] = field(default_factory=list)

    def add(self, test: Sql, term: Term) -> Cases:
        self.arms.append((test, term))
        return self

    def term(self, before: Sql | None = None, complete: bool = False) -> Term:
        """One value. ``before`` is a failure that comes first; ``complete``: some condition always holds."""
        if not self.arms:
            return Term(frozenset([NONE]), e=first_error(before, self.otherwise))
        kinds = frozenset().union(*(t.kinds for _, t in self.arms))

        def chosen(part: Callable[[Term], Sql | None]) -> Sql | None:
            parts = [(test, part(t)) for test, t in self.arms]
            if all(p is None for _, p in parts):
                return None
            result = None
            for test, p in parts:
                if p is None:
                    p = F.lit(None)
                result = F.when(test, p) if result is None else result.when(test, p)
            return result

        k = chosen(lambda t: t.kind()) if len(kinds) > 1 else None
        error = chosen(lambda t: t.e)
        if not complete:
            known = F.lit(False)
            for test, _ in self.arms:
                known = known | test
            error = F.when(~F.coalesce(known, F.lit(False)), self.otherwise).otherwise(F.lit(None) if error is None else error)
        error = first_error(before, error)
        parts = {n: chosen(lambda t, n=n: getattr(t, n)) for n in ("i", "f", "s")}
        return Term(kinds, k=k, e=error, **parts)


# ---- parts of Python's behaviour


def bound(value: Sql, use: Callable[[Sql], Sql]) -> Sql:
    """``use`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def without_edges(text: Sql) -> Sql:
    """Text without white space at both ends."""
    return F.when(text.rlike(tx.EDGE), F.btrim(text, S.WHITESPACE)).otherwise(text)


def negative(number: Sql) -> Sql:
    """A whole number with the other sign; a minus sign would round beyond 34 digits."""
    return F.try_subtract(F.lit(0).cast(_INT), number).try_cast(_INT)


def size_of(number: Sql) -> Sql:
    return F.when(number < 0, negative(number)).otherwise(number)


def kind_name(term: Term) -> Sql:
    if len(term.kinds) == 1:
        return F.lit(_NAMES[min(term.kinds)])
    name = None
    for kind in sorted(term.kinds):
        name = F.when(term.k == kind, _NAMES[kind]) if name is None else name.when(term.k == kind, _NAMES[kind])
    return name


def wrong_kind(action: str, *terms: Term) -> Sql:
    """Failure of an operation on values that it does not take; NULL operands have a text of their own."""
    missing = F.lit(False)
    for term in terms:
        missing = missing | term.has(NONE)
    names = [F.lit(f"{action}: ")]
    for term in terms:
        names += [kind_name(term), F.lit(" and ")]
    return F.when(missing, F.lit(MISSING_OPERAND)).otherwise(F.concat(*names[:-1]))


def truth(term: Term) -> Sql:
    if not term.plain:
        return F.lit(bool(term.items))
    holds = F.lit(False)
    for kind in term.kinds - {NONE}:
        yes = term.s != "" if kind == STR else term.f != 0 if kind == FLOAT else term.i != 0
        holds = holds | (term.has(kind) & yes)
    return F.coalesce(holds, F.lit(False))


def equal(left: Term, right: Term) -> Sql:
    if not left.plain or not right.plain:
        if left.plain or right.plain or len(left.items) != len(right.items) or (left.keys is None) != (right.keys is None):
            return F.lit(False)
        same = F.lit(True)
        for a, b in zip((*left.items, *(left.keys or ())), (*right.items, *(right.keys or ()))):
            same = same & equal(a, b)
        return same
    same = F.lit(False)
    if NONE in left.kinds & right.kinds:
        same = same | (left.has(NONE) & right.has(NONE))
    if STR in left.kinds & right.kinds:
        same = same | (left.has(STR) & right.has(STR) & (left.s == right.s))
    exact, numbers = {BOOL, INT}, {BOOL, INT, FLOAT}
    if left.kinds & exact and right.kinds & exact:
        same = same | (left.has(*exact) & right.has(*exact) & (left.i == right.i))
    if left.kinds & numbers and right.kinds & numbers and FLOAT in left.kinds | right.kinds:
        a, b = left.under(FLOAT), right.under(FLOAT)
        floats = left.has(*numbers) & right.has(*numbers) & (left.has(FLOAT) | right.has(FLOAT))
        same = same | (floats & (a == b) & ~F.isnan(a))
    return F.coalesce(same, F.lit(False))


_GROUPED = r"[0-9](?:_?[0-9])*"
_WHOLE = f"^[+-]?{_GROUPED}$"
_FLOAT = rf"^[+-]?(?:(?:{_GROUPED}(?:\.(?:{_GROUPED})?)?|\.{_GROUPED})(?:[eE][+-]?{_GROUPED})?|(?i:nan|inf|infinity))$"


def shown(text: Sql) -> Sql:
    return F.concat(F.lit("'"), text, F.lit("'"))


def to_int(term: Term) -> Term:
    cases = Cases(wrong_kind("int() of", term))
    if STR in term.kinds:
        bare = without_edges(term.s)
        number = F.replace(bare, F.lit("_"), F.lit("")).try_cast(_INT)
        error = F.when(~bare.rlike(_WHOLE), F.concat(F.lit("invalid literal for int(): "), shown(term.s))).when(
            number.isNull(), F.lit(TOO_LARGE)
        )
        cases.add(term.has(STR), whole(number, error))
    if term.kinds & {BOOL, INT}:
        cases.add(term.has(BOOL, INT), whole(term.i))
    if FLOAT in term.kinds:
        number = exact_whole(term.f)
        error = F.when(F.isnan(term.f), F.lit("cannot convert float NaN to integer")).when(
            number.isNull(), F.lit(TOO_LARGE)
        )
        cases.add(term.has(FLOAT), whole(number, error))
    return cases.term(term.e, complete=NONE not in term.kinds)


def exact_whole(number: Sql) -> Sql:
    """The whole part of a float with all its digits, NULL beyond 38 of them.

    A cast would go by the shortest text of the float; its three parts of 53 bits are exact.
    """
    step = float(1 << 53)
    limb = F.lit(decimal.Decimal(1 << 53)).cast(_INT)

    def part(x: Sql) -> Sql:
        return F.floor(x).cast("bigint").cast(_INT)

    def joined(x: Sql) -> Sql:
        high = F.floor(x / (step * step)).cast("double")

        def lower(rest: Sql) -> Sql:
            middle = F.floor(rest / step).cast("double")
            return bound(middle, lambda m: F.try_add(
                F.try_multiply(F.try_add(F.try_multiply(part(high), limb).try_cast(_INT), part(m)).try_cast(_INT), limb).try_cast(_INT),
                part(rest - m * step),
            ).try_cast(_INT))

        return bound(x - high * (step * step), lower)

    def signed(x: Sql) -> Sql:
        exact = F.when(F.abs(x) < step, F.floor(F.abs(x)).cast("bigint").cast(_INT)).when(F.abs(x) < 1e39, joined(F.abs(x)))
        return bound(exact, lambda n: F.when(x < 0, negative(n)).otherwise(n))

    return bound(number, signed)


def to_float(term: Term) -> Term:
    cases = Cases(wrong_kind("float() of", term))
    if STR in term.kinds:
        bare = without_edges(term.s)
        number = F.replace(bare, F.lit("_"), F.lit("")).try_cast("double")
        error = F.when(~bare.rlike(_FLOAT), F.concat(F.lit("could not convert string to float: "), shown(term.s)))
        cases.add(term.has(STR), floating(number, error))
    if term.kinds & {BOOL, INT, FLOAT}:
        cases.add(term.has(BOOL, INT, FLOAT), floating(term.under(FLOAT)))
    return cases.term(term.e, complete=NONE not in term.kinds)


def float_text(number: Sql) -> Sql:
    """The shortest digits that give the same float again, as Python writes them.

    Floats under 2.3e-308, which hold fewer digits, may show one digit more.
    """

    def digits(places: int) -> Sql:
        return F.format_string(f"%.{places}e", number)

    def same(text: Sql) -> Sql:
        return text.try_cast("double") == number

    short = F.when(same(digits(14)), digits(14)).when(same(digits(15)), digits(15)).otherwise(digits(16))

    def parts(text: Sql) -> Sql:
        some = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)e", 1), r"\.", ""), "0+$", "")
        return F.struct(
            F.when(some == "", F.lit("0")).otherwise(some).alias("d"), F.regexp_extract(text, "e([+-][0-9]+)$", 1).try_cast("int").alias("p"),
            F.when(text.startswith("-"), F.lit("-")).otherwise(F.lit("")).alias("sign"),
        )

    def written(t: Sql) -> Sql:
        some, power, sign = t["d"], t["p"], t["sign"]
        count = F.length(some)
        exponent = F.abs(power).cast("string")
        scientific = F.concat(
            sign, F.substring(some, F.lit(1), F.lit(1)), F.when(count > 1, F.concat(F.lit("."), F.substring(some, F.lit(2), count))).otherwise(F.lit("")),
            F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(exponent, F.greatest(F.lit(2), F.length(exponent)), "0"),
        )
        before = F.substring(F.rpad(some, F.greatest(count, power + 1), "0"), F.lit(1), power + 1)
        after = F.when(count > power + 1, F.substring(some, power + 2, count)).otherwise(F.lit("0"))
        positional = F.when(power >= 0, F.concat(sign, before, F.lit("."), after)).otherwise(
            F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), some)
        )
        return F.when((power >= -4) & (power < 16), positional).otherwise(scientific)

    plain = (F.abs(number) < 1e15) & (F.floor(number) == number) & (number != 0)
    return (
        F.when(F.isnan(number), F.lit("nan"))
        .when(number == float("inf"), F.lit("inf"))
        .when(number == float("-inf"), F.lit("-inf"))
        .when(plain, F.concat(number.try_cast("bigint").cast("string"), F.lit(".0")))
        .otherwise(bound(bound(short, parts), written))
    )


def to_str(term: Term) -> Term:
    if len(term.kinds) == 1 and STR in term.kinds:
        return term
    value = F.lit("None")
    for kind in sorted(term.kinds - {NONE}):
        text = {
            BOOL: lambda: F.when(term.i != 0, F.lit("True")).otherwise(F.lit("False")),
            INT: lambda: term.i.cast("string"), FLOAT: lambda: float_text(term.f), STR: lambda: term.s,
        }[kind]()
        value = F.when(term.has(kind), text).otherwise(value)
    return textual(value, term.e)


def ordered(left: Term, right: Term, action: str) -> tuple[Sql, Sql | None]:
    """(left < right, failure)."""
    numbers = {BOOL, INT, FLOAT}
    less, known = F.lit(False), F.lit(False)
    complete = (left.kinds <= numbers and right.kinds <= numbers) or left.kinds | right.kinds == {STR}
    if STR in left.kinds & right.kinds:
        both = left.has(STR) & right.has(STR)
        less, known = F.when(both, left.s < right.s).otherwise(less), known | both
    if left.kinds & numbers and right.kinds & numbers:
        both = left.has(*numbers) & right.has(*numbers)
        if FLOAT in left.kinds | right.kinds:
            a, b = left.under(FLOAT), right.under(FLOAT)
            inexact = left.has(FLOAT) | right.has(FLOAT)
            smaller = F.when(inexact, (a < b) & ~F.isnan(b))
            if left.kinds & {BOOL, INT} and right.kinds & {BOOL, INT}:
                smaller = smaller.otherwise(left.i < right.i)
        else:
            smaller = left.i < right.i
        less, known = F.when(both, smaller).otherwise(less), known | both
    return less, None if complete else F.when(~known, wrong_kind(action, left, right))


def extreme(terms: list[Term], smallest: bool) -> Term:
    """min() or max() of two or more values: the first of those that no other beats."""
    best = terms[0]
    for other in terms[1:]:
        less, error = ordered(other, best, "comparison of") if smallest else ordered(best, other, "comparison of")
        cases = Cases(F.lit(MISSING_OPERAND)).add(less, other).add(F.lit(True), best)
        chosen = cases.term(complete=True)
        best = Term(chosen.kinds, chosen.k, chosen.i, chosen.f, chosen.s, first_error(best.e, other.e, error))
    return best


def _number_pair(left: Term, right: Term) -> tuple[Sql, Sql, bool, bool]:
    """(both whole, both numbers, can both be whole, can one be a float)."""
    numbers, exact = {BOOL, INT, FLOAT}, {BOOL, INT}
    whole_pair = bool(left.kinds & exact and right.kinds & exact)
    float_pair = bool(left.kinds & numbers and right.kinds & numbers and FLOAT in left.kinds | right.kinds)
    return left.has(*exact) & right.has(*exact), left.has(*numbers) & right.has(*numbers), whole_pair, float_pair


def _complete(left: Term, right: Term) -> bool:
    return left.kinds | right.kinds <= {BOOL, INT, FLOAT}


def _digits_checked(value: Sql) -> Term:
    return whole(value, F.when(value.isNull(), F.lit(TOO_LARGE)))


def _plus_minus(left: Term, right: Term, sign: int) -> Term:
    cases = Cases(wrong_kind("+ of" if sign > 0 else "- of", left, right))
    both_whole, both, can_whole, can_float = _number_pair(left, right)
    complete = _complete(left, right)
    if sign > 0 and STR in left.kinds & right.kinds:
        cases.add(left.has(STR) & right.has(STR), textual(F.concat(left.s, right.s)))
        complete = complete or left.kinds | right.kinds == {STR}
    if can_whole:
        total = (F.try_add if sign > 0 else F.try_subtract)(left.i, right.i).try_cast(_INT)
        cases.add(both_whole, _digits_checked(total))
    if can_float:
        a, b = left.under(FLOAT), right.under(FLOAT)
        cases.add(both, floating(a + b if sign > 0 else a - b))
    return cases.term(first_error(left.e, right.e), complete)


def add(left: Term, right: Term) -> Term:
    if not left.plain and not right.plain and left.keys is None and right.keys is None:
        return Term(frozenset([NONE]), e=first_error(left.e, right.e), items=left.items + right.items)
    return _plus_minus(left, right, 1)


def subtract(left: Term, right: Term) -> Term:
    return _plus_minus(left, right, -1)


def multiply(left: Term, right: Term) -> Term:
    cases = Cases(wrong_kind("* of", left, right))
    both_whole, both, can_whole, can_float = _number_pair(left, right)
    if can_whole:
        cases.add(both_whole, _digits_checked(F.try_multiply(left.i, right.i).try_cast(_INT)))
    if can_float:
        cases.add(both, floating(left.under(FLOAT) * right.under(FLOAT)))
    for text, times in ((left, right), (right, left)):
        if STR in text.kinds and times.kinds & {BOOL, INT}:
            size = F.length(text.s).cast(_INT)
            count = F.when(times.i < 0, F.lit(0)).otherwise(times.i).cast(_INT)
            fits = (size == 0) | (count <= F.lit(RESULT_CHARS)) & (F.try_multiply(size, count) <= RESULT_CHARS)
            made = F.when(size == 0, F.lit("")).when(fits, F.repeat(text.s, count.try_cast("int")))
            cases.add(text.has(STR) & times.has(BOOL, INT), textual(made, F.when(~F.coalesce(fits, F.lit(False)), F.lit(TOO_LONG))))
    return cases.term(first_error(left.e, right.e), _complete(left, right))


def divide(left: Term, right: Term) -> Term:
    """A float; operands beyond 2 ** 53 are rounded to floats first."""
    cases = Cases(wrong_kind("/ of", left, right))
    numbers = {BOOL, INT, FLOAT}
    if left.kinds & numbers and right.kinds & numbers:
        a, b = left.under(FLOAT), right.under(FLOAT)
        value = F.when(b != 0, F.try_divide(a, b))
        cases.add(left.has(*numbers) & right.has(*numbers), floating(value, F.when(b == 0, F.lit(ZERO))))
    return cases.term(first_error(left.e, right.e), _complete(left, right))


def remainder(left: Term, right: Term) -> Term:
    """The remainder with the sign of the divisor; texts have no formats here."""
    cases = Cases(wrong_kind("% of", left, right))
    both_whole, both, can_whole, can_float = _number_pair(left, right)

    def floored(a: Sql, b: Sql, zero: Sql) -> Sql:
        rest = F.when(b != 0, a % F.when(b != 0, b))
        return bound(rest, lambda r: F.when(r == 0, zero).when((r < 0) != (b < 0), r + b).otherwise(r))

    if can_whole:
        value = floored(left.i, right.i, F.lit(0).cast(_INT)).cast(_INT)
        cases.add(both_whole, whole(value, F.when(right.i == 0, F.lit(ZERO))))
    if can_float:
        a, b = left.under(FLOAT), right.under(FLOAT)
        endless = F.isnan(b) | (F.abs(b) != float("inf"))  # a % inf is a, or inf where signs differ
        value = F.when(endless, floored(a, b, b * 0.0)).otherwise(
            F.when(F.isnan(a) | (F.abs(a) == float("inf")), F.lit(float("nan"))).when((a != 0) & ((a < 0) != (b < 0)), b).otherwise(a)
        )
        cases.add(both, floating(value, F.when(b == 0, F.lit(ZERO))))
    return cases.term(first_error(left.e, right.e), _complete(left, right))


def power(left: Term, right: Term) -> Term:
    cases = Cases(wrong_kind("** of", left, right))
    both_whole, both, can_whole, can_float = _number_pair(left, right)
    if can_whole:
        base, times = left.i, right.i
        # beyond 127 times any base but 0, 1 and -1 leaves 38 digits
        steps = F.least(times, F.when(base.between(-1, 1), F.lit(2) + times % 2).otherwise(F.lit(127)).cast(_INT)).cast("int")
        one = F.lit(1).cast(_INT)
        folded = F.aggregate(
            F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), one, lambda made, _: F.try_multiply(made, base).try_cast(_INT)
        )
        value = F.when(times == 0, one).otherwise(folded)
        fits = F.when(times > 127, base.between(-1, 1)).otherwise(value.isNotNull())
        cases.add(both_whole & (times >= 0), whole(value, F.when(~fits, F.lit(TOO_LARGE))))
    if can_whole or can_float:
        a, b = left.under(FLOAT), right.under(FLOAT)
        value = F.when(a == 1, F.lit(1.0)).otherwise(F.pow(a, b))
        finite = (F.abs(a) != float("inf")) & (F.abs(b) != float("inf")) & ~F.isnan(a) & ~F.isnan(b)
        error = (
            F.when((a == 0) & (b < 0), F.lit("zero to a negative power"))
            .when(finite & (a < 0) & (F.floor(b) != b), F.lit("the result is a complex number"))
            .when(finite & (F.abs(value) == float("inf")), F.lit("the result is too large"))
        )
        cases.add(both, floating(value, error))
    return cases.term(first_error(left.e, right.e), _complete(left, right))


OPERATIONS = {ast.Add: add, ast.Sub: subtract, ast.Mult: multiply, ast.Div: divide, ast.Mod: remainder, ast.Pow: power}


def sign_changed(term: Term, minus: bool) -> Term:
    cases = Cases(wrong_kind("sign of", term))
    if term.kinds & {BOOL, INT}:
        cases.add(term.has(BOOL, INT), whole(negative(term.i) if minus else term.i))
    if FLOAT in term.kinds:
        cases.add(term.has(FLOAT), floating(-term.f if minus else term.f))
    return cases.term(term.e, term.kinds <= {BOOL, INT, FLOAT})


def absolute(term: Term) -> Term:
    cases = Cases(wrong_kind("abs() of", term))
    if term.kinds & {BOOL, INT}:
        cases.add(term.has(BOOL, INT), whole(size_of(term.i)))
    if FLOAT in term.kinds:
        cases.add(term.has(FLOAT), floating(F.abs(term.f)))
    return cases.term(term.e, term.kinds <= {BOOL, INT, FLOAT})


def _half_even(number: Sql, places: Sql) -> Sql:
    """A float rounded to decimal places (22 at most, either way) by its exact value, half to even.

    Scaling by a power of ten is exact in two parts, a result and its error by halves of
    26 bits, so a value beside a half is never taken for the half.
    """
    split = float((1 << 27) + 1)

    def halves(x: Sql) -> Sql:
        high = split * x - (split * x - x)
        return F.struct(x.alias("x"), high.alias("h"), (x - high).alias("l"))

    def nearest(scaled: Sql, error: Sql) -> Sql:
        low = F.floor(scaled).cast("double")

        def chosen(at: Sql) -> Sql:
            over = scaled - at  # exact: both lie within one
            tie = (over == 0.5) & (error == 0)
            below = (over < 0.5) | ((over == 0.5) & (error < 0)) | (tie & (at % 2 == 0))
            return F.when(below, at).otherwise(at + 1)

        return bound(low, chosen)

    def by(n: Sql, t: Sql) -> Sql:
        """n times the power of ten, rounded, and back."""
        def use(product: Sql) -> Sql:
            error = ((n["h"] * t["h"] - product) + n["h"] * t["l"] + n["l"] * t["h"]) + n["l"] * t["l"]
            # from 2 ** 53 on the places lie closer together than floats
            return F.when(F.abs(product) >= float(1 << 53), n["x"]).otherwise(bound(error, lambda e: nearest(product, e)) / t["x"])

        return bound(n["x"] * t["x"], use)

    def under(n: Sql, t: Sql) -> Sql:
        """n over the power of ten, rounded, and back."""
        def use(q: Sql) -> Sql:
            rest = (n["x"] - q["h"] * t["h"] - q["h"] * t["l"] - q["l"] * t["h"]) - q["l"] * t["l"]
            return F.when(F.abs(q["x"]) >= float(1 << 53), n["x"]).otherwise(bound(rest, lambda e: nearest(q["x"], e)) * t["x"])

        return bound(halves(n["x"] / t["x"]), use)

    def result(n: Sql) -> Sql:
        ten = F.pow(F.lit(10.0), F.least(F.abs(places), F.lit(22)).cast("double"))
        made = bound(halves(ten), lambda t: F.when(places >= 0, by(n, t)).otherwise(under(n, t)))
        return F.when(n["x"] == 0, n["x"]).otherwise(bound(made, lambda r: F.when((r == 0) & (n["x"] < 0), F.lit(-0.0)).otherwise(r)))

    return bound(bound(number, halves), result)


def rounded(term: Term, places: Term | None) -> Term:
    cases = Cases(wrong_kind("round() of", term))
    by = None if places is None or places.kinds == {NONE} else places
    error = first_error(term.e, None if places is None else places.e)
    if by is not None and not by.kinds <= {NONE, BOOL, INT}:
        return Term(frozenset([NONE]), e=first_error(error, wrong_kind("round() to", by)))
    bare = by is None or NONE in by.kinds
    without = F.lit(True) if by is None else by.has(NONE)
    digits = None if by is None else F.greatest(F.least(by.i, F.lit(400)), F.lit(-400)).cast("int")
    if FLOAT in term.kinds:
        if bare:
            value = exact_whole(_half_even(term.f, F.lit(0)))
            fails = F.when(F.isnan(term.f), F.lit("cannot convert float NaN to integer")).when(value.isNull(), F.lit(TOO_LARGE))
            cases.add(term.has(FLOAT) & without, whole(value, fails))
        if by is not None:
            # powers of ten up to the 22nd are exact; a float over 1e-6 has nothing left to round beyond
            finite = ~F.isnan(term.f) & (F.abs(term.f) != float("inf"))
            exact = F.when(digits > 22, term.f).when(digits < -22, term.f * 0).otherwise(_half_even(term.f, digits))
            deep = finite & (term.f != 0) & (((digits > 22) & (F.abs(term.f) < 1e-6)) | ((digits < -22) & (F.abs(term.f) >= 1e22)))
            cases.add(term.has(FLOAT), floating(F.when(finite, exact).otherwise(term.f), F.when(deep, F.lit(TOO_DEEP))))
    if term.kinds & {BOOL, INT}:
        if by is None:
            cases.add(term.has(BOOL, INT), whole(term.i))
        else:
            unit = F.when(digits < 0, F.rpad(F.lit("1"), F.least(F.abs(digits), F.lit(37)) + 1, "0").cast(_INT)).otherwise(F.lit(1).cast(_INT))

            def nearest(size: Sql, one: Sql) -> Sql:
                rest = (size % one).cast(_INT)
                low, left = F.try_subtract(size, rest).try_cast(_INT), F.try_subtract(one, rest).try_cast(_INT)
                up = (rest > left) | ((rest == left) & (low % F.try_multiply(one, F.lit(2).cast(_INT)).try_cast(_INT) != 0))
                return F.when(up, F.try_add(low, one).try_cast(_INT)).otherwise(low)

            size = bound(size_of(term.i), lambda n: bound(unit, lambda one: nearest(n, one)))
            size = F.when(digits < -38, F.lit(0).cast(_INT)).otherwise(size)
            value = bound(size, lambda n: F.when(term.i < 0, negative(n)).otherwise(n))
            cases.add(term.has(BOOL, INT), _digits_checked(F.when(without | (digits >= 0), term.i).otherwise(value)))
    return cases.term(error, term.kinds <= {BOOL, INT, FLOAT})


def length_of(term: Term) -> Term:
    if not term.plain:
        return whole(F.lit(len(term.items)).cast(_INT), term.e)
    cases = Cases(wrong_kind("len() of", term))
    if STR in term.kinds:
        cases.add(term.has(STR), whole(F.length(term.s).cast(_INT)))
    return cases.term(term.e, term.kinds == {STR})


def _only(term: Term, kinds: Iterable[int], action: str) -> Sql | None:
    """Failure where a value is none of the kinds."""
    return None if term.kinds <= set(kinds) else F.when(~term.has(*kinds), wrong_kind(action, term))


def _quoted(text: Sql) -> Sql:
    """A pattern that stands for the text itself."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def replaced(base: Term, args: list[Term]) -> Term:
    old, new, *times = args
    unfit = [t for t, kinds in zip(args, ({STR}, {STR}, {BOOL, INT})) if not t.kinds & kinds]
    if unfit:
        return Term(frozenset([NONE]), e=wrong_kind("replace() with", unfit[0]))
    value = F.replace(base.s, old.s, new.s)
    between = F.when(base.s == "", new.s).otherwise(F.concat(new.s, F.array_join(F.transform(F.split(base.s, ""), lambda c: F.concat(c, new.s)), "")))
    value = F.when(old.s == "", between).otherwise(value)
    error = first_error(*(_only(t, [STR], "replace() with") for t in (old, new)))
    if times:
        count = times[0]
        error = first_error(error, _only(count, [BOOL, INT], "replace() with"))
        most = F.greatest(F.least(count.i, F.lit(1 << 30)), F.lit(-1)).cast("int")
        parts = F.split(base.s, _quoted(old.s), most + 1)
        few = F.when(most == 0, base.s).otherwise(F.array_join(parts, new.s))
        letters = F.split(base.s, "")
        some = F.when(base.s == "", F.when(most == 0, F.lit("")).otherwise(new.s)).otherwise(
            F.concat(F.array_join(F.transform(letters, lambda c, i: F.when(i < most, F.concat(new.s, c)).otherwise(c)), ""),
                     F.when(F.size(letters) < most, new.s).otherwise(F.lit("")))
        )
        value = F.when(most < 0, value).when(old.s == "", some).otherwise(few)
    return textual(value, error)


def stripped(base: Term, args: list[Term]) -> Term:
    if not args:
        return textual(without_edges(base.s))
    chars = args[0]
    error = _only(chars, [NONE, STR], "strip() of")
    value = F.when(chars.has(NONE), without_edges(base.s))
    if STR in chars.kinds:
        value = value.when(chars.s == "", base.s).otherwise(F.btrim(base.s, chars.s))
    return textual(value, error)


_METHODS = {
    "lower": (0, 0, lambda base, args: textual(F.lower(base.s))),
    "upper": (0, 0, lambda base, args: textual(F.upper(base.s))),
    "strip": (0, 1, stripped),
    "replace": (2, 3, replaced),
}


def method_result(name: str, base: Term, args: list[Term]) -> Term:
    least, most, apply = _METHODS[name]
    if not base.plain:
        return failure(f"a list has no {name}()")
    if not least <= len(args) <= most or not all(a.plain for a in args):
        return failure(f"{name}() takes other values")
    missing = STR not in base.kinds
    before = first_error(base.e, *(a.e for a in args))
    if missing:
        return Term(frozenset([NONE]), e=first_error(before, wrong_kind(f"{name}() of", base)))
    return Cases(wrong_kind(f"{name}() of", base)).add(base.has(STR), apply(base, args)).term(before, base.kinds == {STR})


def letter(text: Sql, at: Sql) -> Sql:
    return F.substring(text, at + 1, F.lit(1))


def indexed(base: Term, at: Term) -> Term:
    before = first_error(base.e, at.e)
    if base.keys is not None:
        cases = Cases(F.concat(F.lit("no such key: "), to_str(at).s if at.plain else F.lit("a list")))
        for key, item in reversed(list(zip(base.keys, base.items))):  # of equal keys the last one stands
            cases.add(equal(key, at), item)
        return cases.term(before)
    if base.items is not None:
        cases, many = Cases(F.lit("list index out of range")), len(base.items)
        if not at.kinds & {BOOL, INT}:
            return Term(frozenset([NONE]), e=first_error(before, wrong_kind("index", at)))
        for n, item in enumerate(base.items):
            cases.add(at.has(BOOL, INT) & at.i.isin(n, n - many), item)
        return cases.term(first_error(before, _only(at, [BOOL, INT], "index")))
    cases = Cases(wrong_kind("index of", base, at))
    if STR in base.kinds and at.kinds & {BOOL, INT}:
        size = F.length(base.s)
        place = F.when(at.i < 0, at.i + size).otherwise(at.i)
        inside = (place >= 0) & (place < size)
        value = F.when(inside, letter(base.s, place.try_cast("int")))
        cases.add(base.has(STR) & at.has(BOOL, INT), textual(value, F.when(~inside, F.lit("string index out of range"))))
    return cases.term(before, base.kinds == {STR} and at.kinds <= {BOOL, INT})


def _bound(term: Term | None, size: Sql, absent: Sql, low: Sql, high: Sql) -> Sql:
    """Where a slice begins or ends: negative places count from the end, then the edges hold."""
    if term is None or term.kinds == {NONE}:
        return absent
    place = F.when(term.i < 0, F.try_add(term.i, size.cast(_INT))).otherwise(term.i)
    place = F.greatest(F.least(place, high.cast(_INT)), low.cast(_INT)).cast("int")
    return F.when(term.has(NONE), absent).otherwise(place) if NONE in term.kinds else place


def sliced(base: Term, low: Term | None, high: Term | None, step: Term | None) -> Term:
    given = [t for t in (low, high, step) if t is not None]
    before = first_error(base.e, *(t.e for t in given), *(_only(t, [NONE, BOOL, INT], "slice by") for t in given))
    if not base.plain:
        return Term(frozenset([NONE]), e=first_error(before, F.lit("lists cannot be cut")))
    if STR not in base.kinds:
        return Term(frozenset([NONE]), e=first_error(before, wrong_kind("slice of", base)))
    size = F.length(base.s)
    start = _bound(low, size, F.lit(0), F.lit(0), size)
    stop = _bound(high, size, size, F.lit(0), size)
    simple = F.substring(base.s, start + 1, F.greatest(stop - start, F.lit(0)))
    if step is None or step.kinds == {NONE}:
        result = textual(simple)
    else:
        by = F.greatest(F.least(step.i, F.lit(1 << 30)), F.lit(-(1 << 30))).cast("int")
        by = F.when(step.has(NONE), F.lit(1)).otherwise(by) if NONE in step.kinds else by
        last = size - 1
        back_start = _bound(low, size, last, F.lit(-1), last)
        back_stop = _bound(high, size, F.lit(-1), F.lit(-1), last)
        first, past = F.when(by > 0, start).otherwise(back_start), F.when(by > 0, stop).otherwise(back_stop)
        some = F.when(by > 0, first < past).otherwise(first > past)
        end = F.when(by > 0, past - 1).otherwise(past + 1)
        places = F.when(some & (by != 0), F.sequence(first, end, by))
        joined = F.array_join(F.transform(places, lambda at: letter(base.s, at)), "")
        value = F.when(by == 1, simple).otherwise(F.coalesce(joined, F.lit("")))
        result = textual(value, F.when(by == 0, F.lit("slice step cannot be zero")))
    return Cases(wrong_kind("slice of", base)).add(base.has(STR), result).term(before, base.kinds == {STR})


def contained(item: Term, whole_term: Term) -> Term:
    before = first_error(item.e, whole_term.e)
    if not whole_term.plain:
        same = F.lit(False)
        for element in whole_term.keys if whole_term.keys is not None else whole_term.items:
            same = same | equal(item, element)
        return truth_value(same, before)
    if not item.plain or not (STR in item.kinds and STR in whole_term.kinds):
        return Term(frozenset([NONE]), e=first_error(before, wrong_kind("in of", item, whole_term)))
    inside = truth_value(F.coalesce(whole_term.s.contains(item.s), F.lit(False)))
    both = item.has(STR) & whole_term.has(STR)
    return Cases(wrong_kind("in of", item, whole_term)).add(both, inside).term(before, item.kinds | whole_term.kinds == {STR})


def call_result(name: str, args: list[Term]) -> Term:
    """The allowed functions."""
    before = first_error(*(a.e for a in args))
    lists = [a for a in args if not a.plain]
    if name == "len":
        return length_of(args[0]) if len(args) == 1 else failure("len() takes one value")
    if name in ("min", "max"):
        several = list(args[0].items if args[0].keys is None else args[0].keys) if len(args) == 1 and lists else args
        if len(args) == 1 and not lists:
            text = args[0]
            letters = F.split(F.when(text.s != "", text.s), "") if STR in text.kinds else None
            if letters is None:
                return Term(frozenset([NONE]), e=first_error(before, wrong_kind(f"{name}() of", text)))
            value = F.array_min(letters) if name == "min" else F.array_max(letters)
            found = textual(value, F.when(text.s == "", F.lit(f"{name}() of an empty text")))
            return Cases(wrong_kind(f"{name}() of", text)).add(text.has(STR), found).term(before, text.kinds == {STR})
        if not several or any(not t.plain for t in several):
            return failure(f"{name}() takes plain values")
        best = extreme(several, name == "min")
        return Term(best.kinds, best.k, best.i, best.f, best.s, first_error(before, best.e))
    if lists or len(args) > (2 if name == "round" else 1) or (name in ("abs", "round") and not args):
        return failure(f"{name}() takes other values")
    if not args:
        return {"str": textual(F.lit("")), "int": whole(F.lit(0).cast(_INT)), "float": floating(F.lit(0.0))}[name]
    if name == "round":
        return rounded(args[0], args[1] if len(args) > 1 else None)
    return {"str": to_str, "int": to_int, "float": to_float, "abs": absolute}[name](args[0])


# ---- shapes


@dataclass
class Shape:
    """A repair without its constants. ``key`` is equal for repairs that differ in constants and names only."""

    key: str
    usable: bool  # takes one value
    texts: list[str]
    wholes: list[str]
    floats: list[float]
    places: dict[int, int]  # number of every constant among those of its type, by the identity of its node


class _Constants(ast.NodeVisitor):
    """Numbers the constants of a repair by type, in one fixed order."""

    def __init__(self) -> None:
        self.found: dict[type, list] = {str: [], int: [], float: []}
        self.places: dict[int, int] = {}

    def visit_Constant(self, node: ast.Constant) -> None:
        held = self.found.get(type(node.value))
        if held is not None:
            self.places[id(node)] = len(held)
            held.append(node.value)


class _Bare(ast.NodeTransformer):
    """A repair with places for its constants and fixed names for its arguments."""

    def __init__(self, names: dict[str, str]) -> None:
        self.names = names

    def visit_Name(self, node: ast.Name) -> ast.AST:
        return ast.Name(self.names.get(node.id, node.id), ast.Load())

    def visit_Constant(self, node: ast.Constant) -> ast.AST:
        wide = type(node.value) is int and len(str(abs(node.value))) > _DIGITS
        return ast.Name(f"{type(node.value).__name__}{'+' * wide}#", ast.Load()) if type(node.value) in (str, int, float) else node


def shape_of(tree: ast.Lambda) -> Shape:
    spec = tree.args
    arguments = [*spec.posonlyargs, *spec.args, *spec.kwonlyargs]
    simple = not (spec.vararg or spec.kwarg or spec.kwonlyargs or spec.posonlyargs)
    usable = simple and 1 <= len(spec.args) <= len(spec.defaults) + 1
    constants = _Constants()
    for part in (tree.body, *spec.defaults):
        constants.visit(part)
    bare = _Bare({a.arg: f"value#{n}" for n, a in enumerate(arguments)})
    parts = [ast.dump(bare.visit(copy.deepcopy(part))) for part in (tree.body, *spec.defaults)]
    found = constants.found
    return Shape(
        json.dumps([usable, len(arguments), *parts]), usable, found[str], [str(n) for n in found[int]], found[float], constants.places
    )


class Compiler:
    """Gives the registers of one shape, step by step.

    ``build`` walks the tree of an example; every step asks ``register`` for a place that
    holds its value, at a height above those of its operands. Constants come from the
    parameters of the row.
    """

    def __init__(self, tree: ast.Lambda, source: Term, parameters: Sql, register: Callable[[int, Term], Term]) -> None:
        self.tree, self.source, self.parameters, self.register = tree, source, parameters, register
        self.shape = shape_of(tree)
        self.names: dict[str, Term] = {}

    def result(self) -> Term:
        """The repaired value as text."""
        spec = self.tree.args
        nothing = F.lit(None).cast("string")
        if not self.shape.usable:
            return textual(nothing, F.lit(ONE_VALUE))
        arguments = [a.arg for a in spec.args]
        # defaults belong to the last arguments; the first one is always the value
        given = {name: self.build(node)[0] for name, node in zip(arguments[::-1], spec.defaults[::-1])}
        self.names = given | {arguments[0]: self.source}
        body, _ = self.build(self.tree.body)
        if not body.plain:
            return textual(nothing, first_error(body.e, F.lit("a repair must return a plain value")))
        return as_result(body)

    def build(self, node: ast.AST) -> tuple[Term, int]:
        """(value, height); a step of any height but 0 sits in a register."""
        method = getattr(self, f"on_{type(node).__name__.lower()}", None)
        if method is None:
            return failure(f"unsupported syntax: {type(node).__name__}"), 0
        term, height = method(node)
        if height and term.plain:
            term = self.register(height, term)
        return term, height

    def several(self, nodes: Iterable[ast.AST]) -> tuple[list[Term], int]:
        built = [self.build(n) for n in nodes]
        return [t for t, _ in built], max((h for _, h in built), default=0)

    def on_constant(self, node: ast.Constant) -> tuple[Term, int]:
        kind = type(node.value)
        if node.value is None:
            return none(), 0
        if kind is bool:
            return truth_value(F.lit(node.value)), 0
        if kind not in (str, int, float):
            return failure(f"unsupported constant: {kind.__name__}"), 0
        held = self.parameters[{str: "texts", int: "wholes", float: "floats"}[kind]][self.shape.places[id(node)]]
        if kind is str:
            return textual(held), 0
        if kind is float:
            return floating(held), 0
        return whole(held, F.lit(TOO_LARGE) if len(str(abs(node.value))) > _DIGITS else None), 0

    def on_name(self, node: ast.Name) -> tuple[Term, int]:
        if node.id in self.names:
            return self.names[node.id], 0
        known = node.id in ("str", "int", "float", "len", "min", "max", "abs", "round")
        return failure(NO_VALUE if known else f"name '{node.id}' is not defined"), 0

    def on_ifexp(self, node: ast.IfExp) -> tuple[Term, int]:
        (test, t), (yes, y), (no, n) = self.build(node.test), self.build(node.body), self.build(node.orelse)
        height = 1 + max(t, y, n)
        if not yes.plain or not no.plain:
            return failure("a list cannot be chosen"), height
        cases = Cases(F.lit(NO_VALUE)).add(truth(test), yes).add(F.lit(True), no)
        return cases.term(test.e, complete=True), height

    def on_boolop(self, node: ast.BoolOp) -> tuple[Term, int]:
        terms, height = self.several(node.values)
        if any(not t.plain for t in terms):
            return failure("a list cannot be chosen"), height + 1
        result = terms[0]
        for n, right in enumerate(terms[1:], 1):
            holds = truth(result)
            other = holds if isinstance(node.op, ast.And) else ~holds
            result = Cases(F.lit(NO_VALUE)).add(other, right).add(F.lit(True), result).term(result.e, complete=True)
            if n < len(terms) - 1:
                height += 1
                result = self.register(height, result)
        return result, height + 1

    def on_unaryop(self, node: ast.UnaryOp) -> tuple[Term, int]:
        inner, height = self.build(node.operand)
        if isinstance(node.op, ast.Not):
            return truth_value(~truth(inner), inner.e), height + 1
        if not inner.plain:
            return failure("a list has no sign"), height + 1
        return sign_changed(inner, isinstance(node.op, ast.USub)), height + 1

    def on_binop(self, node: ast.BinOp) -> tuple[Term, int]:
        (left, right), height = self.several([node.left, node.right])
        if left.plain != right.plain or (not left.plain and not isinstance(node.op, ast.Add)):
            return failure("lists only add to lists"), height + 1
        return OPERATIONS[type(node.op)](left, right), height + 1

    def on_compare(self, node: ast.Compare) -> tuple[Term, int]:
        terms, height = self.several([node.left, *node.comparators])
        parts = [self._compared(op, a, b) for op, a, b in zip(node.ops, terms, terms[1:])]
        errors = first_error(*(t.e for t in terms))
        holds, error = F.lit(True), None
        for part in reversed(parts):  # a later comparison counts only if the earlier ones hold
            yes = part.i != 0
            error = first_error(part.e, None if error is None else F.when(yes, error))
            holds = F.when(yes, holds).otherwise(F.lit(False))
        return truth_value(F.coalesce(holds, F.lit(False)), first_error(errors, error)), height + 1

    def _compared(self, op: ast.cmpop, left: Term, right: Term) -> Term:
        bare = lambda t: Term(t.kinds, t.k, t.i, t.f, t.s, None, t.items, t.keys)
        left, right = bare(left), bare(right)
        if isinstance(op, (ast.In, ast.NotIn)):
            hit = contained(left, right)
            if hit.i is None:
                return truth_value(F.lit(False), hit.e)
        else:
            same = equal(left, right)
            if isinstance(op, (ast.Is, ast.IsNot)) and left.plain and right.plain:
                same = same & (left.kind() == right.kind())
            hit = truth_value(same)
        negated = isinstance(op, (ast.NotEq, ast.IsNot, ast.NotIn))
        return truth_value(hit.i == 0, hit.e) if negated else hit

    def on_call(self, node: ast.Call) -> tuple[Term, int]:
        if isinstance(node.func, ast.Attribute):
            (base, *args), height = self.several([node.func.value, *node.args])
            return method_result(node.func.attr, base, args), height + 1
        args, height = self.several(node.args)
        if node.func.id in self.names:
            return failure("the value cannot be called"), height + 1
        return call_result(node.func.id, args), height + 1

    def on_subscript(self, node: ast.Subscript) -> tuple[Term, int]:
        base, height = self.build(node.value)
        if isinstance(node.slice, ast.Slice):
            bounds = [node.slice.lower, node.slice.upper, node.slice.step]
            built = [(None, 0) if b is None else self.build(b) for b in bounds]
            return sliced(base, *(t for t, _ in built)), 1 + max(height, *(h for _, h in built))
        at, below = self.build(node.slice)
        return indexed(base, at), 1 + max(height, below)

    def on_list(self, node: ast.List | ast.Tuple) -> tuple[Term, int]:
        terms, height = self.several(node.elts)
        return Term(frozenset([NONE]), e=first_error(*(t.e for t in terms)), items=tuple(terms)), height

    on_tuple = on_list

    def on_dict(self, node: ast.Dict) -> tuple[Term, int]:
        if any(k is None for k in node.keys):
            return failure("unsupported syntax: **"), 0
        keys, high = self.several(node.keys)
        items, height = self.several(node.values)
        errors = first_error(*(t.e for t in (*keys, *items)))
        if any(not k.plain for k in keys):
            return failure("a key cannot be a list"), 0
        return Term(frozenset([NONE]), e=errors, items=tuple(items), keys=tuple(keys)), max(high, height)


def as_result(term: Term) -> Term:
    """A value as text: NULL stays NULL, NaN and infinities become it."""
    value = to_str(Term(term.kinds, term.k, term.i, term.f, term.s))
    gone = term.has(NONE)
    if FLOAT in term.kinds:
        gone = gone | (term.has(FLOAT) & (F.isnan(term.f) | (F.abs(term.f) == float("inf"))))
    return textual(F.when(~F.coalesce(gone, F.lit(False)), value.s), term.e)


_PARTS = {"k": "tinyint", "i": _INT, "f": "double", "s": "string", "e": "string"}


def register_parts(term: Term) -> dict[str, Sql]:
    """A value as the columns of a register, those that it needs.

    They are columns of their own: the optimizer would put a struct back into whatever
    reads it, once per reader, and so grow without bound over a chain of steps.
    """
    held = {n: getattr(term, n) for n in _PARTS} | {"k": term.k if len(term.kinds) > 1 else None}
    return {n: value.cast(_PARTS[n]) for n, value in held.items() if value is not None}


def from_register(name: str, term: Term) -> Term:
    """What the register of that name gives back."""
    parts = register_parts(term)
    return Term(term.kinds, **{n: F.col(f"{name}_{n}") if n in parts else None for n in _PARTS})
