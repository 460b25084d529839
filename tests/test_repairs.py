"""Repairs as Columns against Python's own evaluation of the same text."""

import random

import pytest
from pyspark.sql import functions as F

from mendframe import settings as S
from mendframe.functions import expressions as E, repairs

VALUES = [
    None, "", "null", "abc", " A,b ", "1,200.50", "12", "-7", "n/a", "a@b", "ééß", "0", "-0", "0.5", "2.675", "1e22", "1e16",
    "123456789.123456789", "1E-5", "0.0001", " 42\t", "1_000", "1__0", "nan", "-inf", "1f", "0x1F", "99999999999999999999999999999999999999",
    "aXbXcX", "'", "12.50", "-3.5", "2.5", "1e300", "True", "a.b|c", "x" * 300,
]
# one for every permitted node, call and method, and for mixes of kinds
CODES = [
    "lambda x: x", S.KEEP_NULL_CODE, S.STRIP_COMMAS_CODE, "lambda x: x.lower() if x else 'none'", "lambda x: x or 'empty'",
    "lambda x: x and x.upper()", "lambda x: not x", "lambda x: x is None", "lambda x: x is not None", "lambda x: len(x)",
    "lambda x: x[1:3] + '-' + x[-2:]", "lambda x: 'y' if 'b' in x else 'n'", "lambda x: x in ('abc', None)", "lambda x: x not in ['12', '0']",
    "lambda x: str(x) + '!'", "lambda x: x == 'abc' or x == '12'", "lambda x: x != 'abc' and x != None", "lambda x: float(x) * 2",
    "lambda x: int(x) % 5", "lambda x: int(x) % -5", "lambda x: -int(x)", "lambda x: +float(x)", "lambda x: float('nan')", "lambda x: float('inf')",
    "lambda x: -float('inf')", "lambda x: float('nan') == float('nan')", "lambda x: 1 / 0", "lambda x: 1 / int(x)", "lambda x: int(x) / 7",
    "lambda x: max(len(x), 3)", "lambda x: min(float(x), 3)", "lambda x: max(x, 'b')", "lambda x: min(x)", "lambda x: max([len(x), 2, 5.5])",
    "lambda x: {'12': 'dozen', '0': None}[x]", "lambda x: ['a', 'b', 'c'][len(x)]", "lambda x: ('a', 'b')[-1]", "lambda x: (x, 'b')[0]",
    "lambda x: len([x, x]) + len({'a': 1})", "lambda x: round(abs(float(x.replace(',', ''))), 1)", "lambda x: round(float(x), 2)",
    "lambda x: round(float(x))", "lambda x: round(float(x), -1)", "lambda x: round(int(x), -1)", "lambda x: round(int(x))", "lambda x: round(float(x), None)",
    "lambda x: round(x)", "lambda x: abs(int(x)) + True", "lambda x: int(float(x))", "lambda x: int(x) ** 2", "lambda x: 2 ** int(x)",
    "lambda x: float(x) ** 0.5", "lambda x: int(x) ** -1", "lambda x: int(x) - 0.5", "lambda x: float(x) % 3", "lambda x: float(x) % -2.5",
    "lambda x, sep=',': x.replace(sep, ';')", "lambda x: x.strip('a')", "lambda x: x.strip('')", "lambda x: x.strip(None)", "lambda x: x * 2",
    "lambda x: 3 * x", "lambda x: x * -1", "lambda x: y", "lambda x: str", "lambda x: x[0]", "lambda x: x[-1]", "lambda x: x[::-1]", "lambda x: x[::2]",
    "lambda x: x[5:1:-2]", "lambda x: x[1:]", "lambda x: x[:-1]", "lambda x: x[:]", "lambda x: x[len(x) - 1]", "lambda x: x[1:len(x):3]", "lambda x: x[::0]",
    "lambda x: x.replace('X', '-', 1)", "lambda x: x.replace('X', '', 2)", "lambda x: x.replace('', '-')", "lambda x: x.replace('', '-', 2)",
    "lambda x: x.replace('.', '$1')", "lambda x: x.replace('a.b', '', 1)", "lambda x: x.replace('X', '', 0)", "lambda x: x.replace('b', x)", "lambda x: x.replace(1, 2)",
    "lambda x: 1 if x else 'none'", "lambda x: 1.5 if x == 'abc' else x", "lambda x: (1 if x else 'n') + 1", "lambda x: (1 if x else None) == 1",
    "lambda x: str(1.0) + str(True) + str(None) + str(7)", "lambda x: str(float(x))", "lambda x: 1e16 + 1", "lambda x: 1e-7", "lambda x: 123456789012345680.0",
    "lambda x: 0.1 + 0.2", "lambda x: -0.0", "lambda x: 100.0", "lambda x: 1.7976931348623157e308 * 10", "lambda x: 2.0 ** 0.5",
    "lambda x: x.upper().lower().strip()", "lambda x: not (x and len(x) == 3)", "lambda x: 1 == 1.0", "lambda x: True == 1", "lambda x: 'a' == 1",
    "lambda x: None", "lambda x: x == x == 'abc'", "lambda x: 'a' in x in ('abc', 'a@b')", "lambda x: 1 in [1.0, 'a']", "lambda x: x in {'12': 1}",
    "lambda x: [1, 2] == [1, 2.0]", "lambda x: ([1] + [2])[1]", "lambda x: int()", "lambda x: str()", "lambda x: float()", "lambda x: len()", "lambda x: len(3)",
    "lambda x: max(1, 2.0, 2)", "lambda x: min(2, 2.0)", "lambda x: int('12') + int(' 7 ')", "lambda x: float('1e3')", "lambda x: float('1_0.5')",
    "lambda x: 99999999999999999999 * 99999999999", "lambda x: 12345678901234567890 % 7", "lambda x: x.strip", "lambda: 1", "lambda x, y: x", "lambda *x: 1",
    "lambda x=1: x", "lambda str: str.upper()", "lambda v: v.lower()", "lambda x: x + 1", "lambda x: x - x", "lambda x: None + 1", "lambda x: -x",
    "lambda x: (x or '0')[0] + (x or 'zz')[1:2]", "lambda x: x if x is None else (x[0] if len(x) == 1 else (x[-1] if len(x) == 2 else x[1]))",
    "lambda x: True and x", "lambda x: x and True or False", "lambda x: 0 or 0.0 or '' or None or 'last'", "lambda x: not 0.0", "lambda x: 3 % 0", "lambda x: 3.0 % 0",
    "lambda x: 0 ** 0", "lambda x: 0.0 ** -1", "lambda x: (-8) ** 0.5", "lambda x: 10.0 ** 400", "lambda x: (-1) ** 1001", "lambda x: 7 % 3 - 7 % -3",
]

def python(code, value):
    value = None if value in S.MISSING_INPUT else value
    try:
        E.parse(code)
        if "*x:" in code:
            return None, True  # takes any number of values
        if "** int(x)" in code and len(value) > 9:
            return None, True  # more digits than Python could write
        result = eval(code, {})(value)
        if callable(result) or isinstance(result, (complex, list, tuple, dict)):
            return None, True
        if isinstance(result, int) and len(str(abs(result))) > 38:
            return None, True
    except (Exception, E.Rejected):
        return None, True
    if result is None or (isinstance(result, float) and (result != result or abs(result) == float("inf"))):
        return None, False
    return str(result), False


def applied(spark, pairs):
    rows = spark.createDataFrame(pairs, "n int, code string, value string")
    counted = rows.groupBy("code").agg(F.count("*").alias("size"))
    return E.apply_codes(rows, counted)


def compare(spark, pairs):
    frame, _ = applied(spark, [(n, *p) for n, p in enumerate(pairs)])
    got = {r.n: (r.transformed_value, r.error is not None) for r in frame.collect()}
    assert len(got) == len(pairs)
    wrong = [(p, got[n], python(*p)) for n, p in enumerate(pairs) if got[n] != python(*p)]
    assert not wrong, chr(10).join(map(str, wrong[:40]))


def test_every_node_and_kind(spark):
    compare(spark, [(c, v) for c in CODES for v in VALUES])


def test_no_python_on_rows_and_any_number_of_codes(spark):
    """A thousand codes of few shapes, a dozen of many passes; rows never reach a Python worker."""
    rng = random.Random(5)
    codes = [f"lambda x: x.replace('{chr(97 + n % 26)}', '{n}') if len(x) > {n % 7} else str({n}.5)" for n in range(1_000)]
    pairs = [(c, rng.choice(VALUES)) for c in codes]
    compare(spark, pairs)
    frame, _ = applied(spark, [(0, c, "abc") for c in codes])
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("_step_1_1_i") < 60  # one set of expressions, not a thousand


def test_more_shapes_than_a_pass(spark, monkeypatch):
    monkeypatch.setattr(S, "SHAPES_A_PASS", 7)
    compare(spark, [(c, v) for c in CODES[::3] + ["not python("] for v in ("abc", "12", None)])


def test_floats_print_and_round_as_in_python(spark):
    rng = random.Random(6)
    numbers = [rng.uniform(-1, 1) * 10.0 ** rng.randrange(-30, 40) for _ in range(300)]
    numbers += [round(rng.uniform(-1000, 1000), 3) for _ in range(200)] + [n + 0.5 for n in range(-20, 20)]
    numbers += [2.0 ** n for n in range(-60, 70)] + [n / 1000 + 0.0005 for n in range(100)] + [1e22, 1e23, 9007199254740993.0, 2.0**53]
    pairs = [("lambda x: float(x)", repr(n)) for n in numbers] + [("lambda x: int(float(x))", repr(n)) for n in numbers]
    for places in (0, 1, 2, 3, 5, 9, 15, 22, -1, -3):
        pairs += [(f"lambda x: round(float(x), {places})", repr(n)) for n in numbers if not (places == 22 and abs(n) < 1e-6)]
    compare(spark, pairs)


def test_whole_numbers(spark):
    rng = random.Random(7)
    numbers = [rng.randrange(-(10**k), 10**k) for k in range(1, 38) for _ in range(6)] + [0, 5, 15, 25, -5, -15, 10**37]
    codes = ["lambda x: int(x) + 7", "lambda x: int(x) - 10**30", "lambda x: int(x) * 3", "lambda x: int(x) % 97", "lambda x: int(x) % -1000",
             "lambda x: round(int(x), -2)", "lambda x: round(int(x), -1)", "lambda x: round(int(x), -50)", "lambda x: abs(int(x))", "lambda x: int(x) ** 3", "lambda x: int(x) == float(x)"]
    compare(spark, [(c, str(n)) for c in codes for n in numbers if not ("float" in c and abs(n) > 2**53)])


def test_failures_name_their_reason(spark):
    frame, can_fail = applied(spark, [(0, "lambda x: float(x)", "abc"), (1, "lambda x: x.upper()", None), (2, "lambda x: __import__('os')", "a"), (3, None, "a"), (4, "lambda x: 'ab' * 99999999999", "a")])
    errors = {r.n: r.error for r in frame.collect()}
    assert can_fail
    assert errors[0] == "could not convert string to float: 'abc'"
    assert errors[1] == repairs.MISSING_OPERAND and "cannot call" in errors[2] and errors[3] and errors[4] == repairs.TOO_LONG
    frame, can_fail = applied(spark, [(0, S.KEEP_NULL_CODE, "abc"), (1, "lambda x: x", None)])
    assert not can_fail and all(r.error is None for r in frame.collect())


def test_empty_tables_and_clashing_names(spark):
    rows = spark.createDataFrame([], "n int, code string, value string")
    frame, _ = E.apply_codes(rows, rows.groupBy("code").agg(F.count("*").alias("size")))
    assert frame.collect() == [] and frame.columns == ["n", "code", "value", "transformed_value", "error"]
    named = spark.createDataFrame([(1, 2, "lambda x: x.upper()", "a")], "`a.b` int, size int, code string, value string")
    frame, _ = E.apply_codes(named, named.select("code", "size"))
    assert [tuple(r) for r in frame.collect()] == [(1, 2, "lambda x: x.upper()", "a", "A", None)]


@pytest.mark.parametrize("code", ["lambda x: x if x else 'a'", "lambda y: y if y else 'other'"])
def test_shapes_ignore_names_and_constants(code):
    assert repairs.shape_of(E.parse(code)).key == repairs.shape_of(E.parse("lambda x: x if x else 'b'")).key
    assert repairs.shape_of(E.parse(code)).key != repairs.shape_of(E.parse("lambda x: x if x else 1")).key
