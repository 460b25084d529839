"""One-argument repair expressions over a value column.

A repair is text such as ``lambda x: None if x is None else str(x).strip()``.
Text is parsed and checked, never executed; ``repairs`` compiles what passes to Spark
Columns.
"""

from __future__ import annotations

import ast
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mendframe import settings as S
from mendframe.functions import repairs, sqltext, tables
from mendframe.functions.sqltext import Sql

# What a repair may contain.
ALLOWED_NODES = (
    "Expression", "Lambda", "arguments", "arg", "Load", "Name", "Constant", "IfExp", "Compare",
    "Eq", "NotEq", "Is", "IsNot", "In", "NotIn", "And", "Or", "BoolOp", "UnaryOp", "Not", "USub",
    "UAdd", "BinOp", "Add", "Sub", "Mult", "Div", "Mod", "Pow", "Call", "Attribute", "Subscript",
    "Slice", "List", "Tuple", "Dict",
)
ALLOWED_CALLS = ("str", "int", "float", "len", "min", "max", "abs", "round")
ALLOWED_METHODS = ("replace", "strip", "lower", "upper")


class Rejected(ValueError):
    """The repair may not run at all."""


class _Checker(ast.NodeVisitor):
    """Goes through the inside of a repair; a kind of node without a rule here only has to be allowed."""

    def visit(self, node: ast.AST) -> None:
        if type(node).__name__ not in ALLOWED_NODES:
            raise Rejected(f"a repair cannot contain {type(node).__name__}")
        super().visit(node)

    def visit_Lambda(self, node: ast.Lambda) -> None:
        raise Rejected("a repair cannot contain another lambda")

    def visit_Attribute(self, node: ast.Attribute) -> None:
        raise Rejected(f"a repair cannot read the attribute {node.attr}")

    def visit_Call(self, node: ast.Call) -> None:
        match node.func:
            case ast.Name(id=name) if name in ALLOWED_CALLS:
                inside = [*node.args, *node.keywords]
            case ast.Attribute(value=base, attr=method) if method in ALLOWED_METHODS:
                inside = [base, *node.args, *node.keywords]
            case other:
                raise Rejected(f"a repair cannot call {ast.unparse(other)}")
        for part in inside:
            self.visit(part)


@lru_cache(maxsize=4096)
def parse(code: str) -> ast.Lambda:
    """Check a repair against the whitelist and return its syntax tree."""
    try:
        repair = ast.parse(code.strip(), mode="eval").body
        if isinstance(repair, ast.Lambda):
            checker = _Checker()
            checker.visit(repair.args)
            checker.visit(repair.body)
            return repair
    except (SyntaxError, RecursionError, MemoryError) as problem:
        raise Rejected(f"invalid syntax: {problem}") from None
    except ValueError as problem:
        raise problem if isinstance(problem, Rejected) else Rejected(f"invalid syntax: {problem}") from None
    raise Rejected("a repair has to be a lambda")


def _check_batch(codes: pd.Series) -> pd.Series:
    def problem(code: str | None) -> str | None:
        try:
            parse("" if code is None else code)
        except Rejected as found:
            return str(found)
        return None

    return codes.map(problem).astype(object)


def code_error(code: Column) -> Column:
    """Why a repair may not run, NULL when it may."""
    return F.pandas_udf(_check_batch, "string")(code)


def _shape_batch(codes: pd.Series) -> pd.DataFrame:
    rows = []
    for code in codes:
        try:
            shape = repairs.shape_of(parse("" if code is None else code))
            rows.append((shape.key, shape.texts, shape.wholes, shape.floats, None))
        except Rejected as found:
            rows.append((None, [], [], [], str(found)))
    return pd.DataFrame(rows, columns=["key", "texts", "wholes", "floats", "problem"])


_SHAPE = "key string, texts array<string>, wholes array<string>, floats array<double>, problem string"


def _chosen(cases: list[tuple[int, Sql]]) -> Sql:
    """The expression of the row's shape, found by halving."""
    if len(cases) == 1:
        return sqltext.when(sqltext.col("_shape") == cases[0][0], cases[0][1])
    half = len(cases) // 2
    return sqltext.when(sqltext.col("_shape") < cases[half][0], _chosen(cases[:half])).otherwise(_chosen(cases[half:]))


def _repaired(rows: DataFrame, examples: dict[int, str], source: Column) -> tuple[DataFrame, bool]:
    """Rows with ``transformed_value`` and ``error``, by the shapes of some example codes."""
    value = repairs.Term(
        frozenset([repairs.NONE, repairs.STR]),
        k=sqltext.when(sqltext.col("_source").isNull(), repairs.NONE).otherwise(repairs.STR).cast("tinyint"), s=sqltext.col("_source"),
    )
    steps: dict[int, dict[str, list[tuple[int, Sql]]]] = {}
    values, errors = [], []
    for number, code in sorted(examples.items()):
        used: dict[int, int] = {}

        def register(height: int, term: repairs.Term) -> repairs.Term:
            used[height] = used.get(height, 0) + 1
            name = f"_step_{height}_{used[height]}"
            for part, held in repairs.register_parts(term).items():
                steps.setdefault(height, {}).setdefault(f"{name}_{part}", []).append((number, held))
            return repairs.from_register(name, term)

        result = repairs.Compiler(parse(code), value, sqltext.col("_parameters"), register).result()
        values.append((number, result.s))
        if result.e is not None:
            errors.append((number, result.e))
    kept = [f"`{c}`" for c in rows.columns if not c.startswith("_repair_")]
    stage = rows.withColumn("_source", source)
    for height in sorted(steps):
        stage = stage.withColumns({name: F.expr(_chosen(cases).text) for name, cases in steps[height].items()})
    error = F.coalesce("_problem", F.expr(_chosen(errors).text)) if errors else F.col("_problem")
    stage = stage.withColumn("error", error.cast("string"))
    return stage.select(
        *kept, F.when(F.col("error").isNull(), F.expr(_chosen(values).text)).cast("string").alias("transformed_value"), "error"
    ), bool(errors)


def apply_codes(rows: DataFrame, codes: DataFrame, code: str = "code", value: str = "value") -> tuple[DataFrame, bool]:
    """Add ``transformed_value`` and ``error``; also tell whether any row can fail.

    ``codes`` holds every code of the rows. Codes are parsed once each, where they are;
    one code of each shape reaches the driver, which compiles it to Columns. Rows get the
    constants of their code by a join, so any number of codes costs as many expressions as
    there are shapes, and no row is evaluated in Python. More than ``SHAPES_A_PASS`` shapes
    take several passes over the written rows.
    """
    distinct = codes.select(F.col(code).alias("_code")).distinct()
    shaped = tables.cut(distinct.withColumn("_s", F.pandas_udf(_shape_batch, _SHAPE)("_code")).select("_code", "_s.*"), "shapes")
    examples = [r[0] for r in shaped.where("problem IS NULL").groupBy("key").agg(F.min("_code").alias("c")).orderBy("key").select("c").collect()]
    spark = rows.sparkSession
    numbered = spark.createDataFrame([(repairs.shape_of(parse(c)).key, n) for n, c in enumerate(examples)], "key string, _shape int")
    parameters = shaped.join(F.broadcast(numbered), "key", "left").select(
        F.col("_code").alias(code), "_shape", F.coalesce("problem", F.when(F.col("_code").isNull(), F.lit("no repair"))).alias("_problem"),
        F.struct("texts", F.transform("wholes", lambda n: n.try_cast("decimal(38,0)")).alias("wholes"), "floats").alias("_parameters"),
    )
    joined = tables.lookup(rows, tables.cut(parameters, "parameters"), [code])
    joined = joined.withColumn("_problem", F.when(F.col(code).isNull(), F.lit("no repair")).otherwise(F.col("_problem")))
    refused = not shaped.where("problem IS NOT NULL").isEmpty()
    source = F.when(~F.col(value).isin(*S.MISSING_INPUT), F.col(value))
    passes = [dict(list(enumerate(examples))[at : at + S.SHAPES_A_PASS]) for at in range(0, len(examples), S.SHAPES_A_PASS)] or [{}]
    if len(passes) > 1:
        joined = tables.cut(joined, "joined")
    results, can_fail = [], refused
    for n, some in enumerate(passes):
        part = joined if len(passes) == 1 else joined.where(
            F.col("_shape").between(min(some), max(some)) | (F.col("_shape").isNull() & F.lit(n == 0))
        )
        if some:
            done, fails = _repaired(part, some, source)
        else:
            done, fails = part.withColumn("transformed_value", F.lit(None).cast("string")).withColumnRenamed("_problem", "error"), True
        results.append(done.select(*(f"`{c}`" for c in rows.columns), "transformed_value", "error"))
        can_fail = can_fail or fails
    applied = results[0]
    for more in results[1:]:
        applied = applied.unionByName(more)
    return applied, can_fail
