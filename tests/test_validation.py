import random
import re

from pyspark.sql import functions as F

from inputs import SF
from mendframe.functions import tables, text as tx
from mendframe.operators import validation as V
from mendframe.plans import samples
from mendframe.settings import ValidationSpec


def run(spark, rows, columns, spec=ValidationSpec()):
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns)).coalesce(1)
    validated = V.validate(table, spec)
    found = V.anomalies(validated).orderBy("row_ord", "pos").collect()
    return V.clean_rows(validated).collect(), found


def test_one_fault_per_kind_among_good_rows(spark):
    """Parcels: a broken weight, a blank depot, two good rows, a shipping day in words, a contact without domain."""
    spec = ValidationSpec.build({"columns": {
        "weight": {"type": "numeric", "required": True}, "shipped": {"type": "date", "required": True},
        "depot": {"required": True}, "contact": {"type": "email"},
    }})
    rows = [
        ("p-70", "0.75 kg", "2031-10-30", "North", "desk@depot.org"),
        ("p-71", "12", "30/10/2031", "  ", "desk@depot.org"),
        ("p-72", "-3.5", "2031-11-01", "South", None),
        ("p-73", "8", "first of May", "East", ""),
        ("p-74", "1,024", "01-11-2031", "West", "desk.depot.org"),
        ("p-75", "64", "2031-11-02", "West", "night+desk@depot.org"),
    ]
    clean, found = run(spark, rows, ["id", "weight", "shipped", "depot", "contact"], spec)
    assert [r.id for r in clean] == ["p-72", "p-75"]
    kinds = {(a.id, a.column_name): a.error_type for a in found}
    assert kinds == {
        ("p-70", "weight"): "numeric_format_error", ("p-71", "depot"): "null_block_error",
        ("p-73", "shipped"): "date_format_error", ("p-74", "contact"): "email_format_error",
    }
    assert all(a.source_row["id"] == a.id for a in found)


def test_errors_follow_column_order_and_optional_missing_is_skipped(spark):
    spec = ValidationSpec.build({"columns": {"z_mail": {"type": "email"}, "a_day": {"type": "date"}, "m_sum": {"type": "numeric"}}})
    clean, found = run(spark, [("nobody at home", "yesterday", "")], ["z_mail", "a_day", "m_sum"], spec)
    assert not clean
    assert [a.column_name for a in found] == ["a_day", "z_mail"]
    assert found[0].id == "1"


def test_duplicate_flags_every_member_and_reports_last(spark):
    schema = {"columns": {"customer_email": {"type": "email", "required": True, "unique": True}}}
    rows = [("1", "A@x.com"), ("2", " a@X.com"), ("3", "n/a"), ("4", "z@x.com")]
    clean, found = run(spark, rows, ["id", "customer_email"], ValidationSpec.build(schema))
    assert [r.id for r in clean] == ["4"]
    assert [(a.id, a.error_type) for a in found] == [
        ("1", "duplicate_value_error"), ("2", "duplicate_value_error"), ("3", "null_block_error"),
    ]


def test_required_column_that_is_absent(spark):
    _, found = run(spark, [("1",)], ["id"], ValidationSpec.build(required_columns=["amount"]))
    assert [(a.column_name, a.value, a.error_type) for a in found] == [("amount", None, "null_block_error")]


def test_spec_precedence():
    schema = {"columns": {"a": {"type": " Email ", "required": True, "unique": True}, "b": {"unique": True}},
              "unique_columns": []}
    spec = ValidationSpec.build(schema, required_columns=[])
    assert (spec.required, spec.unique, spec.types) == ((), (), {"a": "email"})
    assert spec.rule_names() == ["date", "email", "numeric", "required"]
    assert ValidationSpec.build({"unique_columns": ["a"]}).rule_names()[1] == "duplicate"
    names = {"update_by": "date", "phone_number": "numeric", "email_date": "email", "name": None}
    assert {n: spec.logical_type(n) for n in names} == names


def test_text_rules_against_plain_python(spark):
    random.seed(5)
    alphabet = ["1", "2", "٣", ",", "-", " ", ".", "\t", "\xa0", "\x1c", "a", "@", "n", "N", "u", "L", "/", "x", "　"]
    values = {"".join(random.choice(alphabet) for _ in range(random.randint(0, 7))) for _ in range(4000)}
    base = ["null", "None", "N/A", "2024-01-02", "01/02/2024", "a@b.co", "1,200.50", "1.", "+1", ""]
    values |= {left + b + right for b in base for left in ("", " ", "\x1f", ",") for right in ("", "　", "\x85", ",")}
    number, email = re.compile(r"^-?\d+(?:\.\d+)?$"), re.compile(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")
    dates = [re.compile(p) for p in (r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{2}-\d{2}-\d{4}$")]
    v = F.col("v")
    rows = spark.createDataFrame([(x,) for x in sorted(values)], "v string").select(
        v, tx.is_missing(v), tx.is_number(v), tx.is_email(v), tx.is_date_shape(v), tx.strip(v)
    )
    for value, *got in rows.collect():
        t = value.strip()
        want = [t.lower() in {"", "null", "none", "nan", "n/a", "na"}, bool(number.match(t.replace(",", ""))),
                bool(email.match(t)), any(p.match(t) for p in dates), t]
        assert got == want, repr(value)


def test_lanes_split_the_input_and_counts_agree(spark):
    rows, spec = samples.dirty_orders(spark, SF), samples.orders_spec()
    validated = samples.validated_orders(spark, SF)
    found = V.anomalies(validated)
    clean = V.clean_rows(validated)
    bad = found.select("id").distinct()
    assert clean.join(bad, "id").isEmpty()
    assert clean.count() + bad.count() == rows.count() == 1500
    summary = V.summarize(validated, spec).first()
    assert (summary.clean_rows, summary.bad_rows, summary.anomalies) == (1003, 497, 563)
    assert V.summarize_found(rows, tables.cut(found), spec).first() == summary


def test_shuffled_lookup_equals_broadcast(spark, shuffled):
    rows = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise((F.col("id") % 50).cast("string")).alias("k"), F.create_map(F.lit("a"), F.col("id")).alias("m")
    )
    right = spark.createDataFrame([("hot", 1), ("4", 2), ("5", 3), ("unused", 4)], "k string, v int")
    for how in ("left", "inner", "left_semi", "left_anti"):
        got = tables.lookup(rows, right, ["k"], how)
        want = rows.join(right, "k", how)
        assert sorted(got.columns) == sorted(want.columns)
        columns = [c for c in sorted(want.columns) if c != "m"]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted(map(key, got.select(columns).collect())) == sorted(map(key, want.select(columns).collect())), how


def test_duplicates_by_shuffle(spark, shuffled):
    breakdown = {
        (r.column_name, r.error_type): r.anomalies
        for r in V.anomaly_breakdown(V.anomalies(samples.validated_orders(spark, SF)), "column_name", "error_type").collect()
    }
    assert breakdown[("order_ref", "duplicate_value_error")] == 30 and sum(breakdown.values()) == 563


def test_ranks_are_contiguous_on_both_ways(spark, monkeypatch):
    rows = tables.cut(spark.range(500).select((F.col("id") * 37 % 500).alias("x")).repartition(7))
    small = {r.x: r["rank"] for r in tables.ranked(rows, ["x"]).collect()}
    monkeypatch.setattr(tables.S, "ONE_TASK_ROWS", 0)
    large = {r.x: r["rank"] for r in tables.ranked(rows, ["x"]).collect()}
    assert small == large == {i: i + 1 for i in range(500)}


def test_load_tells_how_it_went(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text('{"id": "1", "amount": "x"}\n{"id": "2", "amount": "2"}\n')
    bad.write_text('{"id": "1"}\n{"id"\n')
    spec = ValidationSpec.build({"columns": {"amount": {"type": "numeric"}}})
    cases = {str(good): ("completed", 2, 1), str(bad): ("error", 0, 0), str(tmp_path / "none.csv"): ("error", 0, 0), "": ("no_input", 0, 0)}
    for path, want in cases.items():
        validated, summary = V.load(spark, {"input_path": path}, spec)
        row = summary.first()
        assert (row.status, row.input_rows, row.anomalies) == want
        assert (row.error is not None) is (row.status == "error") is (validated is None and path != "")
    none_yet = spark.createDataFrame([], "id string, amount string")
    assert V.load(spark, none_yet, spec)[1].first().status == "no_input"
