import json

import pytest

from mendframe.operators.clustering import REGISTRY
from mendframe.sources import readers, state


def test_csv_with_mark_and_blank_lines(spark, tmp_path):
    (tmp_path / "in.csv").write_bytes("﻿id,name\n1,a\n\n2,\n".encode())
    rows = readers.read_rows(spark, str(tmp_path / "in.csv")).collect()
    assert [(r.id, r.name) for r in rows] == [("1", "a"), ("2", None)]


@pytest.mark.parametrize("document,count", [
    ([{"a": 1}, 5, {"b": "x"}], 2), ({"a": 1}, 1), ({"records": [{"a": 1}, "no", {"a": 2}]}, 2), ({"records": {"a": 1}}, 1), ([], 0),
])
def test_json_shapes(spark, tmp_path, document, count):
    (tmp_path / "in.json").write_text("﻿" + json.dumps(document, indent=1), encoding="utf-8")
    assert readers.read_json(spark, str(tmp_path / "in.json")).count() == count


def test_jsonl_skips_and_fails(spark, tmp_path):
    good = tmp_path / "in.jsonl"
    good.write_text('{"a": 1}\n\n[1]\n{"b": {"c": 2}}\n')
    rows = readers.read_rows(spark, str(good), ["a", "b"]).collect()
    assert sorted((r.a, r.b) for r in rows if r.a) == [("1", None)] and any(r.b == '{"c":2}' for r in rows)
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="malformed JSON line"):
        readers.read_rows(spark, str(bad), ["a"]).collect()


def test_input_choice(spark, tmp_path):
    table = spark.range(1)
    assert readers.resolve_input(spark, {"raw_rows": table, "input_path": "x.csv"}) is table
    assert readers.resolve_input(spark, {}) is None
    with pytest.raises(ValueError, match="Unsupported"):
        readers.resolve_input(spark, {"dataset_path": "x.xml"})
    with pytest.raises(Exception):
        readers.resolve_input(spark, {"source_file": str(tmp_path / "none.csv")})


def test_schema_file(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"unique_columns": ["a"]}')
    assert readers.load_schema(spark, None, str(tmp_path / "s.json")) == {"unique_columns": ["a"]}
    assert readers.load_schema(spark, {"x": 1}, "unused") == {"x": 1}


def test_rule_documents(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("Title:\n\n- one\n  two \n")
    rows = readers.read_rule_documents(spark, str(tmp_path / "rules.txt")).orderBy("pos").collect()
    assert [(r.id, r.text, r.source_weight) for r in rows] == [("rules_1", "Title:", 0.3), ("rules_2", "- one", 0.3), ("rules_3", "two", 0.3)]


def test_long_csv_rows_are_visible(spark, tmp_path):
    (tmp_path / "in.csv").write_text("a,b\n1,2\n1,2,3\n")
    rows = readers.flag_long_rows(spark, str(tmp_path / "in.csv"), ["a", "b"]).cache()
    assert sorted(r.malformed for r in rows.collect()) == [False, True]


def test_registry_versions_and_broken_files(spark, tmp_path):
    folder = str(tmp_path / "registry")
    assert state.load_registry(spark, folder).count() == 0
    row = ("k", "family_00001", 1, "d", "d", 1, "cluster_1")
    state.save_table(spark.createDataFrame([row], REGISTRY), folder)
    state.save_table(spark.createDataFrame([row, ("k2", *row[1:])], REGISTRY), folder)
    assert state.load_registry(spark, folder).count() == 2
    for file in (tmp_path / "registry" / "v2").glob("*.parquet"):
        file.write_bytes(b"broken")
    for file in (tmp_path / "registry" / "v2").glob(".*.crc"):
        file.write_bytes(b"")
    assert state.load_registry(spark, folder).count() == 1


def test_anomaly_folder_keeps_an_object_with_records_whole(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"id": "7", "records": [{"id": "8"}, {"id": "9"}]}')
    (tmp_path / "two.json").write_text('[{"id": "1"}, 4, {"id": "2"}]')
    rows = readers.read_anomaly_directory(spark, str(tmp_path)).collect()
    assert sorted((r.file, r.row["id"]) for r in rows) == [("one.json", "7"), ("two.json", "1"), ("two.json", "2")]


def test_anomaly_folder_of_all_kinds(spark, tmp_path):
    """Headers and schemas differ from file to file, cells hold line breaks, some files are damaged."""
    (tmp_path / "a.csv").write_text('id,value\n1,"x\ny"\n2,z,extra\n')
    (tmp_path / "b.csv").write_text('value,id,"column,name"\n"q ""r""",3,c\n,4,\n')
    (tmp_path / "c.csv").write_text("\n")
    (tmp_path / "d.json").write_text('[{"id": "5"}, {"id": "6"}]')
    (tmp_path / "e.jsonl").write_text('{"id": "7"}\n')
    (tmp_path / "f.parquet").write_bytes(b"no parquet at all, but long enough for a footer")
    (tmp_path / "g.parquet").write_bytes(b"PAR1")
    (tmp_path / "other.txt").write_text("not read")
    import pandas as pd

    pd.DataFrame({"id": [8, 9], "value": [1.5, None]}).to_parquet(tmp_path / "h.parquet")
    pd.DataFrame({"id": ["10"], "more": [True]}).to_parquet(tmp_path / "i.parquet")
    rows, skipped = readers.read_anomaly_folder(spark, str(tmp_path))
    got = [(r.file, r.row) for r in rows.orderBy("file", "at").collect()]
    assert got == [
        ("a.csv", {"id": "1", "value": "x\ny"}), ("a.csv", {"id": "2", "value": "z", "_malformed": "2,z,extra"}),
        ("b.csv", {"value": 'q "r"', "id": "3", "column,name": "c"}), ("b.csv", {"value": None, "id": "4", "column,name": None}),
        ("d.json", {"id": "5"}), ("d.json", {"id": "6"}), ("e.jsonl", {"id": "7"}),
        ("h.parquet", {"id": "8", "value": "1.5"}), ("h.parquet", {"id": "9", "value": None}), ("i.parquet", {"id": "10", "more": "true"}),
    ]
    assert [tuple(r) for r in skipped.orderBy("file").collect()] == [
        ("c.csv", "no header"), ("f.parquet", "no readable footer"), ("g.parquet", "no readable footer")]
    with pytest.warns(UserWarning, match="left out"):
        assert readers.read_anomaly_directory(spark, str(tmp_path)).count() == 10
    (tmp_path / "bad.json").write_text("[{")
    with pytest.raises(Exception):
        readers.read_anomaly_folder(spark, str(tmp_path))[0].collect()


def test_empty_anomaly_folder(spark, tmp_path):
    rows, skipped = readers.read_anomaly_folder(spark, str(tmp_path))
    assert rows.collect() == [] and skipped.collect() == []
