import csv
import io
import random

from pyspark.sql import functions as F

from mendframe import settings as S
from mendframe.operators import validation
from mendframe.plans.run import run
from mendframe.settings import ValidationSpec
from mendframe.sources import csv_records, readers


def python_rows(text, width):
    """What csv.reader sees: cells padded to the header, and whether their number differs."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]
    return [(tuple((c or None) for c in (r + [""] * width)[:width]), len(r) != width) for r in rows]


def made(rng, n):
    cells = ["a", "", "x y", 'say ""hi""', "l1\nl2", "c,d", "\n", 'q""', "é", "a\r\nb", '"', "5"]
    lines = ["id,note,n"]
    for i in range(n):
        row = [str(i)]
        for _ in range(rng.choice([2, 2, 2, 2, 1, 3])):
            cell = rng.choice(cells)
            row.append(f'"{cell.replace(chr(34), chr(34) * 2) if cell == chr(34) else cell}"' if any(c in cell for c in ',"\n\r') or rng.random() < 0.2 else cell)
        lines.append(",".join(row))
        if rng.random() < 0.05:
            lines.append("")
    return "\n".join(lines) + "\n"


def test_records_in_many_blocks_against_the_csv_module(spark, tmp_path):
    """Line breaks in quotes lie anywhere, also across the splits of a file; several files with their own headers."""
    rng = random.Random(9)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for n in range(3):
            folder = tmp_path / f"in{n}.csv"
            folder.mkdir()
            texts = [made(rng, 150) for _ in range(2)]
            for k, text in enumerate(texts):
                (folder / f"part{k}.csv").write_bytes(text.encode())
            assert csv_records.read_lines(spark, str(folder)).select("file", "block").distinct().count() > 6
            rows = readers.read_rows(spark, str(folder), multiline=True).collect()
            got = sorted((((r.id, r.note, r.n), r[S.MALFORMED] is not None) for r in rows), key=str)
            want = sorted((x for text in texts for x in python_rows(text, 3)), key=str)
            assert [g for g in got if not g[1]] == [w for w in want if not w[1]]
            assert sum(g[1] for g in got) == sum(w[1] for w in want) > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_states_of_lines(spark):
    lines = ['a,b', '"a', 'a"', '"a"', '"a""', '"a"",b', 'x"y', '"a",x"y', '"a","b', '"a","b"",', '"', '""', 'a,"', '"x"y"', ',"q,', '']

    def slow(line, opened):
        """State after the line by the csv module's own automaton."""
        rows = list(csv.reader(io.StringIO(('"' if opened else "") + line + "\nmark\n", newline="")))
        return not (rows and rows[-1] == ["mark"])

    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    got = frame.select("line", csv_records.ends_open(F.col("line"), False), csv_records.ends_open(F.col("line"), True)).collect()
    for line, closed, opened in got:
        assert closed == slow(line, False), line
        assert opened == slow(line, True), line


def test_a_cell_that_never_closes(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,n\n1,a\n2,\"b\n" + "".join(f"{i},c\n" for i in range(3, 40)))
    rows = csv_records.read_csv_records(spark, str(tmp_path / "in.csv"), max_lines=10).collect()
    assert len(rows) == 39 and sum(r[S.MALFORMED] is not None for r in rows) == 38
    assert next(r for r in rows if r.id == "1")[S.MALFORMED] is None


def test_malformed_rows_become_anomalies(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,amount\n1,10\n2,20,EXTRA\n3\n4,"x\ny"\n5,1e5,a,b\n')
    spec = ValidationSpec.build({"columns": {"amount": {"required": True}}})
    for multiline in (False, True):
        source = {"input_path": str(tmp_path / "in.csv"), "multiline": multiline}
        validated, summary = validation.load(spark, source, spec)
        lines = 5 if multiline else 6
        row = summary.first()
        assert (row.status, row.input_rows) == ("completed", lines)
        found = validation.anomalies(validated).where(F.col("error_type") == S.MALFORMED_ERROR[0])
        texts = {r.value for r in found.collect()}
        assert {"2,20,EXTRA", "3", "5,1e5,a,b"} <= texts and row.malformed_row_error == len(texts) == (3 if multiline else 4)
        assert S.MALFORMED not in validation.clean_rows(validated).columns
        assert {r.id for r in validation.clean_rows(validated).collect()} == {"1"}
        assert all(S.MALFORMED not in r.source_row for r in found.collect())
    result = run(readers.resolve_input(spark, source), spec, order_by=F.col("id").cast("bigint"))
    assert result.summary.first().malformed_row_error == 3
    assert result.anomalies.where("error_type = 'malformed_row_error'").count() == 3


def test_empty_files(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,n\n")
    assert csv_records.read_csv_records(spark, str(tmp_path / "in.csv")).collect() == []
    assert readers.read_rows(spark, str(tmp_path / "in.csv")).collect() == []
