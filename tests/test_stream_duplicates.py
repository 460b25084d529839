import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from mendframe.streaming import duplicates, lanes

SCHEMA = "id string, v string, at timestamp"
START = datetime(2024, 1, 1)


def write(spark, folder, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n}")


def run(spark, folder, keep="400 days"):
    """Everything that is new since the last run; state comes from the checkpoint."""
    rows = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    flags = duplicates.duplicate_flags(rows, "v", "id", "at", keep, "1 hour")
    lanes.start_table(flags, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(duplicates.FLAGS).parquet(f"{folder}/out")


def test_flags_equal_those_of_the_whole_table_after_a_restart(spark, tmp_path):
    """Groups over several batches and a stop between them; half of all rows have one value."""
    rng = random.Random(3)
    folder, everything = str(tmp_path), []
    for n in range(3):
        rows = [(f"{n}-{i}", rng.choice(["hot", "HOT ", None, "n/a", *(f"v{rng.randrange(150)}" for _ in range(3))]), START + timedelta(hours=n, minutes=i)) for i in range(60)]
        write(spark, folder, n, rows)
        everything += rows
        if n == 0:
            run(spark, folder)  # then stopped, and started again on what follows
    found = run(spark, folder).collect()
    groups = defaultdict(set)
    for row_id, value, _ in everything:
        if value not in (None, "n/a"):
            groups[value.lower().strip()].add(row_id)
    want = {(k, i) for k, ids in groups.items() if len(ids) > 1 for i in ids}
    assert sorted((r.dup_key, r.row_id) for r in found) == sorted(want)
    firsts = [r for r in found if r.flag == "first"]
    assert len(firsts) == len({k for k, _ in want}) and len(want) > 60


def test_keys_are_forgotten(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, 0, [("a", "x", START), ("b", "y", START)])
    write(spark, folder, 1, [("c", "z", START + timedelta(days=30))])
    write(spark, folder, 2, [("d", "x", START + timedelta(days=31)), ("e", "z", START + timedelta(days=31))])
    found = run(spark, folder, keep="5 days").collect()
    assert sorted((r.dup_key, r.row_id, r.flag) for r in found) == [("z", "c", "first"), ("z", "e", "repeat")]


def test_a_key_has_one_state_whatever_its_shares(spark, tmp_path):
    """Forty rows of every value over two batches, some rows twice; the state is a row per value."""
    folder = str(tmp_path)
    rows = [[(f"{n}-{i // 2 if i < 20 else i}", f"v{i % 30}", START + timedelta(hours=n, minutes=i)) for i in range(600)] for n in range(2)]
    for n in range(2):
        write(spark, folder, n, rows[n])
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = lanes.start_table(duplicates.duplicate_flags(source, "v", "id", "at", "400 days", "1 hour"), f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) == 30
    found = spark.read.schema(duplicates.FLAGS).parquet(f"{folder}/out").collect()
    assert sorted((r.dup_key, r.row_id) for r in found) == sorted((v, i) for part in rows for i, v, _ in part)
    firsts = {r.dup_key: r.ts for r in found if r.flag == "first"}
    assert len(firsts) == sum(r.flag == "first" for r in found) == 30
    assert all(firsts[v] == min(at for part in rows for _, w, at in part if w == v) for v in firsts)


def test_rows_without_a_time_or_an_id(spark, tmp_path):
    folder = str(tmp_path)
    write(spark, folder, 0, [("a", "x", None), (None, "y", START), (None, "y", START), ("b", "z", None), ("c", "w", START)])
    write(spark, folder, 1, [("d", "x", START), ("e", "z", None), (None, "z", None), ("f", "w", START)])
    found = run(spark, folder).collect()
    assert sorted((r.dup_key, r.row_id or "", r.flag) for r in found) == [
        ("w", "c", "first"), ("w", "f", "repeat"), ("x", "a", "first"), ("x", "d", "repeat"),
        ("y", "", "first"), ("y", "", "repeat"), ("z", "", "repeat"), ("z", "b", "first"), ("z", "e", "repeat"),
    ]
    assert all((r.ts is None) == (r.dup_key == "z" or r.row_id == "a") for r in found)
