import pytest
from pyspark.sql import functions as F

from inputs import SF
from mendframe.functions import tables
from mendframe.operators import promotion
from mendframe.plans import batches
from mendframe.plans.catalog import RELAXED_GUARD, RELAXED_PROMOTION
from mendframe.plans.samples import dirty_orders, orders_spec

POLICIES = {"guardrail_policy": RELAXED_GUARD, "promotion_policy": RELAXED_PROMOTION}
SETTINGS = {"seen_at": "2024-01-01T00:00:00+00:00", "order_by": "CAST(id AS BIGINT)"}


def lane(spark, folder):
    rows = batches.promoted_lane(spark, folder).select("batch_id", "member_id", "target_column", "promoted_value")
    return sorted(map(tuple, rows.collect()), key=str)


def test_a_broken_batch_goes_on_and_is_replayed(spark, tmp_path, monkeypatch):
    rows = dirty_orders(spark, SF).where("CAST(id AS BIGINT) < 600")
    whole, broken = str(tmp_path / "whole"), str(tmp_path / "broken")
    batches.run_batch(rows, orders_spec(), whole, "b", **SETTINGS, **POLICIES)
    want = lane(spark, whole)
    assert want

    with monkeypatch.context() as m:  # between staging and promotion
        m.setattr(promotion, "promoted_clusters", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            batches.run_batch(rows, orders_spec(), broken, "b", **SETTINGS, **POLICIES)
    assert batches.promoted_lane(spark, broken) is None
    assert [tuple(r) for r in batches.batch_journal(spark, broken).collect()] == [("b", SETTINGS["seen_at"], False)]

    first = batches.replay(spark, broken, "b", **POLICIES)
    done = dict(first.extra["journal"])
    assert done["judged"] and done["members"] and done["plan"]  # read, not computed again
    assert not done["promoted"]
    assert lane(spark, broken) == want
    again = batches.replay(spark, broken, "b", **POLICIES)
    assert all(complete for _, complete in again.extra["journal"])
    assert lane(spark, broken) == want
    assert batches.batch_journal(spark, broken).first().committed

    # the same batch may be asked for again, but not with other rows
    batches.run_batch(rows, orders_spec(), broken, "b", **SETTINGS, **POLICIES)
    with pytest.raises(ValueError, match="other rows"):
        batches.run_batch(rows.limit(5), orders_spec(), broken, "b", **SETTINGS, **POLICIES)
    with pytest.raises(ValueError, match="no batch"):
        batches.replay(spark, broken, "unknown")


def test_a_table_without_its_mark_is_written_again(spark, tmp_path):
    source = spark.range(5).withColumn("v", F.lit("a"))
    with tables.journal(str(tmp_path)):
        tables.cut(source, "t")
    (tmp_path / "0000-t" / "_SUCCESS").unlink()
    with tables.journal(str(tmp_path)) as steps:
        assert tables.cut(source.withColumn("v", F.lit("b")), "t").where("v = 'b'").count() == 5
    assert steps.done == [("t", False)]
    with tables.journal(str(tmp_path)) as steps, pytest.raises(tables.Stopped):
        assert tables.cut(source, "t").where("v = 'b'").count() == 5
        steps.stop_before = "u"
        tables.cut(source, "u")
    with pytest.raises(Exception):
        tables.create_file(spark, str(tmp_path / "f"), "a") or tables.create_file(spark, str(tmp_path / "f"), "b")
