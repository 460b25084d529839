"""Duplicates in a stream by keyed state: every repeat is flagged as it comes, the first of a group once it has one.

A key may hold any share of the rows, so the rows of a batch are dealt over ``SHARES`` tasks
by key first, in groups of many keys. There every row but the earliest of its key is flagged,
and that one (its lead) goes on with word of the others. A second step keeps the state, one
row per key, and settles which of the leads repeat another. Flagged rows pass it under spread
keys of their own. So a key costs one state, read and written with the rows, whatever its shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mendframe.functions import text as tx
from mendframe.operators import validation
from mendframe.streaming.lanes import event_time

SHARES = 16  # tasks over which the rows of one key may be spread
LOTS = 64  # groups of keys in a share
SPREAD = 1_024  # keys under which flagged rows pass the second step
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ROUTED = "route string, dup_key string, row_id string, ts timestamp, last timestamp, more boolean"
_HELD = "row_id string, micros long, flagged boolean, due long"
FLAGS = "dup_key string, row_id string, ts timestamp, flag string"


class _Share(StatefulProcessor):
    """The rows of a batch in one share of a lot of keys: the earliest of each key leads, the others repeat it. It keeps nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[["dup_key", "row_id", "ts"]].sort_values(["dup_key", "ts", "row_id"], ignore_index=True)
            keys = frame.groupby("dup_key", sort=False)
            leads = ~frame.dup_key.duplicated()
            spread = pd.util.hash_array(frame.row_id.to_numpy(dtype=object)) % SPREAD
            frame["route"] = ("k" + frame.dup_key).where(leads, pd.Series(spread).map("f{}".format))
            frame["last"], frame["more"] = keys.ts.transform("max"), keys.dup_key.transform("size") > 1
            yield frame[["route", "dup_key", "row_id", "ts", "last", "more"]]

    def close(self) -> None:
        pass


def _settle(keep_ms: int):
    """The leads of one key. The first waits for another row; all others repeat it. Other keys only pass on what is flagged.

    The state goes when its event time is ``keep_ms`` behind the watermark; rows of a batch
    are seen before its timeouts, so one that is due counts as gone.
    """

    def settle(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if key[0].startswith("f"):
            for frame in rows:
                yield frame.assign(flag="repeat")[["dup_key", "row_id", "ts", "flag"]]
            return
        first, flagged, due = None, False, None
        watermark = state.getCurrentWatermarkMs()
        if state.exists:
            row_id, micros, flagged, due = state.get
            first = (row_id, pd.NaT if micros is None else pd.Timestamp(micros, unit="us"))
            if due is not None and due <= watermark:
                first, flagged, due = None, False, None
        for frame in rows:
            dup_key = frame.dup_key.iat[0]
            frame = frame.sort_values(["ts", "row_id"])
            leads = list(zip(frame.row_id, frame.ts))
            out, more = [], first is not None or len(leads) > 1 or frame.more.iat[0]
            if first is None:
                first = leads.pop(0)
            if more and not flagged:
                out, flagged = [(dup_key, *first, "first")], True
            out += [(dup_key, *lead, "repeat") for lead in leads]
            last = frame["last"].max()  # none if no row has a time: then the watermark counts, once there is one
            latest = watermark if pd.isna(last) else int(last.timestamp() * 1000)
            if latest > 0:
                due = max(due or 0, latest + keep_ms)
            if out:
                yield pd.DataFrame(out, columns=["dup_key", "row_id", "ts", "flag"])
        row_id, ts = first
        state.update((row_id, None if pd.isna(ts) else ts.value // 1_000, flagged, due))
        if due is not None:
            state.setTimeoutTimestamp(due)

    return settle


def duplicate_flags(rows: DataFrame, column: str, row_id: str, time: str, keep: str, lateness: str) -> DataFrame:
    """(dup_key, row_id, ts, flag) of a stream: all members of every group of equal values.

    The second and later rows are flagged ``repeat`` in the batch they come in, the one
    row that came before them ``first`` in the batch of its first repeat. A key is forgotten when
    the watermark, ``lateness`` behind the newest row, passes its last row by ``keep``.
    Rows with a missing value, by the rules of batch validation, are in no group; rows
    later than the watermark are left out, as in any stream. A row without a time counts as of the
    watermark; before there is one, it keeps its key until a later row comes.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    keep_ms = int(spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL '{keep.split()[0]}' {keep.split()[1]})").first()[0])
    timed = event_time(rows, time).withWatermark(time, lateness)
    key = tx.dedup_key(validation.cell_text(rows, column))
    named = timed.select(key.alias("dup_key"), F.col(row_id).cast("string").alias("row_id"), F.col(time).alias("ts")).where("dup_key IS NOT NULL")
    lot, share = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("dup_key", LOTS), ("row_id", SHARES)))
    shares = named.withColumns({"lot": lot, "share": share}).groupBy("lot", "share")
    routed = shares.transformWithStateInPandas(_Share(), _ROUTED, "append", "eventTime", eventTimeColumnName="ts")
    return routed.groupBy("route").applyInPandasWithState(_settle(keep_ms), FLAGS, _HELD, "append", GroupStateTimeout.EventTimeTimeout)
