"""Sessions on a stream: state by group of (user, week, computer), event-time timers, late rows left out.

Rows may come in any order within the watermark's delay. They wait in the state until the watermark has passed them, and are
then taken in the order of time: a session is written when an action closes it. When the week is over its last session is
dropped if it is still open. State is what may still be out of order, and one open session for each user, week and computer.

A call between Python and the state costs more than many rows do, so keys are dealt by hash to GROUPS groups: a group's rows
are handled together, in columns, and its state is Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Groups of keys; fixed for the life of a checkpoint. A task holds one group's rows of the watermark's delay at a time.
GROUPS = 256
OUTPUT = "user long, week int, pcid string, start_with int, end_with int, start_us long, end_us long, n_acts long"
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY = {"user": pa.int64(), "week": pa.int32(), "pcid": pa.string()}
_WAITING = pa.schema(_KEY | {"us": pa.int64(), "actid": pa.int64(), "act": pa.int32()})
_OPEN = pa.schema(_KEY | {"start_with": pa.int32(), "first": pa.int64(), "last": pa.int64(), "n": pa.int64()})


def _packed(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, schema) as writer:
        writer.write_table(pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False))
    return (out.getvalue().to_pybytes(),)


def _unpacked(packed: list[tuple[bytes]], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(b)).read_all() for (b,) in packed]
    return pa.concat_tables([schema.empty_table(), *tables]).to_pandas()


def _sessions(ready: pd.DataFrame, opened: pd.DataFrame) -> pd.DataFrame:
    """The sessions that the rows of `ready` make or go on with, with end_with: 0 where a session stays open.

    Both have `key`. An open session stands before its key's rows as an action that opened it. A logoff closes at odd places
    in a run of logoffs, at even ones if nothing precedes the run.
    """
    new = ready.assign(first=ready["us"], last=ready["us"], n=1, start_with=np.where(ready["act"] == 1, 1, 2))
    rows = pd.concat([opened.assign(us=opened["first"], actid=0, act=0, old=0), new.assign(old=1)], ignore_index=True)
    rows = rows.sort_values(["key", "old", "us", "actid", "act"], ignore_index=True)
    key, act, at = rows["key"].to_numpy(), rows["act"].to_numpy(), np.arange(len(rows))
    head = np.append(True, key[1:] != key[:-1])
    start = np.maximum.accumulate(np.where(head, at, 0))
    other = np.maximum.accumulate(np.where(act != 2, at, -1))
    after = other >= start
    closes = (act == 2) & (np.where(after, at - other, at - start + 1) % 2 == after)
    opens = head | (act == 1) | np.append(False, closes[:-1])
    begin = np.flatnonzero(opens)
    end = np.append(begin[1:], len(rows)) - 1
    final = np.append(head[1:], True)[end]
    out = rows.loc[begin, ["key", *_KEY, "start_with", "first"]].reset_index(drop=True)
    return out.assign(last=rows["last"].to_numpy()[end], n=np.add.reduceat(rows["n"].to_numpy(), begin), end_with=np.where(closes[end], 1, np.where(final, 0, 2)))


class Sessions(StatefulProcessor):
    """A logon opens a session and ends the one before it (end 2); a logoff ends it (end 1), any other first action opens one.

    `first_sunday` is when week 0 begins, in milliseconds.
    """

    def __init__(self, first_sunday: int):
        self.first_sunday = first_sunday

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.open = handle.getValueState("open", "rows binary")

    def _wake(self, at: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int(at))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] >= 0:  # rows without a user, a week or a time only carry the time
            first = list(self.handle.listTimers())
            for new in rows:
                self.waiting.appendValue(_packed(new, _WAITING))
                first.append(-(-int(new["us"].min()) // 1000))
            self._wake(min(first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = _unpacked(list(self.waiting.get()), _WAITING)
        opened = _unpacked([self.open.get()] if self.open.exists() else [], _OPEN)
        keys = pd.concat([rows[list(_KEY)], opened[list(_KEY)]], ignore_index=True).groupby(list(_KEY), dropna=False, sort=False).ngroup().to_numpy()
        rows["key"], opened["key"] = keys[: len(rows)], keys[len(rows) :]
        later = rows[rows["us"] > now * 1000]
        found = _sessions(rows[rows["us"] <= now * 1000], opened) if len(keys) > len(later) else opened.assign(end_with=0)
        left = found[found["end_with"] == 0]
        over = self.first_sunday + (left["week"].astype("int64") + 1) * 7 * 86_400_000
        left, over = left[left["key"].isin(later["key"]) | (now < over)], over[now < over]
        self.waiting.clear()
        self.open.clear()
        if len(later):
            self.waiting.appendValue(_packed(later, _WAITING))
        if len(left):
            self.open.update(_packed(left, _OPEN))
        wake = ([-(-int(later["us"].min()) // 1000)] if len(later) else []) + ([int(over.min())] if len(over) else [])
        if wake:
            self._wake(min(wake))
        done = found[found["end_with"] > 0].rename(columns={"first": "start_us", "last": "end_us", "n": "n_acts"})
        return iter([done[[*_KEY, "start_with", "end_with", "start_us", "end_us", "n_acts"]]] if len(done) else [])

    def close(self) -> None:
        pass


def session_stream(acts: DataFrame, first_sunday: str, late: str = "2 days") -> DataFrame:
    """The complete sessions of a stream of actions (user, week, pcid, ts, actid, act), each when the watermark has passed its end.

    Rows that come more than `late` after the latest time seen are left out. Rows without a user belong to no session, but
    their time counts: a source can send them when it falls silent.
    """
    begin = int((datetime.fromisoformat(first_sunday) - datetime(1970, 1, 1)).total_seconds() * 1000)
    whole = F.col("user").isNotNull() & F.col("week").isNotNull() & F.col("ts").isNotNull()
    group = F.when(whole, F.pmod(F.xxhash64("user", "week", "pcid"), F.lit(GROUPS))).otherwise(-1).cast("int")
    number = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    s = acts.withWatermark("ts", late).select(
        group.alias("group"), "ts", number("user", "long"), number("week", "int"), "pcid", F.coalesce(F.unix_micros("ts"), F.lit(0)).alias("us"), number("actid", "long"), number("act", "int")
    )
    out = s.groupBy("group").transformWithStateInPandas(Sessions(begin), OUTPUT, "Append", "EventTime")
    times = [F.timestamp_micros(c).alias(n) for c, n in (("start_us", "start_ts"), ("end_us", "end_ts"))]
    return out.select("user", "week", "pcid", "start_with", "end_with", *times, "n_acts")


def append_to_parquet(stream: DataFrame, path: str) -> None:
    """Take what is new in a stream, and append its rows under `path`; a later call with the same path goes on from there."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/result").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        spark.conf.set(_STORE, before)


def appended(stream: DataFrame, path: str) -> DataFrame:
    """What `append_to_parquet` has written so far."""
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/result")
