"""Progress of runs from their events: a snapshot for each change, in the order of time, whatever order they arrive in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SNAPSHOT = "key string, ts timestamp, total long, completed long, failed long, pending long, discovered_tiles long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


COUNTS = ["completed", "failed", "tiles"]
#: Groups of keys, whose state lies together; rows that one part of a state holds.
BUCKETS, CHUNK = 1024, 10000


def packed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


class Monitor(StatefulProcessor):
    """State of a bucket of keys: events that may still be overtaken, in parts, and the last counts of its keys. A timer fires when the watermark has passed the first of the events.

    Keys share calls and state, since one call for a key takes longer than dozens of its events.
    """

    def __init__(self, total: int) -> None:
        self.total = total

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.last = handle.getValueState("last", "counts binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for frame in rows:
            us = frame["ts"].astype("datetime64[us]").astype("int64").to_numpy()
            numbers = {c: pa.array(frame[c].to_numpy(), pa.int64()) for c in ("id", *COUNTS)}
            self.waiting.appendValue((packed(pa.table({"key": pa.array(frame["key"], pa.string()), "us": pa.array(us), **numbers})),))
            first = int(us.min()) if first is None else min(first, int(us.min()))
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        parts = [unpacked(p) for (p,) in self.waiting.get()] if self.waiting.exists() else []
        if not parts:
            return
        rows = pa.concat_tables(parts)
        us = rows["us"].to_numpy()
        over = us // 1000 < now
        rest = rows.filter(pa.array(~over))
        if rest.num_rows:
            self.waiting.put([(packed(rest.slice(n, CHUNK)),) for n in range(0, rest.num_rows, CHUNK)])
            self.handle.registerTimer(int(us[~over].min()) // 1000 + 1)
        else:
            self.waiting.clear()
        ready = rows.filter(pa.array(over)).sort_by([(c, "ascending") for c in ("key", "us", "id", *COUNTS)])
        if not ready.num_rows:
            return
        keys = ready["key"].combine_chunks()
        codes, names = pd.factorize(np.array(keys.to_pylist(), object), use_na_sentinel=False)
        names = [k if isinstance(k, str) else None for k in names]
        last = {k: v for k, *v in zip(*unpacked(self.last.get()[0]).to_pydict().values())} if self.last.exists() else {}
        before = np.array([last.get(k, (0, 0, 0)) for k in names], np.int64)
        added = np.stack([ready[c].to_numpy() for c in COUNTS], 1)
        # Sums over all keys, less what they were where a key begins.
        sums, starts = np.cumsum(added, 0), np.searchsorted(codes, np.arange(len(names)))
        counts = sums + (before - sums[starts] + added[starts])[codes]
        last.update(zip(names, counts[np.append(starts[1:], len(codes)) - 1].tolist()))
        self.last.update((packed(pa.table({"key": pa.array(last, pa.string()), **{c: pa.array([v[n] for v in last.values()], pa.int64()) for n, c in enumerate(COUNTS)}})),))
        new = added.any(1)
        done, bad, tiles = counts[new].T
        at = pd.Series(ready["us"].to_numpy()[new]).astype("datetime64[us]")
        yield pd.DataFrame({"key": keys.filter(pa.array(new)).to_pylist(), "ts": at, "total": self.total, "completed": done, "failed": bad, "pending": np.maximum(0, self.total - done - bad), "discovered_tiles": tiles})

    def close(self) -> None:
        pass


def snapshots(events: DataFrame, total: int, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Snapshots of each key where they change. events: a stream of key, ts, id, completed, failed, tiles (0 or what is added).

    Events are put in order by ts and id; one is counted when the watermark, delay behind the latest, has passed it.
    buckets: groups of keys by hash, of which a task holds one at a time; a checkpoint goes with their number.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = events.select(F.col("key").cast("string"), "ts", F.col("id").cast("long"), *(F.col(c).cast("long") for c in COUNTS)).withWatermark("ts", delay)
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(Monitor(total), SNAPSHOT, "Append", "EventTime")
