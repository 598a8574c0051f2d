"""Progress events as streams: roll-ups by kind, emission on change, throttled lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.sources import commits

#: Kinds of events that a bridge passes on.
BRIDGED = ("tiling.started", "tiling.progress", "tiling.finished", "tissue.started", "tissue.progress", "tissue.finished", "preview.started", "preview.progress", "preview.finished", "tiling.failed")


def read(spark: SparkSession, folder: str, pattern: str = "events.parquet", max_files: int = 1000) -> DataFrame:
    """Events of a folder as a stream. The checkpoint of the query keeps what has been read; only whole files count."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).parquet(folder)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Event logs, one JSON object a line, as a stream of kind, payload and ts."""
    return spark.readStream.schema("kind string, payload map<string,string>, timestamp double").json(path).select("kind", "payload", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")).alias("ts"))


def drain(stream: DataFrame, folder: str | None = None, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is there now; the result table, an aggregate (complete) or rows (append), as a DataFrame; empty if there was nothing.

    The table and the checkpoint lie in a folder of their own, in the shared one that the session names for
    checkpoints if none is given. Each batch is a commit under its number, so one that is repeated counts once.
    """
    spark = stream.sparkSession
    root = folder or commits.scratch(spark)
    table = commits.Table(spark, f"{root}/table")
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    q = q.foreachBatch(lambda rows, batch: (table.commit({"rows": rows}, f"batch-{batch}", mode == "complete"), None)[1]).start()
    q.awaitTermination()
    rows = table.read("rows")
    return spark.createDataFrame([], stream.schema) if rows is None else rows


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """Number and sum of values of each kind, by a stream that ends when all files are read."""
    s = read(spark, folder).groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return drain(s)


def bridged(events: DataFrame, kinds=BRIDGED) -> DataFrame:
    return events.where(F.col("kind").isin(*kinds))


def throttled(lines: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Of lines (key, line, ts) in a table: drops a line that repeats the last one shown for its key within a time.

    Spark sorts the lines of each key; a task walks them and holds only the line shown last. Further columns are not kept.
    """
    rows = lines.select("key", "line", "ts").repartition("key").sortWithinPartitions("key", "ts", "line")
    least = int(seconds * 1e6)

    def walk(frames):
        last = None  # key, line and time of what was shown last
        for frame in frames:
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            keep = []
            for key, line, at in zip(frame["key"], frame["line"], micros):
                again = last is not None and last[0] == key and last[1] == line and at - last[2] < least
                if not again:
                    last = key, line, at
                keep.append(not again)
            yield frame[keep]

    return rows.mapInPandas(walk, rows.schema)


def throttled_stream(lines: DataFrame, seconds: str = "1 second") -> DataFrame:
    """The same for streams, where a repeat counts from its first line."""
    return lines.withWatermark("ts", seconds).dropDuplicatesWithinWatermark(["key", "line"])


def on_change(status: DataFrame, previous: DataFrame | None, keys=("total", "completed", "failed", "pending", "discovered_tiles")) -> DataFrame:
    """A snapshot, if it differs from the one before; else no row. For streams see `monitor`."""
    if previous is None:
        return status
    on = F.lit(True)
    for k in keys:
        on = on & status[k].eqNullSafe(previous[k])
    return status.join(previous, on, "left_anti")
