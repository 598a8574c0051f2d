"""Work assignment: contiguous shards, longest-first balancing, packing of groups, stratified samples, trial plans."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.sources import commits


def numbered(rows: DataFrame, order: Sequence[str | Column], out: str = "number") -> tuple[DataFrame, int]:
    """Adds the place of each row in an order over all of them, from 0, and gives their number.

    Sorted by ranges over all partitions and written to a scratch table, so that places cannot change; a place is that in
    the partition plus the rows of those before, of which the driver holds a number each.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    path = commits.scratch(spark)
    ranged.withColumn("_part", F.shiftright("_n", 33)).write.parquet(path)
    kept = spark.read.parquet(path)
    add, total = [], 0
    for r in kept.groupBy("_part").agg(F.min("_n").alias("first"), F.count("*").alias("rows")).orderBy("_part").collect():
        add.append((r["_part"], total - r["first"]))
        total += r["rows"]
    offsets = spark.createDataFrame(add, "_part long, _add long")
    return kept.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_n") + F.col("_add")).drop("_n", "_part", "_add"), total


def contiguous_shards(rows: DataFrame, shards: int, order: Sequence[str], key: Sequence[str] = (), out: str = "shard") -> DataFrame:
    """Splits rows of each key, in order, into shards of sizes that differ by one at most, the larger ones first."""
    if shards < 1:
        raise ValueError("one shard at least")
    if key:
        return rows.withColumn(out, F.ntile(shards).over(Window.partitionBy(*key).orderBy(*order)) - 1)
    placed, n = numbered(rows, order, "_at")
    size, larger = divmod(n, shards)
    at, first = F.col("_at"), larger * (size + 1)
    shard = F.when(at < first, F.floor(at / (size + 1))).otherwise(larger + F.floor((at - first) / max(1, size)))
    return placed.withColumn(out, shard.cast("int")).select(*rows.columns, out)


def shares(classes: Sequence[tuple[int, int]], ranks: int) -> Iterator[tuple[int, int, int, int]]:
    """For classes (weight, units), heaviest first: (weight, rank, load before, units that the rank gets), none of which is 0.

    Units of one weight w go where the load is least, so of the loads of rank i, load + w, load + 2 w, ..., the smallest
    of all ranks are taken, ties by rank. How many each gets follows from the load that the last one meets.
    """
    load = [0] * ranks
    for w, n in classes:
        if w <= 0:  # the least loaded stays so
            got = [0] * ranks
            got[load.index(min(load))] = n
        else:
            low, high = min(load), max(load) + w * n
            while low < high:  # the least load that n steps do not go beyond
                mid = (low + high) // 2
                if sum((mid - v) // w + 1 for v in load if v <= mid) >= n:
                    high = mid
                else:
                    low = mid + 1
            got = [(low - 1 - v) // w + 1 if v <= low - 1 else 0 for v in load]
            left = n - sum(got)
            for i, v in enumerate(load):
                if left and v <= low and (low - v) % w == 0:
                    got[i] += 1
                    left -= 1
        for i, g in enumerate(got):
            if g:
                yield w, i, load[i], g
                load[i] += w * g


def balanced(units: DataFrame, ranks: int, weight: str, unit: str, out: str = "rank") -> DataFrame:
    """Longest processing time first: heaviest unit next, to the rank with the least load, ties to the lower rank.

    The rule is worked out for classes of units of one weight, of which the driver holds a count each: how many go to
    each rank. Which ones, Spark finds by place: units in order, and the loads at which ranks take them in order.
    """
    if ranks < 1:
        raise ValueError("one rank at least")
    spark = units.sparkSession
    u = units.select(F.col(unit), F.col(weight).cast("long").alias(weight))
    classes = [(r[0], r[1]) for r in u.groupBy(weight).agg(F.count("*")).orderBy(F.desc(weight)).collect()]
    plan = spark.createDataFrame(list(shares(classes, ranks)), "w long, rank int, load long, n long")
    step = F.greatest(F.col("w"), F.lit(0))
    turns = plan.select("w", "rank", "load", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")).select("w", "rank", (F.col("load") + F.col("k") * step).alias("at"))
    slots, _ = numbered(turns.select((-F.col("w")).alias("_w"), "at", F.col("rank").alias(out)), ["_w", "at", out])
    placed, _ = numbered(u.withColumn("_o", -F.col(weight)), ["_o", unit])
    return placed.join(slots.select("number", out), "number").select(unit, weight, out)


def packed_groups(groups: DataFrame, key: Sequence[str], order: str, size: str, capacity: int, out: str = "batch") -> DataFrame:
    """Greedy batches of whole groups in order: a group that would overfill a batch that holds something opens the next.

    Spark sorts the groups of each key; a task walks them and holds only the batch that is open.
    """
    rows = groups.select(*key, order, F.col(size).cast("long").alias(size))
    n = len(key)

    def walk(frames):
        now, batch, held = None, 0, 0
        for frame in frames:
            to = []
            for *k, _, units in frame.itertuples(index=False, name=None):
                if k != now:
                    now, batch, held = k, 0, 0
                if held > 0 and held + units > capacity:
                    batch, held = batch + 1, 0
                held += units
                to.append(batch)
            yield frame.assign(**{out: to})

    schema = rows.schema.add(out, "integer")
    return (rows.repartition(*key) if n else rows.repartition(1)).sortWithinPartitions(*key, order).mapInPandas(walk, schema)


def percentiles(rows: DataFrame, column: str, cuts: Sequence[float]) -> list[float | None]:
    """Exact percentiles, between the two nearest values by distance; null without a value.

    Values are counted before they are sorted by ranges, and only the partition with a cut is looked into.
    """
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    path = commits.scratch(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts.repartitionByRange(n, "v").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    kept = rows.sparkSession.read.parquet(path)
    sizes = sorted((r["_part"], r["c"]) for r in kept.groupBy("_part").agg(F.sum("c").alias("c")).collect())
    total = sum(c for _, c in sizes)
    if not total:
        return [None] * len(cuts)

    def at(rank: int) -> float:
        for part, c in sizes:
            if rank < c:
                upto = F.sum("c").over(Window.partitionBy("_part").orderBy("v"))
                return kept.where(F.col("_part") == part).withColumn("_upto", upto).where(F.col("_upto") > rank).agg(F.min("v")).first()[0]
            rank -= c
        raise IndexError(rank)

    out = []
    for cut in cuts:
        place = cut * (total - 1)
        below, above = at(math.floor(place)), at(math.ceil(place))
        out.append(float(below + (above - below) * (place - math.floor(place))))
    return out


def size_bins(rows: DataFrame, size: str, cuts: Sequence[float] = (0.33, 0.66), out: str = "bin") -> DataFrame:
    """Adds 0, 1, ... by percentiles of a size; values on a cut go down, and null ones to 0."""
    marks = percentiles(rows, size, cuts)
    return rows.withColumn(out, sum((F.when(F.col(size) > m, 1).otherwise(0) for m in marks if m is not None), F.lit(0)))


def stratified_sample(rows: DataFrame, n: int, size: str, unit: str, seed: int = 0) -> DataFrame:
    """n rows, evenly from three size bins, by a hash of seed and unit; what a bin lacks comes from the others.

    Of each bin a task keeps n rows at most before they are put together.
    """
    binned = size_bins(rows, size).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(unit))))
    ranked = binned.withColumn("_r", F.row_number().over(Window.partitionBy("bin").orderBy("_h", unit))).where(F.col("_r") <= n)
    return ranked.orderBy((F.col("_r") > n // 3), "_h", unit).limit(n).drop("_h", "_r", "bin")


def trial_plan(spark, models: Sequence[str] | DataFrame, gpus: Sequence[int], batches: Sequence[int], workers: Sequence[int], repeat: int) -> DataFrame:
    """Every combination in nested order, with one warm-up and then `repeat` measured runs each. models: names in order, or a table with the column model, which is then in order of names.

    Of a table only its distinct names are sorted, with their counts; combinations are made of them in order, after the sort.
    """
    if isinstance(models, DataFrame):
        out, axes = models.groupBy("model").agg(F.count("*").alias("_n")).orderBy("model"), []
    else:
        out, axes = spark.range(1).select(F.lit(1).cast("long").alias("_n")), [("model", models)]
    for name, values in [*axes, ("num_gpus", gpus), ("batch_size", batches), ("workers", workers)]:
        out = out.select("*", F.explode(F.array(*(F.lit(v) for v in values))).alias(name))
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeat))).alias("repeat_index"))
    # A name that stands in several rows has each combination as often.
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    kind = F.when(F.col("repeat_index") == 0, "warmup").otherwise("measured")
    return out.select("model", "num_gpus", "batch_size", "workers", kind.alias("kind"), "repeat_index")
