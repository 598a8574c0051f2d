"""Aggregations: bags to vectors, snapshots, stage durations, trial roll-ups, best configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.expressions import rounded


def pool_mean(bags: DataFrame, keys: Sequence[str], vector: str, out: str = "pooled", digits: int | None = None) -> DataFrame:
    """Element-wise mean of vectors by keys, as one array in element order.

    Two aggregations, both with map-side partial sums: by (keys, position), then the positions of a key
    are folded back to an array. Null vectors take no part.
    """
    long = bags.select(*keys, F.posexplode(vector).alias("pos", "x"))
    mean = F.avg(F.col("x").cast("double"))
    cells = long.groupBy(*keys, "pos").agg((rounded(mean, digits) if digits is not None else mean).alias("m"))
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias(out))


def in_order(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Columns of each key as arrays in order: a bag restored from shards."""
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *columns)))
    column = lambda c: F.transform("_rows", lambda s: s[c]).alias(c)
    return rows.groupBy(*keys).agg(sorted_rows.alias("_rows")).select(*keys, *map(column, columns))


def nested(rows: DataFrame, key: str, label: str, value: str, out: str = "bags") -> DataFrame:
    """Map from label to value for each key, labels in order; rows without a label are left out."""
    entry = F.struct(F.col(label).alias("key"), F.col(value).alias("value"))
    return rows.where(F.col(label).isNotNull()).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(out))


def snapshot(rows: DataFrame, completed: Column, failed: Column, tiles: Column) -> DataFrame:
    """One row: total, completed, failed, pending (not below zero) and tiles found."""
    done, bad = F.count_if(completed), F.count_if(failed)
    return rows.agg(F.count("*").alias("total"), done.alias("completed"), bad.alias("failed"), F.greatest(F.lit(0), F.count("*") - done - bad).alias("pending"), F.coalesce(F.sum(tiles), F.lit(0)).cast("long").alias("discovered_tiles"))


def stage_seconds(events: DataFrame, key: str, time: str, start: Column, end: Column, out: str = "seconds") -> DataFrame:
    """Seconds from the first start to the last end of each key; keys without either are left out."""
    t = F.col(time).cast("timestamp")
    span = events.groupBy(key).agg(F.min(F.when(start, t)).alias("a"), F.max(F.when(end, t)).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return span.select(key, F.round((F.unix_micros("b") - F.unix_micros("a")) / 1e6, 3).alias(out))


def spread(rate: str, digits: int = 4) -> tuple[Column, Column, Column]:
    """Mean, population deviation and maximum of a rate."""
    return F.round(F.avg(rate), digits), F.round(F.stddev_pop(rate), digits), F.max(rate)


def first_seen(rows: DataFrame, key: str, label: str, order: str, out: str = "place") -> DataFrame:
    """Labels of each key, numbered from 1 by their first row in order, then by label; null is a label.

    Rows are reduced to one for each label before they are numbered.
    """
    seen = rows.groupBy(key, label).agg(F.min(order).alias("_o"))
    return seen.select(key, label, F.row_number().over(Window.partitionBy(key).orderBy("_o", label)).alias(out))


def trials(rows: DataFrame, keys: Sequence[str], rate: str, *optional: str) -> DataFrame:
    """Mean, population deviation and maximum of a rate; means of optional columns over the rows that have them."""
    extra = [F.round(F.avg(c), 6).alias(f"mean_{c}") for c in optional]
    mean, deviation, most = spread(rate)
    return rows.groupBy(*keys).agg(F.count("*").alias("trials"), mean.alias(f"mean_{rate}"), deviation.alias(f"std_{rate}"), most.alias(f"max_{rate}"), *extra)


def best(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The row of each key with the largest tuple of expressions, in one aggregation without a sort."""
    top = F.max_by(F.struct(*columns), F.struct(*(F.expr(b).alias(f"b{i}") for i, b in enumerate(by))))
    return rows.groupBy(*keys).agg(top.alias("_best")).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in columns))


def against_baseline(rows: DataFrame, mode: str, baseline: str, keys: Sequence[str], rate: str, out: str) -> DataFrame:
    """Ratio of each row's rate to the baseline mode's at the same keys; null without one over zero."""
    base = rows.where(F.col(mode) == baseline).groupBy(*keys).agg(F.first(rate).alias("_base"))
    joined = rows.join(base, list(keys), "left") if keys else rows.crossJoin(F.broadcast(base))
    return joined.withColumn(out, F.when(F.col("_base") > 0, F.col(rate) / F.col("_base"))).drop("_base")


def per_second(n: Column, seconds: Column) -> Column:
    """Rate, zero where no time was taken."""
    return F.when(seconds > 0, n / seconds).otherwise(F.lit(0.0))
