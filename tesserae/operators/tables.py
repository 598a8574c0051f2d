"""Operators on manifests, status tables and artifact tables: guards, resume, enrichment, upsert, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.expressions import artifact_label, has_tiles, positive_or_null


class TableError(ValueError):
    """A table breaks a rule of its schema."""


# Guards


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number; null equals null."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, keys: Sequence[str], what: str = "rows", named: int = 20) -> DataFrame:
    """The rows, if no key repeats; else an error that names the first of those that do."""
    bad = [tuple(r)[:-1] for r in duplicates(rows, keys).orderBy(*keys).limit(named).collect()]
    if bad:
        raise TableError(f"{what} repeat {', '.join(keys)}: {bad}")
    return rows


def require_all(rows: DataFrame, ok: Column, shown: Sequence[str], what: str, named: int = 20) -> DataFrame:
    """The rows, if all fulfil a condition (null does not); else an error that names the first that don't."""
    bad = [tuple(r) for r in rows.where(~F.coalesce(ok, F.lit(False))).select(*shown).orderBy(*shown).limit(named).collect()]
    if bad:
        raise TableError(f"{what}: {bad}")
    return rows


def require_images(images: DataFrame, raster: bool = True) -> DataFrame:
    """Image rows (sample_id, image_path, spacing_at_level_0), if there are any, their ids differ and their spacings make sense; rasters have none."""
    if images.isEmpty():
        raise TableError("no images")
    known = require_unique(images, ["sample_id"], "images")
    spacing = F.col("spacing_at_level_0")
    ok = spacing.isNull() if raster else spacing.isNull() | positive_or_null(spacing).isNotNull()
    return require_all(known, ok, ["sample_id"], "images whose spacing at level 0 can't be used")


def agreed(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys with the one value that their rows agree in (nulls have no say; null if there is none), and whether they agree."""
    low, high = F.min(value), F.max(value)
    same = F.coalesce(low == high, F.lit(True))
    return rows.groupBy(*keys).agg(F.when(same, low).alias(value), same.alias("agree"))


# Filters


def embeddable(status: DataFrame) -> DataFrame:
    """Status rows that were tiled, have tiles and know where their coordinates lie."""
    return status.where((F.col("tiling_status") == "success") & has_tiles("num_tiles") & F.col("coordinates_npz_path").isNotNull())


def split_by_tiles(rows: DataFrame, count: str = "num_tiles") -> tuple[DataFrame, DataFrame]:
    """Rows with and without tiles."""
    return rows.where(has_tiles(count)), rows.where(~has_tiles(count))


def missing_parts(manifest: DataFrame, bags: DataFrame, key: str) -> DataFrame:
    """Manifest rows whose bag is empty: they get a record without a payload."""
    return manifest.join(bags.select(key), key, "left_anti")


# Resume


def same_unit(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of keys."""
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def pending(units: DataFrame, done: DataFrame, keys: Sequence[str] = ("sample_id", "annotation"), resume: bool = True) -> DataFrame:
    """Units that are not done. Keys are compared null-safe; without resume, all units."""
    return units.join(done, same_unit(units, done, keys), "left_anti") if resume else units


def completed(status: DataFrame, payloads: DataFrame, required: Sequence[str], keys: Sequence[str] = ("sample_id", "annotation")) -> DataFrame:
    """Units whose status is success and that have a payload of each required kind. payloads: keys and kind."""
    have = payloads.where(F.col("kind").isin(*required)).groupBy(*keys).agg(F.count_distinct("kind").alias("kinds")).where(F.col("kinds") == len(set(required)))
    ok = status.where("feature_status = 'success'").withColumn("annotation", artifact_label("annotation")) if "annotation" in keys else status.where("feature_status = 'success'")
    return ok.join(have, same_unit(ok, have, keys), "left_semi").select(*keys)


def siblings(samples: DataFrame, units: DataFrame, done: Column, key: str = "sample_id", label: str = "annotation") -> DataFrame:
    """Samples with the number of their classes, and whether all of their units are done; a sample without units is not ready."""
    known = units.groupBy(key).agg(F.count_distinct(F.coalesce(label, F.lit(""))).alias("classes"), F.bool_and(F.coalesce(done, F.lit(False))).alias("ready"))
    return samples.join(known, key, "left").withColumn("classes", F.coalesce("classes", F.lit(0))).withColumn("ready", F.coalesce("ready", F.lit(False)))


def changed(specs: DataFrame, records: DataFrame, key: str, compatibility: str = "compatibility") -> DataFrame:
    """Specs to encode again: without a record, or whose compatibility map differs; `differs` names the keys, null without a record.

    Both tables have the key and the map under the same names.
    """
    from tesserae.functions.expressions import differing_keys

    old = records.select(F.col(key), F.col(compatibility).alias("_recorded"))
    both = specs.join(old, key, "left").withColumn("differs", F.when(F.col("_recorded").isNotNull(), differing_keys("_recorded", compatibility)))
    return both.where(F.col("differs").isNull() | (F.size("differs") > 0)).drop("_recorded")


# Enrichment and upsert


def last_by(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Of each key the row written last, in one aggregation; rows without an order come before all others."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(order)).alias("_row")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in columns))


def fill_nulls(status: DataFrame, found: DataFrame, columns: Sequence[str], order: str, sample: str = "sample_id", label: str = "annotation") -> DataFrame:
    """Fills null cells only: from the row found for (sample, class), else from the last one found for the sample."""
    pair = last_by(found, [sample, label], order, columns)
    one = last_by(found, [sample], order, columns)
    pair = pair.select(F.col(sample).alias("_s"), F.col(label).alias("_l"), *(F.col(c).alias(f"_p_{c}") for c in columns))
    one = one.select(F.col(sample).alias("_o"), *(F.col(c).alias(f"_o_{c}") for c in columns))
    out = status.join(pair, (status[sample] == F.col("_s")) & status[label].eqNullSafe(F.col("_l")), "left").join(one, F.col(sample) == F.col("_o"), "left")
    return out.select(*(F.coalesce(F.col(c), F.col(f"_p_{c}"), F.col(f"_o_{c}")).alias(c) if c in columns else F.col(c) for c in status.columns))


def upsert(status: DataFrame, updates: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("sample_id", "annotation"), missing: dict[str, str] | None = None) -> DataFrame:
    """Status rows with the columns of their update. Rows without one stay, or get the values of `missing`."""
    new = updates.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_n_{c}") for c in columns), F.lit(True).alias("_hit"))
    on = F.lit(True)
    for k in keys:
        on = on & status[k].eqNullSafe(F.col(f"_k_{k}"))
    out = status.join(new, on, "left")

    def value(c):
        if c not in columns:
            return F.col(c)
        other = F.lit(missing[c]) if missing and c in missing else F.col(c)
        return F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(other).alias(c)

    return out.select(*(value(c) for c in status.columns))


def restore_unchanged(current: DataFrame, previous: DataFrame, order: str, compare: Sequence[str], columns: Sequence[str], keys: Sequence[str] = ("sample_id", "annotation")) -> DataFrame:
    """Takes columns of the previous table where the compared columns are the same (null-safe); of several previous rows the last."""
    old = last_by(previous, keys, order, sorted({*compare, *columns}))
    old = old.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_p_{c}") for c in sorted({*compare, *columns})), F.lit(True).alias("_had"))
    on = F.lit(True)
    for k in keys:
        on = on & current[k].eqNullSafe(F.col(f"_k_{k}"))
    same = F.coalesce(F.col("_had"), F.lit(False))
    for c in compare:
        same = same & F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    out = current.join(old, on, "left")
    return out.select(*(F.when(same, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in current.columns))


# Alignment


def nth_occurrence(left: DataFrame, right: DataFrame, key: str, left_order: Sequence[str], right_order: Sequence[str], how: str = "left") -> DataFrame:
    """Joins the n-th row of a key on the left with the n-th row of it on the right."""
    number = lambda rows, order: rows.withColumn("occurrence", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return number(left, left_order).join(number(right, right_order), [key, "occurrence"], how)


def patients_of(slides: DataFrame, patients: DataFrame, key: str = "sample_id") -> DataFrame:
    """Adds patient_id to slides: the one of the map, else the slide's own id."""
    return slides.join(patients, key, "left").withColumn("patient_id", F.coalesce("patient_id", F.col(key).cast("string")))


def once_per(rows: DataFrame, keys: Sequence[str], plan) -> DataFrame:
    """Works something out once for each distinct key and gives it to all rows of the key (null-safe). plan: from a table of keys to one with more columns."""
    made = plan(rows.select(*keys).distinct())
    extra = [c for c in made.columns if c not in keys]
    made = made.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *extra)
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(made, on, "left").select(*rows.columns, *extra)


def run_lengths(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal values in order: key, run, value, first order value and length."""
    w = Window.partitionBy(*key).orderBy(*order)
    fresh = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull(), F.lit(True))
    marked = rows.withColumn("_new", fresh.cast("int")).withColumn("run", F.sum("_new").over(w))
    return marked.groupBy(*key, "run").agg(F.first(value).alias(value), F.min(order[0]).alias("first"), F.count("*").alias("length"))
