"""Progress events as lines of text, stage durations and batch timings. payload: a map from text to text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions.expressions import blank_to_null, col, subject

# The line of each kind of event; those on masks, on previews that start, on assignment and on resume are fixed values. {field} is a field of the payload; {subject}, {empty} and {skipped} are made from several.
LINES = {
    "run.started": "Starting run: {slide_count} slide(s), model={model_name} level={level} output={output_dir}",
    "tissue.started": "Resolving tissue masks ({total} total)...",
    "tissue.progress": "Tissue resolution: {completed}/{total} complete, {failed} failed{empty}",
    "tissue.finished": "Tissue resolution finished: {completed}/{total} complete, {failed} failed{empty}",
    "tiling.started": "Tiling slides ({slide_count} total)...",
    "tiling.progress": "Tiles cut for {completed} of {total} slides ({failed} failed)",
    "tiling.finished": "Tiling finished: {completed}/{total} complete, {failed} failed, {discovered_tiles} tiles{empty}",
    "tiling.summary": "In all {discovered_tiles} tiles from {completed} of {total} slides ({failed} failed)",
    "preview.started": "Generating previews ({total} total)...",
    "preview.progress": "Previews drawn: {completed} of {total} ({failed} failed)",
    "preview.finished": "All previews done: {completed} of {total} drawn, {failed} failed",
    "model.loading": "Encoder {model_name} is being loaded",
    "model.ready": "Encoder {model_name} is on {device}",
    "embedding.started": "Embedding slides ({slide_count} total)...",
    "embedding.resume": "Resume: skipped {skipped_slide_count} already processed slide(s); {pending_slide_count} pending",
    "embedding.assignment.started": "Assigning slides across {num_gpus} GPU(s)...",
    "embedding.assignment.finished": "Slide assignment complete: {slide_count} slide(s) across {num_gpus} GPU(s)",
    "embedding.slide.started": "{subject}: {total_tiles} tiles to encode",
    "embedding.tile.progress": "Embedding {subject}: {processed}/{total} {unit}s",
    "aggregation.started": "{subject}: pooling its tiles",
    "embedding.slide.finished": "{subject}: {num_tiles} tiles encoded",
    "embedding.finished": "Encoded {slides_completed} of {slide_count} slides; stored {tile_artifacts} of tiles and {slide_artifacts} of slides{skipped}",
    "run.finished": "Done. Logs are in {logs_dir}",
    "run.failed": "Stopped at {stage} by {error}",
}
#: Kinds of which a line that repeats the one before is not shown again within a second.
THROTTLED = ("tiling.progress", "preview.progress", "embedding.tile.progress")


def value(payload: Column | str, name: str) -> Column:
    return F.element_at(col(payload), name)


def empty_masks(payload: Column | str) -> Column:
    """`, empty_masks=N` where N is a whole number over zero."""
    n = value(payload, "empty_masks").try_cast("int")
    return F.when(n > 0, F.concat(F.lit(", empty_masks="), n.cast("string"))).otherwise("")


def line(kind: Column | str, payload: Column | str, lines: dict[str, str] = LINES) -> Column:
    """Text of an event; null for kinds without one, `?` for fields that the payload lacks."""
    special = {
        "subject": subject(value(payload, "progress_label"), value(payload, "sample_id")),
        "empty": empty_masks(payload),
        "skipped": F.coalesce(F.concat(F.lit(", "), value(payload, "slides_skipped"), F.lit(" skipped")), F.lit("")),
    }

    def text(template: str) -> Column:
        parts = re.split(r"\{(\w+)\}", template)
        made = (F.lit(p) if i % 2 == 0 else special.get(p, F.coalesce(value(payload, p), F.lit("?"))) for i, p in enumerate(parts))
        return F.concat(*made)

    out = F.lit(None).cast("string")
    for k, template in reversed(lines.items()):
        out = F.when(col(kind) == k, text(template)).otherwise(out)
    return out


def task_key(base: Column | str, payload: Column | str) -> Column:
    """Key of a row on a task board: the task, with its label where there is one."""
    return F.concat_ws(":", col(base), blank_to_null(value(payload, "progress_label")))


def summary_rows(events: DataFrame, payload: str = "payload") -> DataFrame:
    """label and value of the rows of a summary, in order; failed is not below zero, skipped only where it is known."""
    n, done = (F.coalesce(value(payload, f).try_cast("int"), F.lit(0)) for f in ("slide_count", "slides_completed"))
    skipped = value(payload, "slides_skipped")
    row = lambda label, v: F.struct(F.lit(label).alias("label"), v.cast("string").alias("value"))
    rows = F.array(row("Slides w/ tiles", n), row("Completed", done), F.when(skipped.isNotNull(), row("Skipped", skipped)), row("Failed", F.greatest(F.lit(0), n - done)))
    return events.select(*(c for c in events.columns if c != payload), F.posexplode(F.filter(rows, lambda r: r.isNotNull())).alias("place", "_r")).select("*", "_r.label", "_r.value").drop("_r")


def stage_durations(events: DataFrame, key: str, kind: str, time: str, stages: dict[str, tuple[str, str]], digits: int = 4) -> DataFrame:
    """Seconds from the first event of one kind to the first of another, a column for each stage; null without either.

    One aggregation by key: the number of stages is fixed, so nothing is pivoted by data.
    """
    t = F.unix_micros(F.col(time).cast("timestamp"))
    first = lambda k: F.min(F.when(F.col(kind) == k, t))
    return events.groupBy(key).agg(*(F.round((first(b) - first(a)) / 1e6, digits).alias(name) for name, (a, b) in stages.items()))


def paired_seconds(events: DataFrame, key: list[str], kind: str, time: str, order: list[str], start: str, end: str, out: str = "seconds", digits: int = 4) -> DataFrame:
    """Sum over all ends of the seconds since the last start before them that no end has used; never below zero for each."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    marks = events.where(F.col(kind).isin(start, end))
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.when(F.lag(kind).over(w) == start, F.lag(t).over(w))
    spans = marks.withColumn("_s", F.when((F.col(kind) == end) & before.isNotNull(), F.greatest(F.lit(0), t - before)))
    return spans.groupBy(*key).agg(F.round(F.sum("_s") / 1e6, digits).alias(out))


#: Timings that events of a batch carry, in milliseconds.
TIMINGS = ("loader_wait", "ready_wait", "preprocess", "worker_batch", "reader_open", "reader_read", "forward")


def batch_timings(batches: DataFrame, keys: list[str] = (), payload: str | None = "payload") -> DataFrame:
    """Number, means, maximum wait, seconds and fractions of batches. A timing that is missing counts as zero; without batches all is zero."""
    get = lambda n: F.coalesce((value(payload, n) if payload else F.col(n)).try_cast("double"), F.lit(0.0))
    plain = batches.select(*keys, *(get(f"{n}_ms").alias(n) for n in TIMINGS), get("gpu_busy_fraction").alias("busy"))
    sums = plain.groupBy(*keys).agg(F.count("*").alias("n"), F.max("loader_wait").alias("top"), F.avg("busy").alias("busy"), *(F.sum(n).alias(n) for n in TIMINGS))
    wait = F.col("loader_wait") + F.col("ready_wait")
    data, forward = wait + F.col("preprocess"), F.col("forward")
    all_ms = data + forward
    part = lambda c: F.when(all_ms > 0, F.round(c / all_ms, 4)).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sums.select(
        *keys, F.col("n").alias("timed_batches"), zero(F.round("top", 4)).alias("max_loader_wait_ms"), *(zero(F.round(F.try_divide(n, "n"), 4)).alias(f"mean_{n}_ms") for n in TIMINGS),
        zero(F.round(data / 1000, 4)).alias("data_pipeline_seconds"), zero(F.round(forward / 1000, 4)).alias("forward_seconds"), zero(F.round(all_ms / 1000, 4)).alias("accounted_embedding_seconds"),
        part(data).alias("data_pipeline_fraction"), part(forward).alias("forward_fraction"), part(wait).alias("loader_wait_fraction"), zero(F.round("busy", 4)).alias("gpu_busy_fraction"),
    )
