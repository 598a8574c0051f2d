"""Queries on progress events, timings and trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import expressions as X
from tesserae.operators import aggregate
from tesserae.plans import settings
from tesserae.plans.catalogue import query, table
from tesserae.sources import commits
from tesserae.streaming import events, lines, logs, monitor


@query("""
    SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Embedding ' || coalesce('gpu' || nullif(o_custkey % 3, 0) || ': ', '') || o_orderkey || ': ' || o_custkey || '/' || CAST(floor(o_totalprice) AS BIGINT) || ' tiles'
      WHEN 'O' THEN 'Tissue resolution: ' || o_custkey || '/? complete, 0 failed' || CASE WHEN o_custkey % 3 > 0 THEN ', empty_masks=' || o_custkey % 3 ELSE '' END END AS line FROM orders""")
def event_lines(spark, sf_dir):
    text = lambda c: F.expr(c).cast("string")
    o = table(spark, sf_dir, "orders").where("true")
    label = F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("gpu"), text("o_custkey % 3")))
    payload = F.create_map(
        F.lit("sample_id"), text("o_orderkey"), F.lit("progress_label"), label, F.lit("processed"), text("o_custkey"), F.lit("unit"), F.lit("tile"),
        F.lit("completed"), text("o_custkey"), F.lit("failed"), F.lit("0"), F.lit("empty_masks"), text("o_custkey % 3"),
    )
    payload = F.when(F.col("o_orderstatus") == "F", F.map_concat(payload, F.create_map(F.lit("total"), text("CAST(floor(o_totalprice) AS BIGINT)")))).otherwise(payload)
    kind = F.when(F.col("o_orderstatus") == "F", "embedding.tile.progress").when(F.col("o_orderstatus") == "O", "tissue.progress").otherwise("no.such.kind")
    return o.select("o_orderkey", kind.alias("kind"), payload.alias("payload")).select("o_orderkey", lines.line("kind", "payload").alias("line"))


@query("""
    SELECT user_id, round((epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'view'))) / 1e6, 3) AS tiling,
      round((epoch_us(min(ts) FILTER (event_type = 'error')) - epoch_us(min(ts) FILTER (event_type = 'click'))) / 1e6, 3) AS embedding FROM events GROUP BY 1""")
def stage_durations(spark, sf_dir):
    return lines.stage_durations(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", {"tiling": ("view", "purchase"), "embedding": ("click", "error")}, 3)


@query("""
    WITH m AS (SELECT user_id, event_type, ts, lag(event_type) OVER w AS k, lag(ts) OVER w AS t FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' AND k = 'view' THEN greatest(0, epoch_us(ts) - epoch_us(t)) END) / 1e6, 3) AS seconds FROM m GROUP BY 1""")
def aggregation_seconds(spark, sf_dir):
    return lines.paired_seconds(table(spark, sf_dir, "events"), ["user_id"], "event_type", "ts", ["ts", "event_id"], "view", "purchase", digits=3)


@query("""
    SELECT l_returnflag, l_linestatus, count(*) AS timed_batches, round(max(l_quantity), 4) AS max_loader_wait_ms, round(avg(l_quantity), 4) AS mean_loader_wait_ms, round(avg(l_extendedprice), 4) AS mean_forward_ms, 0.0::DOUBLE AS mean_reader_open_ms,
      round(sum(l_quantity + l_linenumber + l_suppkey) / 1000, 4) AS data_pipeline_seconds, round(sum(l_extendedprice) / sum(l_quantity + l_linenumber + l_suppkey + l_extendedprice), 4) AS forward_fraction,
      round(sum(l_quantity + l_linenumber) / sum(l_quantity + l_linenumber + l_suppkey + l_extendedprice), 4) AS loader_wait_fraction, round(avg(l_discount), 4) AS gpu_busy_fraction FROM lineitem GROUP BY 1, 2""")
def batch_fractions(spark, sf_dir):
    zero = F.lit(None).cast("double")
    t = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").alias("loader_wait_ms"), F.col("l_linenumber").cast("double").alias("ready_wait_ms"), F.col("l_suppkey").cast("double").alias("preprocess_ms"),
        F.col("l_extendedprice").alias("forward_ms"), zero.alias("worker_batch_ms"), zero.alias("reader_open_ms"), zero.alias("reader_read_ms"), F.col("l_discount").alias("gpu_busy_fraction"),
    )
    out = lines.batch_timings(t, ["l_returnflag", "l_linestatus"], None)
    return out.select(
        "l_returnflag", "l_linestatus", "timed_batches", "max_loader_wait_ms", "mean_loader_wait_ms", "mean_forward_ms", "mean_reader_open_ms",
        "data_pipeline_seconds", "forward_fraction", "loader_wait_fraction", "gpu_busy_fraction",
    )


@query("""
    WITH RECURSIVE l AS (SELECT user_id AS key, event_type AS line, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS r FROM events),
    f AS (SELECT key, line, ts, r, ts AS shown, true AS new FROM l WHERE r = 1
      UNION ALL SELECT l.key, l.line, l.ts, l.r, CASE WHEN l.line = f.line AND epoch_us(l.ts) - epoch_us(f.shown) < 36000000000 THEN f.shown ELSE l.ts END, NOT (l.line = f.line AND epoch_us(l.ts) - epoch_us(f.shown) < 36000000000) FROM f JOIN l ON l.key = f.key AND l.r = f.r + 1)
    SELECT key, line, ts FROM f WHERE new""")
def throttled_lines(spark, sf_dir):
    return events.throttled(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("line"), "ts"), 36000)


@query("""
    SELECT user_id, unnest(['Slides w/ tiles', 'Completed', 'Skipped', 'Failed']) AS label, unnest([CAST(n AS VARCHAR), CAST(d AS VARCHAR), CAST(s AS VARCHAR), CAST(greatest(0, n - d) AS VARCHAR)]) AS value
    FROM (SELECT user_id, count(*) AS n, count_if(event_type = 'view') AS d, count_if(event_type = 'error') AS s FROM events GROUP BY 1)""")
def summary_rows(spark, sf_dir):
    text = lambda c: c.cast("string")
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.create_map(
            F.lit("slide_count"), text(F.count("*")), F.lit("slides_completed"), text(F.count_if(F.col("event_type") == "view")), F.lit("slides_skipped"), text(F.count_if(F.col("event_type") == "error")),
        ).alias("payload")
    )
    return lines.summary_rows(e).drop("place")


@query("SELECT event_id, event_type || coalesce(':' || nullif(json_extract_string(props, '$.k'), '0'), '') AS task FROM events")
def task_keys(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", lines.task_key("event_type", F.create_map(F.lit("progress_label"), F.nullif(F.get_json_object("props", "$.k"), F.lit("0")))).alias("task"))


@query("""
    SELECT l_returnflag AS gpu, l_linenumber AS size, l_orderkey AS model, l_extendedprice AS tps FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_extendedprice DESC, l_quantity, l_orderkey DESC) AS r FROM lineitem) WHERE r = 1""")
def best_by_size(spark, sf_dir):
    out = aggregate.best(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], ["l_orderkey", "l_extendedprice"], ["l_extendedprice", "-l_quantity", "l_orderkey"])
    return out.select(F.col("l_returnflag").alias("gpu"), F.col("l_linenumber").alias("size"), F.col("l_orderkey").alias("model"), F.col("l_extendedprice").alias("tps"))


@query("""
    WITH t AS (SELECT o_orderstatus AS mode, avg(o_totalprice) AS sec FROM orders GROUP BY 1)
    SELECT mode, round(sec, 4) AS sec, CASE WHEN b > 0 THEN round(sec / b, 6) END AS ratio FROM t, (SELECT max(sec) AS b FROM t WHERE mode = 'F')""")
def end_to_end_ratio(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("mode")).agg(F.avg("o_totalprice").alias("sec"))
    return aggregate.against_baseline(t, "mode", "F", [], "sec", "ratio").select("mode", F.round("sec", 4).alias("sec"), F.round("ratio", 6).alias("ratio"))


@query("SELECT o_orderkey, round(CASE WHEN o_custkey % 5 > 0 THEN o_totalprice / (o_custkey % 5) ELSE 0 END, 6) AS per_second, strftime(o_orderdate, '%Y-%m-%d_%H_%M') AS run_id FROM orders")
def trial_rates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(aggregate.per_second(F.col("o_totalprice"), F.col("o_custkey") % 5), 6).alias("per_second"), settings.run_id_of("o_orderdate").alias("run_id"))


@query("SELECT p_partkey, least(32, coalesce(nullif(CASE WHEN p_partkey % 3 > 0 THEN p_size % 8 END, 0), 64)) AS workers, CASE p_size % 4 WHEN 0 THEN 'fp16' WHEN 1 THEN 'fp32' WHEN 2 THEN 'fp16' ELSE 'fp32' END AS stored FROM part")
def worker_settings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = F.when(F.col("p_partkey") % 3 > 0, F.concat((F.col("p_size") % 8).cast("string"), F.lit("(x2)")))
    kind = F.col("p_size") % 4
    stored = X.output_precision(F.when(kind == 0, " Half ").when(kind == 1, "float32"), F.when(kind == 2, "float16").otherwise("bf16"))
    return p.select("p_partkey", settings.cpu_limit(F.lit(32), asked).alias("workers"), stored.alias("stored"))


def micros():
    """Of events, whose time has no zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")


@query("""
    SELECT event_type AS kind, CASE WHEN event_id % 2 = 1 THEN 'second' END AS label, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, max(epoch_us(ts)) AS latest FROM events GROUP BY ALL""")
def event_log_tail(spark, sf_dir):
    """Events written to a log of files by rank, by two writers whose files grow in number with the table, and followed as a stream; the line that a third is still writing waits."""
    folder = commits.scratch(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    e = table(spark, sf_dir, "events")
    made = e.select("event_id", F.col("event_type").alias("kind"), F.create_map(F.lit("id"), F.col("event_id").cast("string"), F.lit("us"), micros().cast("string")).alias("payload"), (micros() / 1e6).alias("timestamp"))
    logs.write(made.where("event_id % 2 = 0").repartition("event_id"), f"{folder}/run.jsonl")
    logs.write(made.where("event_id % 2 = 1").repartition("event_id"), f"{folder}/run.jsonl", "second")
    where, name = logs.system(f"{folder}/run.rank-third.jsonl")  # no number, which a file of the others may have
    with where.open_output_stream(name) as out:
        out.write(b'{"kind": "click", "payl')
    p = F.col("payload")
    seen = events.drain(logs.follow(spark, f"{folder}/run.jsonl"), mode="append")
    return seen.groupBy("kind", p["progress_label"].alias("label")).agg(F.count("*").alias("n"), F.sum(p["id"].cast("long")).alias("ids"), F.max(p["us"].cast("long")).alias("latest"))


@query("""
    WITH e AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, event_id, CAST(event_type = 'purchase' AS INTEGER) AS c, CAST(event_type = 'error' AS INTEGER) AS f, CASE WHEN event_type = 'view' THEN event_id % 3 ELSE 0 END AS t FROM events),
    s AS (SELECT key, ts, event_id, CAST(sum(c) OVER w AS BIGINT) AS completed, CAST(sum(f) OVER w AS BIGINT) AS failed, CAST(sum(t) OVER w AS BIGINT) AS discovered_tiles FROM e WINDOW w AS (PARTITION BY key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
    l AS (SELECT *, lag((completed, failed, discovered_tiles), 1, (CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT))) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM s)
    SELECT key, epoch_us(ts) AS us, CAST(100 AS BIGINT) AS total, completed, failed, CAST(greatest(0, 100 - completed - failed) AS BIGINT) AS pending, discovered_tiles
    FROM l WHERE before <> (completed, failed, discovered_tiles) AND epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events) - 86400000""")
def progress_snapshots(spark, sf_dir):
    """Events of users as steps of their runs: a snapshot for each change, up to a day before the last event."""
    e = events.read(spark, sf_dir)
    kind = F.col("event_type")
    steps = e.select(F.col("user_id").alias("key"), F.timestamp_micros(micros()).alias("ts"), F.col("event_id").alias("id"), (kind == "purchase").cast("int").alias("completed"), (kind == "error").cast("int").alias("failed"), F.when(kind == "view", F.col("event_id") % 3).otherwise(0).alias("tiles"))
    return events.drain(monitor.snapshots(steps, 100, "1 day"), mode="append").select("key", F.unix_micros("ts").alias("us"), "total", "completed", "failed", "pending", "discovered_tiles")
