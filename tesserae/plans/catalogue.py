"""Registered queries over the test tables, each with the SQL that must give the same rows.

Samples are orders (patients: customers), tiles are lineitem rows, classes and states its flags, bags the
embeddings by label, progress events the events table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions import expressions as X
from tesserae.functions import records
from tesserae.operators import aggregate, partitioning, spatial, tables, tiling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Order that is total within an order's lineitems.
TILE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same rows where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each_label(rows, write) -> None:
    """Writes a file for each label. By number of partitions, since Spark would put small rows, and so all files, into one task."""
    ways = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(ways, "label").groupBy("label").applyInPandas(write, "label int").count()


def numbered(rows: DataFrame, n: str, name: str, block: int = 1024) -> DataFrame:
    """A row for each number (name) from 0 to n - 1 in place of one with their count n; none where n is null or under 1.

    Numbers are made in blocks, which are dealt by number of partitions: Spark would make all numbers of few rows in one task.
    """
    ways, others = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [c for c in rows.columns if c != n]
    blocks = rows.where(F.col(n) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(block).cast("long"))).alias("_first"))
    return blocks.repartition(ways, *others, "_first").select(*others, F.explode(F.sequence("_first", F.least(F.col("_first") + (block - 1), F.col(n).cast("long") - 1))).alias(name))


def tiles(spark, sf_dir) -> DataFrame:
    """sample, tile_index, x, y, label, status of every tile."""
    w = Window.partitionBy("l_orderkey").orderBy(*TILE_ORDER)
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("sample"), (F.row_number().over(w) - 1).alias("tile_index"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), F.col("l_returnflag").alias("label"), F.col("l_linestatus").alias("status"))


TILES_SQL = "tiles AS (SELECT l_orderkey AS sample, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS tile_index, l_partkey AS x, l_suppkey AS y, l_returnflag AS label, l_linestatus AS status FROM lineitem)"


# Aggregation of vectors


@query("""
    WITH cells AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    means AS (SELECT label, pos, round(avg(CAST(x AS DOUBLE)), 6) AS m FROM cells GROUP BY label, pos)
    SELECT label, list(m ORDER BY pos) AS pooled FROM means GROUP BY label""")
def pool_tiles_to_slides(spark, sf_dir):
    return aggregate.pool_mean(table(spark, sf_dir, "embeddings"), ["label"], "embedding", digits=6)


@query("""
    SELECT CAST(coalesce(c.c_custkey, -o.o_orderkey) AS VARCHAR) AS patient_id, count(*) AS n_slides, round(avg(o_totalprice), 6) AS mean_value, min(o_orderkey) AS first_slide
    FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 GROUP BY 1""")
def pool_slides_to_patients(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").cast("string").alias("patient_id"))
    o = table(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("sample_id"), "o_orderkey", "o_custkey", F.array(F.col("o_totalprice").cast("double")).alias("vector"))
    both = tables.patients_of(o, o.join(known, "o_custkey").select("sample_id", "patient_id"))
    pooled = aggregate.pool_mean(both, ["patient_id"], "vector", digits=6)
    counts = both.groupBy("patient_id").agg(F.count("*").alias("n_slides"), F.min("o_orderkey").alias("first_slide"))
    return counts.join(pooled, "patient_id").select("patient_id", "n_slides", F.col("pooled")[0].alias("mean_value"), "first_slide")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS sample, list(l_returnflag ORDER BY l_returnflag) AS labels, list(n ORDER BY l_returnflag) AS sizes FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def nested_bags(spark, sf_dir):
    bags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("n"))
    return aggregate.nested(bags, "l_orderkey", "l_returnflag", "n").select(F.col("l_orderkey").cast("string").alias("sample"), F.map_keys("bags").alias("labels"), F.map_values("bags").alias("sizes"))


# Tables: guards, resume, upsert


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def manifest_duplicates(spark, sf_dir):
    return tables.duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey AS sample, count(l_orderkey) AS num_tiles, count(l_orderkey) > 0 AS embeddable FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def zero_tile_split(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample")).join(n, "sample", "left").select("sample", F.coalesce("n", F.lit(0)).alias("num_tiles"))
    return o.withColumn("embeddable", X.has_tiles("num_tiles"))


@query("SELECT o_orderkey AS sample FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def zero_tile_records(spark, sf_dir):
    manifest = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"))
    return tables.missing_parts(manifest, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample")), "sample")


@query("SELECT DISTINCT l_orderkey AS sample, nullif(l_returnflag, 'N') AS label FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag AND b.l_linestatus = 'F')")
def resume_pending(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample"), F.nullif("l_returnflag", F.lit("N")).alias("label"), "l_linestatus")
    return tables.pending(t.select("sample", "label").distinct(), t.where("l_linestatus = 'F'").select("sample", "label").distinct(), ["sample", "label"])


@query("""
    SELECT o_orderkey AS sample, o_orderpriority AS annotation, CASE WHEN n IS NULL THEN 'error' ELSE 'success' END AS feature_status, n AS num_tiles
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def status_upsert(spark, sf_dir):
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_orderpriority").alias("annotation"), F.lit("tbp").alias("feature_status"), F.lit(None).cast("long").alias("num_tiles"))
    made = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(F.count("*").alias("num_tiles")).withColumn("feature_status", F.lit("success"))
    return tables.upsert(status, made, ["feature_status", "num_tiles"], ["sample"], missing={"feature_status": "error"})


@query("""
    SELECT o_orderkey AS sample_id, o_orderstatus AS annotation, coalesce(
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'kept' END,
      (SELECT CAST(max_by(l_partkey, l_extendedprice * 1000000 + l_partkey) AS VARCHAR) FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = o_orderstatus),
      (SELECT CAST(max_by(l_partkey, l_extendedprice * 1000000 + l_partkey) AS VARCHAR) FROM lineitem WHERE l_orderkey = o_orderkey)) AS preview
    FROM orders""")
def preview_null_fill(spark, sf_dir):
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("annotation"), F.when(F.col("o_orderpriority") == "1-URGENT", "kept").alias("preview"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linestatus").alias("annotation"), F.col("l_partkey").cast("string").alias("preview"), (F.col("l_extendedprice") * 1000000 + F.col("l_partkey")).alias("ord"))
    return tables.fill_nulls(status, found, ["preview"], "ord")


@query("""
    WITH a AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS n FROM conversations)
    SELECT q.conv_id, q.n AS occurrence, q.turn AS asked, r.turn AS answered FROM a q LEFT JOIN a r ON q.conv_id = r.conv_id AND q.n = r.n AND r.role = 'assistant' WHERE q.role = 'user'""")
def nth_occurrence_align(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    left = c.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"), F.col("text").alias("t"))
    right = c.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answered"), F.col("text").alias("u"))
    return tables.nth_occurrence(left, right, "conv_id", ["asked", "t"], ["answered", "u"]).select("conv_id", "occurrence", "asked", "answered")


@query("""
    WITH m AS (SELECT conv_id, turn, role, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)),
    r AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS run FROM m)
    SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, min(turn) AS first, count(*) AS length FROM r GROUP BY conv_id, run""")
def run_length_groups(spark, sf_dir):
    return tables.run_lengths(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "text"], "role")


@query("SELECT doc_id, lang, source, CASE lang WHEN 'en' THEN NULL WHEN 'fr' THEN NULL ELSE lang END AS artifact, nullif(lang, 'fr') AS structural FROM documents")
def annotation_normalize(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.expr("CASE lang WHEN 'en' THEN 'tissue' WHEN 'fr' THEN 'merged' ELSE lang END").alias("a"))
    back = F.when(X.structural_label("a") == "tissue", F.lit("en")).otherwise(X.structural_label("a"))
    return d.select("doc_id", "lang", "source", X.artifact_label("a").alias("artifact"), back.alias("structural"))


@query("SELECT DISTINCT o.o_orderkey AS sample, o.o_custkey AS patient, c.c_mktsegment AS segment FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey")
def plan_once_per_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("patient"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient"), F.col("c_mktsegment").alias("segment"))
    return tables.once_per(o, ["patient"], lambda keys: keys.join(c, "patient"))


# Snapshots, stages, timings, trials


@query("""
    SELECT count(*) AS total, count_if(l_linestatus = 'F') AS completed, count_if(l_returnflag = 'R') AS failed,
      greatest(0, count(*) - count_if(l_linestatus = 'F') - count_if(l_returnflag = 'R')) AS pending, CAST(sum(l_quantity) AS BIGINT) AS discovered_tiles FROM lineitem""")
def progress_snapshot(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return aggregate.snapshot(t, F.col("l_linestatus") == "F", F.col("l_returnflag") == "R", F.col("l_quantity"))


@query("""
    WITH s AS (SELECT user_id, min(ts) AS t0 FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY 1),
    e AS (SELECT user_id, max(ts) AS t1 FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY 1)
    SELECT user_id, round((epoch_us(t1) - epoch_us(t0)) / 1e6, 3) AS seconds FROM s JOIN e USING (user_id)""")
def stage_seconds(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ends = ev.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    return aggregate.stage_seconds(ev.crossJoin(F.broadcast(ends)), "user_id", "ts", F.col("event_type") == F.col("a"), F.col("event_type") == F.col("b"))


@query("""
    SELECT event_type AS kind, count(*) AS batches, round(avg(value), 6) AS mean_ms, round(max(value), 6) AS max_ms, round(stddev_pop(value), 6) AS std_ms,
      CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS items FROM events GROUP BY 1""")
def batch_timing(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    mean, deviation, most = aggregate.spread("value", 6)
    return ev.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("batches"), mean.alias("mean_ms"), F.round(most, 6).alias("max_ms"), deviation.alias("std_ms"), F.sum("k").alias("items"))


@query("""
    SELECT l_returnflag AS mode, l_linenumber AS batch_size, count(*) AS trials, round(avg(l_extendedprice), 4) AS mean_tps, round(stddev_pop(l_extendedprice), 4) AS std_tps, max(l_extendedprice) AS max_tps,
      round(avg(CASE WHEN l_discount > 0 THEN l_discount END), 6) AS mean_wait FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2""")
def trial_rollup(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'")
    return aggregate.trials(t.select(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("batch_size"), F.col("l_extendedprice").alias("tps"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("wait")), ["mode", "batch_size"], "tps", "wait")


@query("""
    SELECT l_returnflag, l_linestatus, l_orderkey, l_extendedprice, l_quantity, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus
      ORDER BY l_extendedprice DESC, l_quantity, l_linenumber, l_orderkey) AS r FROM lineitem) WHERE r = 1""")
def best_config(spark, sf_dir):
    return aggregate.best(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_orderkey", "l_extendedprice", "l_quantity", "l_linenumber"], ["l_extendedprice", "-l_quantity", "-l_linenumber", "-l_orderkey"])


@query("""
    WITH t AS (SELECT l_returnflag AS mode, l_linenumber AS batch_size, avg(l_extendedprice) AS tps FROM lineitem GROUP BY 1, 2)
    SELECT t.mode, t.batch_size, round(t.tps, 4) AS tps, CASE WHEN b.tps > 0 THEN round(t.tps / b.tps, 6) END AS speedup FROM t LEFT JOIN t b ON b.batch_size = t.batch_size AND b.mode = 'A'""")
def baseline_speedup(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("batch_size")).agg(F.avg("l_extendedprice").alias("tps"))
    return aggregate.against_baseline(t, "mode", "A", ["batch_size"], "tps", "speedup").select("mode", "batch_size", F.round("tps", 4).alias("tps"), F.round("speedup", 6).alias("speedup"))


# Work assignment


@query("""
    WITH c AS (SELECT quantile_cont(n_chars, 0.33) AS a, quantile_cont(n_chars, 0.66) AS b FROM documents)
    SELECT CASE WHEN n_chars > b THEN 2 WHEN n_chars > a THEN 1 ELSE 0 END AS bin, count(*) AS n, min(n_chars) AS low, max(n_chars) AS high FROM documents, c GROUP BY 1""")
def stratified_bins(spark, sf_dir):
    d = partitioning.size_bins(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars")
    return d.groupBy("bin").agg(F.count("*").alias("n"), F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))


@query("""
    WITH c AS (SELECT quantile_cont(n_chars, 0.33) AS a, quantile_cont(n_chars, 0.66) AS b FROM documents),
    d AS (SELECT doc_id, n_chars, CASE WHEN n_chars > b THEN 2 WHEN n_chars > a THEN 1 ELSE 0 END AS bin, md5('7:' || doc_id) AS h FROM documents, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY h, doc_id) AS r FROM d)
    SELECT doc_id, n_chars FROM r ORDER BY r > 30, h, doc_id LIMIT 90""")
def stratified_sample(spark, sf_dir):
    return partitioning.stratified_sample(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 90, "n_chars", "doc_id", seed=7)


@query("""
    WITH n AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1], vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
    SELECT vec_id, CAST(CASE WHEN i < n % 7 * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - n % 7 * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS shard FROM n""")
def table_shards(spark, sf_dir):
    """A whole table in order, in seven shards."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding")[0].alias("first"))
    return partitioning.contiguous_shards(e, 7, ["first", "vec_id"]).select("vec_id", "shard")


@query("""
    SELECT m.model, g.num_gpus, b.batch_size, w.workers, CASE WHEN r.i = 0 THEN 'warmup' ELSE 'measured' END AS kind, r.i AS repeat_index
    FROM (SELECT 'm' || p_partkey AS model FROM part) m, (VALUES (1), (2)) g(num_gpus), (VALUES (64), (128), (256)) b(batch_size), (VALUES (4), (8)) w(workers), (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS i) r""")
def trial_plan(spark, sf_dir):
    models = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model"))
    return partitioning.trial_plan(spark, models, [1, 2], [64, 128, 256], [4, 8], 3)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CAST(ntile(3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS shard FROM lineitem")
def contiguous_shards(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", *TILE_ORDER)
    return partitioning.contiguous_shards(t, 3, TILE_ORDER, ["l_orderkey"])


@query("""
    WITH RECURSIVE u AS (SELECT s_suppkey, CAST(round(s_acctbal + 2000) AS BIGINT) AS w, row_number() OVER (ORDER BY -CAST(round(s_acctbal + 2000) AS BIGINT), s_suppkey) AS r FROM supplier),
    f AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS BIGINT) AS w, CAST(NULL AS INTEGER) AS rank, [0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT] AS load
      UNION ALL SELECT u.r, u.s_suppkey, u.w, list_position(f.load, list_min(f.load)) - 1, list_transform(range(1, 5), lambda i: f.load[i] + CASE WHEN i = list_position(f.load, list_min(f.load)) THEN u.w ELSE 0 END) FROM f JOIN u ON u.r = f.r + 1)
    SELECT s_suppkey, w, rank FROM f WHERE r > 0""")
def lpt_assignment(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round(F.col("s_acctbal") + 2000).cast("long").alias("w"))
    return partitioning.balanced(s, 4, "w", "s_suppkey")


@query("""
    WITH RECURSIVE g AS (SELECT c_nationkey, c_custkey, CAST(floor(abs(c_acctbal)) AS BIGINT) % 40 + 1 AS n, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer),
    f AS (SELECT c_nationkey, c_custkey, n, r, 0 AS batch, n AS held FROM g WHERE r = 1
      UNION ALL SELECT g.c_nationkey, g.c_custkey, g.n, g.r, f.batch + CASE WHEN f.held + g.n > 64 THEN 1 ELSE 0 END, CASE WHEN f.held + g.n > 64 THEN g.n ELSE f.held + g.n END FROM f JOIN g ON g.c_nationkey = f.c_nationkey AND g.r = f.r + 1)
    SELECT c_nationkey, c_custkey, n, batch FROM f""")
def supertile_packing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", (F.floor(F.abs("c_acctbal")) % 40 + 1).alias("n"))
    return partitioning.packed_groups(c, ["c_nationkey"], "c_custkey", "n", 64)


@query(f"WITH {TILES_SQL} SELECT sample, list(tile_index ORDER BY tile_index) AS tile_index, list(x ORDER BY tile_index) AS x FROM tiles GROUP BY sample")
def shard_merge(spark, sf_dir):
    t = tiles(spark, sf_dir).select("sample", F.col("tile_index").cast("long").alias("tile_index"), "x", "status")
    return aggregate.in_order(t.where("status = 'F'").unionByName(t.where("status <> 'F'")), ["sample"], "tile_index", ["tile_index", "x"])


# Geometry and dense grids


@query("""
    SELECT p_partkey AS region, CAST(t AS INTEGER) AS subtile, p_partkey * 100 + (t % 3) * 224 AS x, p_size * 50 + (t // 3) * 224 AS y FROM part, (SELECT unnest(range(0, 9)) AS t)""")
def hierarchical_index(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    sub = p.select(F.col("p_partkey").alias("region"), F.explode(X.subtiles(F.col("p_partkey") * 100, F.col("p_size") * 50, 3, F.lit(224))).alias("s"))
    return sub.select("region", "s.subtile", "s.x", F.col("s.y").cast("long").alias("y"))


@query("""
    SELECT p_partkey, CAST(ceil(p_size * 8 / 14) * 14 AS BIGINT) AS encoded, CAST(ceil(p_size * 8 / 14) AS BIGINT) AS grid, CAST(ceil(p_size * 8 / 14) * 14 AS BIGINT) - p_size * 8 AS pad FROM part""")
def dense_geometry(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.dense_geometry(F.col("p_size") * 8, 14).alias("g")).select("p_partkey", "g.encoded", "g.grid", F.col("g.pad").cast("long").alias("pad"))


@query("""
    SELECT p_partkey, CASE WHEN 32 >= p_size * 4 THEN [0::BIGINT] WHEN (p_size * 4 - 32) % 24 = 0 THEN range(0, p_size * 4 - 31, 24) ELSE list_append(range(0, p_size * 4 - 31, 24), p_size * 4 - 32) END AS starts FROM part""")
def window_origins(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.window_starts(F.col("p_size") * 4, F.lit(32), F.lit(24)).alias("starts"))


@query("""
    WITH v AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    c AS (SELECT label, (vec_id % 5) * 16 + i - 1 AS cell, v, 0.5 - 0.5 * cos(2 * pi() * i / 65) AS w FROM v)
    SELECT label, CAST(cell AS BIGINT) AS cell, round(sum(w * v) / sum(w), 6) AS value FROM c GROUP BY 1, 2""")
def overlap_add(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 5 * 16).alias("start"), F.col("embedding").alias("values"))
    return spatial.overlap_add(e, ["label"], "start", "values", digits=6)


@query("""
    WITH t AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
    m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM t WHERE r > 1) GROUP BY 1, 2),
    p AS (SELECT label, list(round(m, 6) ORDER BY pos) AS m FROM m GROUP BY 1)
    SELECT t.label, list_concat(list_transform(t.embedding, lambda x: round(CAST(x AS DOUBLE), 6)), p.m) AS vector FROM t JOIN p USING (label) WHERE t.r = 1""")
def cls_patch_mean(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    # One label may hold much of the table: its class token by min_by, its patches by partial sums.
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("token"), F.min("vec_id").alias("vec_id"))
    patches = aggregate.pool_mean(e.join(first.select("label", "vec_id"), ["label", "vec_id"], "left_anti"), ["label"], "embedding", "mean")
    return first.join(patches, "label").select("label", F.transform(F.concat(F.col("token").cast("array<double>"), "mean"), lambda x: X.rounded(x, 6)).alias("vector"))


@query("""
    WITH s AS (SELECT vec_id, unnest(embedding) * 4 AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    SELECT vec_id, list(round(w, 6) ORDER BY i) AS weights FROM (SELECT vec_id, i, exp(CAST(x AS DOUBLE)) / sum(exp(CAST(x AS DOUBLE))) OVER (PARTITION BY vec_id) AS w FROM s) GROUP BY 1""")
def attention_softmax(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: (x * F.lit(4).cast("float")).cast("double")).alias("s"))
    return e.select("vec_id", F.transform(X.softmax("s"), lambda x: F.round(x, 6)).alias("weights"))


@query("SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_parity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", "other", X.rounded(X.cosine("embedding", "b"), 6).alias("cosine"))


@query("""
    SELECT vec_id, CAST((i - 1) // 8 AS INTEGER) AS h, CAST((i - 1) % 8 AS INTEGER) AS w, v AS value FROM (SELECT vec_id, unnest(embedding[1:]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)""")
def token_fold(spark, sf_dir):
    return spatial.fold(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), ["vec_id"], "embedding", 0, 8)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, CAST(trunc(l_partkey * 0.25 / 0.5) AS BIGINT) AS x, CAST(trunc(l_suppkey * 0.252 / 0.5) AS BIGINT) AS y FROM lineitem")
def scale_coordinates(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", X.scaled("l_partkey", F.lit(0.25), F.lit(0.5)).alias("x"), X.scaled("l_suppkey", F.lit(0.252), F.lit(0.5)).alias("y"))


@query("SELECT p_partkey, CASE WHEN abs(p_retailprice / 4000 - 0.5) <= 0.025 THEN 224 ELSE CAST(round_even(224 * 0.5 / (p_retailprice / 4000), 0) AS BIGINT) END AS read_px FROM part")
def read_plan(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.read_size(F.lit(224), F.lit(0.5), F.col("p_retailprice") / 4000).alias("read_px"))


# Records, names, events


@query("""
    SELECT o_orderkey, list_sort(list_filter([CASE WHEN o_orderstatus IS DISTINCT FROM 'F' THEN 'dtype' END, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'patch' END, 'window'], lambda x: x IS NOT NULL)) AS differs FROM orders""")
def compat_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    recorded = F.create_map(F.lit("dtype"), F.col("o_orderstatus"), F.lit("patch"), F.col("o_orderpriority"))
    expected = F.create_map(F.lit("dtype"), F.lit("F"), F.lit("patch"), F.lit("1-URGENT"), F.lit("window"), F.lit("64"))
    return o.select("o_orderkey", X.differing_keys(recorded, expected).alias("differs"))


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(trim(p_type)), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), ''), 'item') AS label FROM part")
def sanitized_labels(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_label("p_type").alias("label"))


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderkey AS VARCHAR) ELSE '@unit:["' || CAST(o_orderkey AS VARCHAR) || '","' || o_orderstatus || '"]' END AS unit, CAST(o_orderkey AS VARCHAR) AS sample, nullif(o_orderstatus, 'O') AS label FROM orders""")
def work_units(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s"))
    u = o.withColumn("unit", X.work_unit(F.col("o_orderkey").cast("string"), "s"))
    return u.select("o_orderkey", "unit", X.work_unit_parts("unit").alias("p")).select("o_orderkey", "unit", "p.sample", "p.label")


@query("SELECT event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_stream_counts(spark, sf_dir):
    from tesserae.streaming import events

    return events.counts(spark, sf_dir)


@query("SELECT event_type AS kind, user_id, max_by(value, ts::VARCHAR || lpad(event_id::VARCHAR, 20, '0')) AS value FROM events GROUP BY 1, 2")
def latest_task_board(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("seen", F.struct("ts", "event_id"))
    return tables.last_by(ev, ["event_type", "user_id"], "seen", ["value"]).withColumnRenamed("event_type", "kind")


# From tiling to encoding


@query("""
    WITH s AS (SELECT l_orderkey, nullif(l_returnflag, 'N') AS annotation, CAST(sum(l_linenumber % 3) AS BIGINT) AS n, min(l_suppkey) AS k FROM lineitem GROUP BY 1, 2)
    SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, o_custkey, annotation, n AS num_tiles, '/c/' || l_orderkey || '.npz' AS coordinates_npz_path
    FROM orders JOIN s ON l_orderkey = o_orderkey WHERE n > 0 AND k % 10 > 0""")
def tiled_units(spark, sf_dir):
    """Orders as samples with what their lineitems say of a tiling: a unit for each class with tiles and coordinates."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("sample_id"), F.nullif("l_returnflag", F.lit("N")).alias("annotation"))
    status = t.agg(F.sum(F.col("l_linenumber") % 3).alias("num_tiles"), F.min("l_suppkey").alias("_k")).select(
        "sample_id", "annotation", F.lit("success").alias("tiling_status"), F.lit(None).cast("string").alias("error"), "num_tiles", F.when(F.col("_k") % 10 > 0, F.concat(F.lit("/c/"), "sample_id", F.lit(".npz"))).alias("coordinates_npz_path"),
    )
    samples = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("sample_id"), "o_custkey").join(status.select("sample_id").distinct(), "sample_id", "left_semi")
    return tiling.units(samples, status).select("sample_id", "o_custkey", "annotation", "num_tiles", "coordinates_npz_path")


@query("SELECT CAST(conv_id * 1048576 + row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS BIGINT) AS place, conv_id, turn, role AS tiling FROM conversations")
def tilings_beside_samples(spark, sf_dir):
    """Turns as samples, and tilings that only say which place they are for."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
    c = table(spark, sf_dir, "conversations").withColumn("place", F.col("conv_id").cast("long") * 1048576 + n)
    return tiling.beside(c.select("place", "conv_id", "turn"), c.select("place", F.col("role").alias("tiling")), key="conv_id", place="place")


@query("""
    SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey, l_partkey, l_linenumber, l_extendedprice) - 1 AS INTEGER) AS tile_index, CAST(l_partkey AS BIGINT) AS x, CAST(l_suppkey AS BIGINT) AS y,
      CASE WHEN l_linenumber <= 2 THEN 224 ELSE CAST(round_even(224 * 0.5 / 0.3, 0) AS INTEGER) END AS read_tile_size_px, 0.5 AS requested_spacing_um, CASE WHEN l_linenumber <= 2 THEN 0.5 ELSE 0.3 END AS read_spacing_um, l_linenumber <= 2 AS is_within_tolerance FROM lineitem""")
def region_records(spark, sf_dir):
    """Tiles as regions given by coordinates, of images that have the spacing asked for or a finer one."""
    source = F.when(F.col("l_linenumber") <= 2, 0.5).otherwise(0.3)
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"), "l_linenumber", "l_extendedprice", source.alias("s"))
    choice = records.level_choice(F.lit(0.5), "s", F.array(F.lit(1.0)), 0.05)
    plan = records.region_plan(choice, F.lit(224), F.lit(0.5), source_spacing_um=F.col("s"), spacing_at_level_0=F.col("s"), tolerance=0.05)
    r = t.withColumn("read_plan", plan).withColumn("read_tile_size_px", F.col("read_plan.read_size")[0]).withColumn("requested_tile_size_px", F.lit(224))
    out = tiling.region_records(r, ["y", "x", "l_linenumber", "l_extendedprice"])
    return out.select("sample_id", "tile_index", "x", "y", "read_tile_size_px", "requested_spacing_um", "read_spacing_um", "is_within_tolerance")
