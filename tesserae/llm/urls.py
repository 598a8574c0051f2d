"""URL filter by rules and link-graph propagation, with DataFrame functions only.

Rules (host and path prefix) decide first. Hosts of pages they allow are trusted seeds, hosts of pages
they block are distrusted ones. Trust is a personalised PageRank along host edges from the trusted
seeds; distrust is one along the reversed edges from the blocked seeds, so that who links to blocked
hosts is distrusted. A host's other pages are blocked if its distrust passes a threshold and far outweighs
its trust. Host edges are links of pages that name a host (with a scheme or from // on), and ties between a host and its parent domain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import partitions, remove, settle

#: Fixed values: (verdict, host, path prefix) of the default rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING = 0.85
#: Ranks are settled when all of them together are no farther than this from the exact solution; seeds have a mass of one.
TOLERANCE = 1e-6
#: Steps along links are joined to themselves as long as that makes at most so many rows (or four times the edges).
DOUBLED_ROWS = 1 << 20
#: Rounds between writes that cut the lineage.
ROUNDS_PER_TABLE = 8
#: A host is blocked if its distrust is over this many times the mean of hosts, and over so many times its trust.
THRESHOLD, MARGIN = 1.0, 3.0
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ://; empty for null or without one. Later ones, as in redirects, play no part."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _AZ, _az)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty for null or without ://."""
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*(/[^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does. Rules of one length: the longer host first."""
    rule = verdict = None
    for kind, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)) if rule is None else rule.when(fits, F.lit(name + prefix))
        verdict = F.when(fits, F.lit(kind)) if verdict is None else verdict.when(fits, F.lit(kind))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts. pages: host, html.

    Links are counted by host pair before they are shuffled. The parent of a host is what follows its first
    dot, if that has a dot itself; a tie counts as a link both ways.
    """
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^\s"'<>]+)"""), 1)
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("url")).select("src", host_of(F.concat(F.lit(":"), F.regexp_replace("url", "^[^/]*:", ""))).alias("dst"))
    hosts = pages.where("host <> ''").select("host").distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    ties = hosts.select("host", parent.alias("up")).where("up <> ''")
    every = links.unionByName(ties.select(F.col("host").alias("src"), F.col("up").alias("dst"))).unionByName(ties.select(F.col("up").alias("src"), F.col("host").alias("dst")))
    return every.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))


def joined_with(steps: DataFrame, right: DataFrame) -> DataFrame:
    """steps: (src, dst, share). Rows of right (at, ...) moved along the steps that start there."""
    return right.join(steps, right["at"] == steps["src"])


def pairs_of(steps: DataFrame) -> int:
    """Pairs of steps that follow one another, counted without making them."""
    ends = steps.groupBy(F.col("dst").alias("h")).agg(F.count("*").alias("a"))
    starts = steps.groupBy(F.col("src").alias("h")).agg(F.count("*").alias("b"))
    return ends.join(starts, "h").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int | None = None, tolerance: float = TOLERANCE, certain=None, doubled: bool = True) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, mass) along edges (src, dst, share).

    Mass of hosts without an out-edge is lost to the sum, as if it left the graph; ranks are compared, not
    added up. Hosts never reached have no row. The ranks of k steps are a sum over walks of fewer than k steps, and
    those of 2 k steps are these plus these moved by k steps. So steps are doubled by joining them to themselves
    while that makes no more rows than a few times the edges, or DOUBLED_ROWS; beyond, ranks move by the steps last
    made, a round being one shuffle of host rows, for the steps are dealt by src once and kept. It goes on
    until no rank is farther than tolerance from the exact one (after k steps what is missing adds up to at most
    damping ** k times the seeds' mass of one), or for the given number of steps less one.

    certain: from a DataFrame of ranks to one number, the distance up to which nothing that is asked of them can
    change (null: any); it ends when the ranks are nearer than that.
    """
    spark = edges.sparkSession
    add = lambda a, b: a.unionByName(b).groupBy("host").agg(F.sum("rank").alias("rank"))
    move = lambda ranks, steps: joined_with(steps, ranks.withColumnRenamed("host", "at")).select(F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
    first, p_first = settle(seeds.select("host", (F.col("mass") * ((1 - damping) if iterations is None else 1.0)).alias("rank")), tidied=False)
    if iterations is not None:
        base = first.select("host", (F.col("rank") * (1 - damping)).alias("rank"))
    steps, p_steps = settle(edges.select("src", "dst", (F.col("share") * damping).alias("share")), tidied=False)
    ranks, p_ranks, size, done = first, p_first, 1, 1
    most = max(DOUBLED_ROWS, 4 * steps.count())

    def near_enough() -> bool:
        if damping**done <= tolerance:
            return True
        if certain is None or damping**done > 0.01:  # too early to ask
            return False
        far = certain(ranks).first()[0]
        return far is None or damping**done < far

    while doubled and iterations is None and not near_enough() and (steps.count() ** 2 <= most or pairs_of(steps) <= most):
        ranks, p_new = settle(add(ranks, move(ranks, steps)), p_ranks, tidied=False)
        onward = joined_with(steps, steps.select(F.col("src").alias("from"), F.col("dst").alias("at"), F.col("share").alias("so_far")))
        twice = onward.groupBy(F.col("from").alias("src"), "dst").agg(F.sum(F.col("so_far") * F.col("share")).alias("share"))
        steps, p_twice = settle(twice, p_steps, tidied=False)
        p_ranks, p_steps, size, done = p_new, p_twice, 2 * size, 2 * done
    kept = steps.repartition(partitions(spark), "src").persist()
    if iterations is None:
        base, p_base = ranks, p_ranks
    else:
        p_base = p_first
    while (done <= iterations) if iterations is not None else not near_enough():
        rounds = ROUNDS_PER_TABLE if iterations is None else min(ROUNDS_PER_TABLE, iterations - done + 1)
        new = ranks
        for _ in range(rounds):
            new = add(base, move(new, kept))
        new, p_new = settle(new, *([p_ranks] if p_ranks != p_base else []), tidied=False)
        ranks, p_ranks, done = new, p_new, done + rounds * size
    kept.unpersist()
    remove(spark, p_steps)
    if p_ranks != p_base:
        remove(spark, p_base)
    return ranks


def room(ranks: DataFrame, n: int, threshold: float) -> DataFrame:
    """The distance from the exact ranks up to which no host's verdict can be another: the least over hosts, in one row.

    ranks: (host, rank), host being `allow ` or `block ` and the name. Hosts that were not reached have no distrust
    and are allowed up to the threshold.
    """
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("host").startswith(kind + " "), F.col("rank"))), F.lit(0.0))
    both = ranks.groupBy(F.substring("host", 7, 1 << 30).alias("name")).agg(of("allow").alias("t"), of("block").alias("d"))
    over, more = F.col("d") - threshold / n, (F.col("d") - MARGIN * F.col("t")) / (1 + MARGIN)
    return both.select(F.when((over > 0) & (more > 0), F.least(over, more)).otherwise(F.greatest(-over, -more)).alias("room")).agg(F.least(F.min("room"), F.lit(threshold / n)))


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, iterations: int | None = None, threshold: float = THRESHOLD, tolerance: float | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust (multiples of the mean over hosts) for every row of pages.

    Ranks are iterated until no host's verdict can change any more (or, should one stay open, until all are within
    TOLERANCE); if they are wanted themselves, a tolerance says how near.
    Pages without a host have no rule and are allowed. Null html: no links. Repeated rows are judged alike and
    count as often as they occur; extra columns are ignored. An empty table gives no rows.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "html", host.alias("host"), path.alias("path")).withColumns({"rule": rule, "by_rule": verdict})
    edges, p_edges = settle(host_edges(judged.select("host", "html")))
    pages_of = judged.where("host <> ''").groupBy("host").agg(*(F.count(F.when(F.col("by_rule") == k, 1)).cast("double").alias(k) for k in ("allow", "block")), F.count("*").alias("n"))
    pages_of, p_hosts = settle(pages_of)
    n, allow, block = pages_of.agg(F.count("*"), F.sum("allow"), F.sum("block")).first()
    # Both ranks move in the same rounds: two graphs apart, with the kind before the host.
    ways, starts = [], []
    for kind, total, src, dst in (("allow", allow, "src", "dst"), ("block", block, "dst", "src")):
        sums = edges.groupBy(src).agg(F.sum("links").alias("out"))
        of = lambda c: F.concat(F.lit(kind + " "), F.col(c))  # noqa: B023, E731
        ways.append(edges.join(sums, src).select(of(src).alias("src"), of(dst).alias("dst"), (F.col("links") / F.col("out")).alias("share")))
        starts.append(pages_of.where(F.col(kind) > 0).select(of("host").alias("host"), (F.col(kind) / F.lit(float(total or 1))).alias("mass")))
    along, p_along = settle(ways[0].unionByName(ways[1]))
    certain = None if tolerance is not None or not n else lambda r: room(r, n, threshold)
    ranks = propagate(along, starts[0].unionByName(starts[1]), damping, iterations, TOLERANCE if tolerance is None else tolerance, certain)
    scaled = {kind: ranks.where(F.col("host").startswith(kind + " ")).select(F.substring("host", 7, 1 << 30).alias("host"), (F.col("rank") * F.lit(float(n or 1))).alias(name)) for kind, name in (("allow", "trust"), ("block", "distrust"))}
    scores = pages_of.select("host").join(scaled["allow"], "host", "left").join(scaled["block"], "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    scores, _ = settle(scores, p_edges, p_hosts, p_along)
    out = judged.drop("html").join(scores, "host", "left")
    guess = F.when((F.col("distrust") > threshold) & (F.col("distrust") > MARGIN * F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", guess).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))

