"""URL filters with link-graph propagation.

A rule decides the urls it fits; the longest wins.  The verdict on all others
comes from their host's place in the link graph: personalised PageRank spreads
trust from the hosts of allowed pages along links, and distrust from the hosts of
blocked pages against them (who links to a bad host is suspect).  A host whose
distrust exceeds ``ratio`` times its trust is blocked.

The graph holds one weighted edge for each pair of hosts, counted in Spark before
any shuffle by host; links inside a host are left out.  Both walks run in one
table (kind, host, rank), one join and one sum a step.

Defined results: a null url, or one without ``://``, has empty host and path, fits
no rule and is allowed, as is every host that neither walk reaches.  Null html has
no links.  Repeated rows are pages of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import drop_stash, stash

CUT = 4
MARGIN, EVEN = 4, 1e-12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    whens = [F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
                    F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
             for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))]
    return F.coalesce(*whens)


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, from (host, html)."""
    href = F.regexp_extract_all("html", F.lit(r"""(?i)\b(?:href|src)\s*+=\s*+["']?+\s*+((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return (pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(href).alias("link"))
            .select("src", host_of(link).alias("dst")).where("dst <> '' AND dst <> src")
            .groupBy("src", "dst").agg(F.count("*").alias("n")))


def moved_since(rank: DataFrame, before: DataFrame, ratio: float):
    """One row: ``new`` (kind, host) pairs, ``worst`` relative change of a rank, and the number
    of hosts with both ranks whose verdict is still ``open``."""
    zero = F.lit(0.0)
    both = (rank.where("rank > 0").join(before, ["kind", "host"], "left")
            .select("kind", "host", "rank", "before", F.abs(F.col("rank") - F.coalesce("before", zero)).alias("change")))
    sums = [F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(zero)).alias(f"{k}_{c}")
            for k in ("trust", "distrust") for c in ("rank", "change")]
    hosts = both.groupBy("host").agg(F.sum(F.when(F.col("before").isNull(), 1).otherwise(0)).alias("new"),
                                     F.max(F.col("change") / F.col("rank")).alias("worst"), *sums)
    gap = F.abs(F.col("distrust_rank") - ratio * F.col("trust_rank"))
    near = ((F.col("trust_rank") > 0) & (F.col("distrust_rank") > 0)
            & (gap <= MARGIN * (F.col("distrust_change") + ratio * F.col("trust_change"))) & (F.col("worst") > 0))
    return hosts.agg(F.coalesce(F.sum("new"), F.lit(0)).alias("new"), F.coalesce(F.max("worst"), zero).alias("worst"),
                     F.coalesce(F.sum(near.cast("int")), F.lit(0)).alias("open")).first()


def propagate(links: DataFrame, seeds: DataFrame, steps: int = 1000, damping: float = 0.85,
              tolerance: float = 1e-4, ratio: float = 1.0) -> DataFrame:
    """Personalised PageRank of both kinds: ``seeds`` has (kind, host, n) with kind
    ``trust`` or ``distrust``; returns (kind, host, rank).  Trust follows the links,
    distrust runs against them.  Mass on hosts without a way on returns to the seeds.

    Stops when CUT steps reached no new (kind, host), changed every rank by at most
    ``tolerance`` of itself, and left every host reached by both kinds so far from
    distrust = ratio * trust that MARGIN times its change doesn't cross it (or changed every
    rank by at most EVEN of itself: such a host is even).  Fails if ``steps`` don't get
    there; with ``tolerance`` 0, walks ``steps`` steps."""
    both = (links.select(F.lit("trust").alias("kind"), "src", "dst", "n")
            .union(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"),
                                F.col("src").alias("dst"), "n")))
    out_n = both.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    moves = stash(both.join(out_n, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("total")).alias("w")),
                  "pagerank-moves")
    total = seeds.groupBy("kind").agg(F.sum("n").alias("total"))
    start = stash(seeds.join(total, "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("rank")),
                  "pagerank-start")
    rank = start
    held = None
    for step in range(1, steps + 1):
        moved = (rank.withColumnRenamed("host", "src").join(moves, ["kind", "src"])
                 .groupBy("kind", F.col("dst").alias("host")).agg((damping * F.sum(F.col("rank") * F.col("w"))).alias("rank")))
        # what didn't move returns to the seeds
        kept = start.join(moved.groupBy("kind").agg(F.sum("rank").alias("moved")), "kind", "left").select(
            "kind", "host", (F.col("rank") * (1 - F.coalesce("moved", F.lit(0.0)))).alias("rank"))
        rank = moved.union(kept).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if step % CUT == 0 or step == steps:
            rank, old = stash(rank, "pagerank"), held
            before = (start if old is None else old).withColumnRenamed("rank", "before")
            now = moved_since(rank, before, ratio)
            held = rank
            if old is not None:
                drop_stash(old)
            if tolerance > 0 and not now["new"] and (
                    now["worst"] <= min(tolerance, EVEN) or now["worst"] <= tolerance and not now["open"]):
                break
    else:
        if tolerance > 0:
            raise RuntimeError(f"ranks did not settle in {steps} steps")
    return rank


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          rules=RULES, steps: int = 1000, damping: float = 0.85, ratio: float = 1.0) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``trust``, ``distrust``."""
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        F.col(html_col).alias("html"))
    ruled = base.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    seeds = (ruled.where("r IS NOT NULL").groupBy(
        F.when(F.col("r.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
        .agg(F.count("*").alias("n")))
    ranks = propagate(stash(host_links(base), "host-links"), stash(seeds, "host-seeds"), steps, damping, ratio=ratio)
    of = {k: F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")}
    hosts = ranks.groupBy("host").agg(*of.values())
    zero = F.lit(0.0)
    return (ruled.drop("html").join(hosts, "host", "left")
            .select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", F.when(
                        F.coalesce("distrust", zero) > ratio * F.coalesce("trust", zero), "block")
                        .otherwise("allow")).alias("verdict"),
                    F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust")))
