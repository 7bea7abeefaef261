"""Mixing sources to target weights by balanced (cube) sampling.

Sources share ``share`` times all words by their weights.  A source's target
stops at ``cap`` times its own words; what it can't take is shared out again by
weight until no source is above its cap.

A source whose target is e times its size takes every document floor(e) times
and each once more with probability e - floor(e).  That extra draw is the cube
method.  Flight phase: three undecided documents at a time move along the null
space of the two balancing constraints (number of documents, number of words)
until one of them reaches 0 or 1, so both totals stay what they were.  Flights
run inside blocks of a source; the few documents a block can't decide meet in
the next, smaller level.  Landing phase: the last of a source's documents (at
most ``LAND``) take the combination whose words come nearest to the target.

Draws depend on the seed, the source and the sorted ids only, so reruns agree.
Only (id, source, size, probability) is shuffled, never a text.

Defined results: null text has size 0; a null source is a source of its own;
documents of size 0 take 0; a source of size 0 has target 0.  Repeated rows are
documents of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmart.llm.common import drop_stash, stash

WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 1 << 15
LAND = 10
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(col) -> F.Column:
    """Number of maximal runs of characters other than the six ASCII spaces."""
    return F.coalesce(F.regexp_count(col, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS) -> DataFrame:
    """``sources`` has (source, source_size), one row per source; adds ``target``.

    Resharing until none is above its cap ends at the level L with
    sum(min(cap * size, L * weight)) = share * sum(size).  Sorted by the level
    at which each is full, the full ones are a prefix, found with running sums.
    The windows run over the table of sources, not over documents.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = (sources.withColumn("weight", F.get(w, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
         .withColumn("most", cap * F.col("source_size"))
         .withColumn("full_at", F.col("most") / F.col("weight")))
    whole = W.partitionBy()
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = (s.withColumn("left", F.lit(share) * F.sum("source_size").over(whole)
                      - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
         .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
         .withColumn("level", F.col("left") / F.col("open"))
         # the first source that isn't full at its level sets the level of all that follow
         .withColumn("final", F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "source", "level")))
                     .over(whole)["level"]))
    return s.select("source", "source_size", F.when(
        F.col("final").isNull() | (F.col("full_at") <= F.col("final")), F.col("most"))
        .otherwise(F.col("final") * F.col("weight")).alias("target"))


def flight(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves the probabilities ``p`` to 0 or 1 where it can, keeping sum(p) and
    sum(p * x).  All triples of a round move at once; at most two stay undecided."""
    p = p.copy()
    idle = 0
    while True:
        open_ = np.flatnonzero((p > 0) & (p < 1))
        n = len(open_) // 3
        if not n or idle > 20:
            return p
        if idle:                      # a round of rounding errors only: other triples
            open_ = rng.permutation(open_)
        t = open_[:3 * n].reshape(n, 3)
        a, b, c = x[t[:, 0]], x[t[:, 1]], x[t[:, 2]]
        u = np.stack([c - b, a - c, b - a], 1).astype(float)
        same = ~u.any(1)
        u[same] = [1.0, -1.0, 0.0]
        q = p[t]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min(1)
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min(1)
        step = np.where(rng.random(n) * (up + down) < down, up, -down)
        q = q + step[:, None] * u
        q[q < 1e-9] = 0
        q[q > 1 - 1e-9] = 1
        p[t] = q
        idle = 0 if len(np.flatnonzero((p > 0) & (p < 1))) < len(open_) else idle + 1


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """0 or 1 for each of at most LAND undecided units: the choice whose words,
    then whose number, come nearest to the expected ones."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    if len(open_):
        pick = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        words = np.abs(pick @ x[open_] - p[open_] @ x[open_])
        count = np.abs(pick.sum(1) - p[open_].sum())
        out[open_] = pick[np.lexsort((np.arange(len(pick)), count, words.round(6)))[0]]
    return out


def _block(seed: int, level: int, last: bool):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "no_id", "doc_id", "size"], kind="stable")
        name = pdf["source"].iloc[0]
        tag = f"{seed}|{level}|{pdf['block'].iloc[0]}|{'' if name is None else 's' + name}"
        rng = np.random.default_rng(xxhash.xxh3_64_intdigest(tag.encode("utf-8", "surrogatepass")))
        p, x = pdf["p"].to_numpy(float), pdf["size"].to_numpy(float)
        if last:
            open_ = np.flatnonzero((p > 0) & (p < 1))
            # a document of about each power of two words is left for the landing
            order = open_[np.argsort(x[open_], kind="stable")]
            at = np.searchsorted(x[order], 2.0 ** np.arange(LAND - 2))
            head = np.delete(order, np.unique(at[at < len(order)]))
            q = p.copy()
            if len(head):
                q[head] = flight(p[head], x[head], rng)
            left = np.flatnonzero((q > 0) & (q < 1))
            p = land(q, x) if len(left) <= LAND else land(flight(q, x, rng), x)
        else:
            p = flight(p, x, rng)
        return pdf.assign(p=p)[["doc_id", "no_id", "source", "size", "order", "p"]]
    return work


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, seed: int = 7) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``copies`` (times the mix takes it) and ``taken`` (copies * size)."""
    sized = stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"),
                              word_count(F.col(text_col)).alias("size")), "mix-sizes")
    plan = stash(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), share, cap, weights),
                 "mix-targets")
    named = (sized.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
             .withColumn("copies", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                         .otherwise(0.0))
             .withColumn("base", F.floor(F.col("copies") + 1e-12).cast("int"))
             .withColumn("p", F.greatest(F.col("copies") - F.col("base"), F.lit(0.0))))
    # documents without words change no total: they are left out of the draw
    draw = named.where("size > 0 AND p > 0").select(      # no nulls among the ids: pandas would make them inexact
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "source", "size", F.xxhash64(F.lit(seed), "doc_id").alias("order"), "p")
    schema = "doc_id long, no_id boolean, source string, size long, order long, p double"
    done, level, open_, scratch = [], 0, draw, None
    while True:
        most = (open_.groupBy("source").count().agg(F.max("count")).first()[0]) or 0
        if not most:
            break
        last = most <= BLOCK
        # about BLOCK documents in a block, and blocks of every source the same way
        blocks = 1 if last else -(-most // BLOCK)
        dealt = open_.withColumn("block", F.lit(0) if last else F.pmod(
            F.xxhash64("order", F.lit(level)), F.lit(blocks)).cast("int"))
        out = stash(dealt.groupBy("source", "block").applyInPandas(_block(seed, level, last), schema), "mix-flight")
        done.append(out.where("p = 0 OR p = 1"))
        open_ = out.where("p > 0 AND p < 1")
        level += 1
        if last:
            break
    rest = named.where("NOT (size > 0 AND p > 0)").select(
        "doc_id", "source", "size", "source_size", "target", "base").withColumn("extra", F.lit(0.0))
    out = rest
    if done:
        drawn = done[0]
        for d in done[1:]:
            drawn = drawn.unionByName(d)
        bases = (plan.withColumn("base", F.floor(F.col("target") / F.col("source_size") + 1e-12).cast("int"))
                 .where("source_size > 0").withColumnRenamed("source", "s"))
        out = rest.unionByName(
            drawn.join(bases, F.col("source").eqNullSafe(F.col("s")))
            .select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "source", "size", "source_size",
                    "target", "base", F.col("p").alias("extra")))
    return (out.withColumn("copies", (F.col("base") + F.col("extra")).cast("int"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def apply(docs: DataFrame, id_col: str = "doc_id", **params) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as the mix takes it, same columns.

    Copies come back by id.  Rows that share an id, or have none, and get different
    numbers of copies take them in turn."""
    copies = (mix(docs, id_col=id_col, **params).groupBy(F.col("doc_id").alias("_mix_id"), "copies").agg(
        F.count("*").cast("int").alias("n"))
        # at most as many entries as there are numbers of copies
        .groupBy("_mix_id").agg(F.sort_array(F.collect_list(F.struct("copies", "n"))).alias("_mix")))
    named = docs.join(copies, F.col(id_col).cast("long").eqNullSafe(F.col("_mix_id")))
    one = named.where(F.size("_mix") == 1).withColumn("_mix_n", F.element_at("_mix", 1)["copies"])
    turn = F.row_number().over(W.partitionBy("_mix_id").orderBy("_mix_id"))
    # the copies of the turn-th row: the list with every entry repeated n times, not spelled out
    place = F.aggregate("_mix", F.struct(F.lit(0).alias("seen"), F.lit(-1).alias("got")), lambda s, e: F.struct(
        (s["seen"] + e["n"]).alias("seen"),
        F.when((s["got"] < 0) & (F.col("_mix_turn") <= s["seen"] + e["n"]), e["copies"]).otherwise(s["got"])
        .alias("got")))["got"]
    more = named.where(F.size("_mix") > 1).withColumn("_mix_turn", turn).withColumn("_mix_n", place)
    return (one.unionByName(more.drop("_mix_turn")).where("_mix_n > 0")
            .withColumn("_mix_i", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*docs.columns))
