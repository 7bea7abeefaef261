"""Exact top-k inner-product search with vector-approximation files.

Two files are made from the vectors: the exact integer vectors, and the
approximation, one byte a component: the number of the component's cell among
256 equal cells between the smallest and largest value of that dimension.

* Scan: every query meets every approximation, in units of a block of queries
  and a block of cells.  The score with the cells' middles, plus or minus the
  largest error the cells allow that query, bounds the true score.  A unit
  returns, for each query, the rows whose upper bound reaches the unit's kth
  lower bound; the best of the units' kth lower bounds then cuts the rest.
* Read: exact vectors are fetched in bound order, in two steps: the k rows with
  the best bounds give a certain kth score, and only rows whose upper bound
  reaches it are read after that.

The result is exact whatever the data; only the number of rows read depends on
how tight the cells are.

Defined results: vectors that are null or hold null, NaN or infinite components
take no part, neither do rows without an id.  Vectors meet only vectors of the
same length.  Ties go to the smaller id.  Rows that share an id are never each
other's neighbours.  A score outside the range of a long comes back null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmart.llm.common import stash, stream_groups

CELLS = 256
QUERY_BLOCK = 1024
CELL_BLOCK = 8192


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of every component of every valid vector."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine)
            .select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * scale)).alias("v")))


def cell_bounds(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each vector length: the smallest value and the cell width of every
    dimension.  As many numbers as vectors have dimensions reach the driver."""
    rows = (vectors.select("dim", F.posexplode("v").alias("pos", "x")).groupBy("dim", "pos")
            .agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("dim", "pos").collect())
    out: dict[int, tuple[list, list]] = {}
    for r in rows:
        lo, width = out.setdefault(r["dim"], ([], []))
        lo.append(r["lo"])
        width.append((r["hi"] - r["lo"]) // CELLS + 1)
    # float64: values beyond 2**53 are rounded here, which the slack of _scan covers
    return {d: (np.array(a, float), np.array(b, float)) for d, (a, b) in out.items()}


def _cells(bounds):
    @F.pandas_udf("binary")
    def to_cells(v: pd.Series) -> pd.Series:
        def one(x):
            lo, width = bounds.get(len(x), (np.empty(0), np.empty(0)))
            return np.clip((np.asarray(x, float) - lo) // width, 0, CELLS - 1).astype(np.uint8).tobytes()
        return v.map(one)
    return to_cells


def _scan(bounds, k: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        is_query = pdf["cells"].isna().to_numpy()
        if not is_query.any() or is_query.all():
            return None
        dim = int(pdf["dim"].iloc[0])
        lo, width = bounds.get(dim, (np.empty(0), np.empty(0)))
        ids = pdf["vec_id"].to_numpy()[~is_query]
        cells = np.frombuffer(b"".join(pdf["cells"][~is_query]), np.uint8).reshape(len(ids), dim)
        half = (width - 1) / 2
        middle = lo + cells * width + half
        largest = np.abs(middle).max(0) + width if dim else width
        q_ids = pdf["vec_id"].to_numpy()[is_query]
        q = np.array(pdf["v"][is_query].tolist(), float).reshape(len(q_ids), dim)
        # what the cells may hide, and the rounding of the sums
        error = np.abs(q) @ half + 1e-12 * (np.abs(q) @ largest) + 1e-6
        out = []
        for a in range(0, len(q), 128):
            s = q[a:a + 128] @ middle.T
            s[q_ids[a:a + 128, None] == ids[None, :]] = -np.inf
            e = error[a:a + 128]
            kth = np.partition(s, len(ids) - k, 1)[:, len(ids) - k] if len(ids) >= k else np.full(len(s), -np.inf)
            i, j = np.nonzero((s >= (kth - 2 * e)[:, None]) & np.isfinite(s))
            out.append(pd.DataFrame({"query_id": q_ids[a:a + 128][i], "vec_id": ids[j], "middle": s[i, j],
                                     "error": e[i], "floor": kth[i] - e[i]}))
        return pd.concat(out, ignore_index=True)
    return work


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024,
          id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where ``is_query`` (a condition
    on ``vec_id``) holds, the ``k`` other rows with the largest integer inner product."""
    exact = stash(integer_vectors(vectors, id_col, vec_col, scale), "topk-exact")
    queries = exact.where(is_query).dropDuplicates(["vec_id", "v"])
    n, n_q = exact.count(), queries.count()
    bounds = cell_bounds(exact)
    c_blocks, q_blocks = -(-n // CELL_BLOCK) or 1, -(-n_q // QUERY_BLOCK) or 1
    approx = stash(exact.select("vec_id", "dim", _cells(bounds)("v").alias("cells")), "topk-cells")

    def block(blocks):
        return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")

    def each(blocks):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = approx.select("dim", block(c_blocks).alias("cb"), each(q_blocks).alias("qb"), "vec_id", "cells",
                         F.lit(None).cast("array<bigint>").alias("v"))
    right = queries.select("dim", each(c_blocks).alias("cb"), block(q_blocks).alias("qb"), "vec_id",
                           F.lit(None).cast("binary").alias("cells"), "v")
    found = stash(stream_groups(left.unionByName(right), ["dim", "cb", "qb"], _scan(bounds, k),
                                "query_id long, vec_id long, middle double, error double, floor double"), "topk-found")
    floors = found.groupBy("query_id").agg(F.max("floor").alias("sure"))
    ahead = stash(found.join(floors, "query_id").where("middle + error >= sure")
                  .groupBy("query_id", "vec_id").agg(F.max("middle").alias("middle"), F.max("error").alias("error"))
                  .withColumn("place", F.row_number().over(
                      W.partitionBy("query_id").orderBy(F.col("middle").desc(), "vec_id"))), "topk-ahead")

    q = queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def read(pairs: DataFrame) -> DataFrame:
        """The exact scores of pairs, as decimals that can't overflow."""
        product = F.zip_with("q", "v", lambda a, b: a.cast("decimal(19,0)") * b.cast("decimal(19,0)"))
        return (pairs.join(exact.select("vec_id", "dim", "v"), "vec_id").join(q, "query_id")
                .where(F.size("q") == F.col("dim"))
                .select("query_id", "vec_id", F.aggregate(product, F.lit(0).cast("decimal(38,0)"), lambda s, x: (
                    s + x).cast("decimal(38,0)")).alias("score")))

    first = stash(read(ahead.where(F.col("place") <= k)), "topk-first")
    sure = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    more = read(ahead.where(F.col("place") > k).join(sure, "query_id")
                .where((F.col("n") < k) | (F.col("middle") + F.col("error") + 1 >= F.col("kth").cast("double") * (
                    1 - F.signum(F.col("kth").cast("double")) * 1e-12)))
                .select("query_id", "vec_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (first.unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id",
                    F.col("score").try_cast("long").alias("score")))
