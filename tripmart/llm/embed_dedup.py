"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors with equal labels link when their cosine is at least 0.98.  Unit vectors
at that cosine lie 0.2 apart, so a hash floor((a.x + b) / width) with Gaussian a
rarely parts them.  TABLES tables, each keyed by HASHES such hashes, make the
buckets; two vectors are compared exactly, in double precision, in every bucket
they share, and their link is counted in the first table that they share only.

With width 1, 9 hashes and 40 tables, a pair at cosine 0.98 exactly shares no
bucket with probability 9e-5 (closer pairs less); orthogonal vectors share a
given bucket with 8e-6.

Equal vectors of a label are one node with a count.  A bucket is cut into blocks
of 512 nodes, and each pair of blocks is one unit of work.  A unit returns, for
each node, its links and the smallest id of its component inside the unit: never
the pairs.

Defined results: vectors that are null, empty or zero, that hold null, NaN or
infinite components, or whose label is null link with nothing and are their own
component, kept.  Vectors link only with vectors of the same length.  Rows that
share an id are one node of the graph and count as different vectors when their
components differ.  Rows without an id link with nothing: component null, kept.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import components, mix64, stash, stream_groups

HASHES, TABLES, WIDTH = 9, 40, 1.0
BLOCK = 512


def projections(dim: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.standard_normal((dim, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length, in double precision; scaled first so that
    neither very large nor very small components overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def table_keys(x: np.ndarray, seed: int) -> np.ndarray:
    """(rows, TABLES) int64 bucket keys of unit vectors of one length."""
    a, b = projections(x.shape[1], seed)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(x), TABLES, HASHES)
    h = np.zeros((len(x), TABLES), np.uint64) + np.uint64(x.shape[1])
    for i in range(HASHES):
        h = mix64(h ^ cells[:, :, i]) + np.uint64(i + 1)
    return h.view(np.int64)


def usable(v) -> bool:
    if v is None or not len(v):
        return False
    x = np.asarray(v, float)          # null components become NaN
    return bool(np.isfinite(x).all() and x.any())


def _unit(threshold: float):
    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        t, i, j = (int(pdf[c].iloc[0]) for c in ("t", "i", "j"))
        length = pdf["embedding"].map(len)
        if length.nunique() > 1:      # two lengths under one 64-bit key
            got = [g for _, part in pdf.groupby(length) if (g := work(part)) is not None]
            return pd.concat(got) if got else None
        pdf = pdf.drop_duplicates("node")
        label, block = pdf["label"].to_numpy(), pdf["block"].to_numpy()
        x = unit_rows(np.array(pdf["embedding"].tolist(), float))
        keys = np.array(pdf["keys"].tolist(), np.int64).reshape(len(pdf), TABLES)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        s = x[left] @ x[right].T
        a, b = np.nonzero((s >= threshold) & (label[left][:, None] == label[right][None, :]))
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        fresh = ~(keys[a, :t] == keys[b, :t]).any(1)
        a, b = a[fresh], b[fresh]
        if not len(a):
            return None
        node, copies = pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        links = (np.bincount(a, copies[b], len(pdf)) + np.bincount(b, copies[a], len(pdf))).astype(np.int64)
        vec = pdf["vec_id"].to_numpy()
        low = vec.copy()
        while True:
            old = low.copy()
            np.minimum.at(low, a, old[b])
            np.minimum.at(low, b, old[a])
            if (old == low).all():
                break
        hit = links > 0
        return pd.DataFrame({"node": node[hit], "vec_id": vec[hit], "links": links[hit], "low": low[hit]})
    return work


def dedup(vectors: DataFrame, threshold: float = 0.98, seed: int = 11, id_col: str = "vec_id",
          vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    base = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("embedding"),
                          F.col(label_col).cast("string").alias("label"))

    @F.pandas_udf("node binary, keys array<bigint>")
    def hashed(v: pd.Series, label: pd.Series) -> pd.DataFrame:
        node, keys = [None] * len(v), [None] * len(v)
        ok = [i for i, (x, name) in enumerate(zip(v, label, strict=True)) if name is not None and usable(x)]
        lengths = np.array([len(v.iloc[i]) for i in ok])
        for d in np.unique(lengths):
            at = [ok[n] for n in np.flatnonzero(lengths == d)]
            x = np.array([v.iloc[i] for i in at], float)
            for i, row, key in zip(at, x, table_keys(unit_rows(x), seed), strict=True):
                node[i] = xxhash.xxh3_128_digest((row + 0.0).tobytes() + label.iloc[i].encode())
                keys[i] = key
        return pd.DataFrame({"node": pd.Series(node, dtype=object), "keys": pd.Series(keys, dtype=object)})

    rows = stash(base.select("vec_id", "label", "embedding", hashed("embedding", "label").alias("h"))
                 .select("vec_id", "label", "embedding", "h.*"), "embed-rows")
    whole = rows.where("node IS NOT NULL AND vec_id IS NOT NULL")
    nodes = stash(whole.groupBy("node").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.min_by("label", "vec_id").alias("label"),
        F.min_by("embedding", "vec_id").alias("embedding"), F.min_by("keys", "vec_id").alias("keys")), "embed-nodes")
    slots = nodes.select("node", F.posexplode("keys").alias("t", "key"), "label")
    slots = slots.select("node", "t", F.xxhash64("label", "t", "key").alias("key"))
    sizes = (slots.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
             .select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    units = (slots.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
             .join(nodes, "node")
             .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("key", "t", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "node", "vec_id", "copies", "label", "embedding", "keys"))
    found = stash(stream_groups(units, ["key", "t", "i", "j"], _unit(threshold),
                                "node binary, vec_id long, links long, low long"), "embed-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    # a row's copies hang on the node's smallest id
    copies = whole.join(nodes.where("copies > 1").select("node", F.col("vec_id").alias("first")), "node") \
        .select(F.col("vec_id").alias("a"), F.col("first").alias("b"))
    comps = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")).union(copies)) \
        .toDF("vec_id", "component")
    return (rows.select("vec_id", "node")
            .join(nodes.select("node", "copies"), "node", "left").join(links, "node", "left")
            .join(comps, "vec_id", "left")
            .select("vec_id",
                    F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(
                        F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)))
                    .cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
