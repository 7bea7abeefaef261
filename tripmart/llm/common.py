"""Helpers shared by the operators of this subpackage.

* ``stash``: write a DataFrame to the shared scratch folder and read it back.
  It cuts lineage and survives a lost executor, as a checkpoint does, but the
  rows are computed once.
* ``stream_groups``: run a Python function on every group of rows, one group
  in memory at a time.
* ``components``: connected components of an edge table, with joins only.
* ``word_hashes`` / ``shingle_hashes``: vectorised hashes of words and of
  runs of words of a batch of texts.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.session import scratch_dir

WORD = re.compile(r"\w+")
#: Characters of text whose words are held as Python strings at one time.
PIECE = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def release_memory() -> None:
    """Give the pages that freed arrays left in this worker back to the system, where the C
    library can (glibc); elsewhere nothing happens."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- tables

def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}")
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tripmart_path = path
    return back


def drop_stash(df: DataFrame) -> None:
    """Delete a table made by ``stash`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tripmart_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# ---------------------------------------------------------------- groups

def group_batches(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of equal keys out of key-sorted batches; a group may span batches."""
    held: list[pd.DataFrame] = []
    held_key = None
    for pdf in batches:
        if not len(pdf):
            continue
        cols = [pdf[k].to_numpy() for k in keys]
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != held_key:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held_key = key
            held.append(pdf.iloc[a:b])
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def stream_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None],
                  schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``fn`` to each group of equal (non-null) ``keys``.

    Like ``groupBy().applyInPandas`` without its cost per group: many small
    groups share one Arrow batch.  A task holds one group at a time, so the
    caller bounds the size of a group.
    """
    def run(batches):
        out, n = [], 0
        for group in group_batches(batches, keys):
            got = fn(group)
            if got is not None and len(got):
                out.append(got)
                n += len(got)
            if n >= 20_000:
                yield pd.concat(out, ignore_index=True)
                out, n = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return (df.repartition(*keys).sortWithinPartitions(*keys, *order)
            .mapInPandas(run, schema))


# ---------------------------------------------------------------- components

def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge table.

    ``edges`` has two bigint columns ``a`` and ``b``; loops and repeats are
    allowed.  Returns ``(node, component)``, one row per node that has an edge
    to another node; ``component`` is the smallest node id that can be reached.

    Alternates large-star and small-star steps until the edge table stops
    changing.  Each step is a grouped minimum and a join; each round's edges
    go to the shared folder, so the plan stays short.  Nothing but a row count
    and a checksum per round reaches the driver.
    """
    def ordered(e):
        return (e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct())

    def checksum(e):
        return e.agg(F.count("*").alias("n"), F.coalesce(
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()

    e = stash(ordered(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))),
              "edges")
    seen = checksum(e)
    for _ in range(max_rounds if seen["n"] else 0):
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = ordered(large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*"))
        new = stash(small, "edges")
        now = checksum(new)
        drop_stash(e)
        e = new
        if now == seen:
            break
        seen = now
    else:
        if seen["n"]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


# ---------------------------------------------------------------- words

def _pieces(text: str) -> Iterator[str]:
    """Slices of at most about PIECE characters that end between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = re.compile(r"\W").search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _hash_words(words: list[str]) -> np.ndarray:
    codes, uniques = pd.factorize(np.array(words, dtype=object))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in uniques), np.uint64, len(uniques))
    return table[codes]


def word_hashes(texts) -> list[np.ndarray]:
    """For each text the 64-bit hashes of its lower-cased words (runs of
    letters, digits and underscores), in order; null gives no words."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    words: list[str] = []
    marks: list[tuple[int, int]] = []
    chars = 0

    def flush():
        nonlocal words, marks, chars
        if words:
            hashed, at = _hash_words(words), 0
            for i, n in marks:
                out[i].append(hashed[at:at + n])
                at += n
        words, marks, chars = [], [], 0

    for i, text in enumerate(texts):
        for piece in _pieces(text.lower()) if isinstance(text, str) else ():
            got = WORD.findall(piece)
            words += got
            marks.append((i, len(got)))
            chars += len(piece)
            if chars >= PIECE:
                flush()
    flush()
    empty = np.empty(0, np.uint64)
    return [np.concatenate(x) if len(x) > 1 else x[0] if x else empty for x in out]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of every run of ``n`` words, in order.  A text of fewer words,
    but at least one, has one shingle: all its words."""
    if not len(words):
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = (h + words[i:i + m]) * MIX
        h ^= h >> np.uint64(29)
    return mix64(h + np.uint64(n))
