"""Benchmark decontamination: windows of benchmark words sought in every document.

1. Texts are lower-cased (A-Z only) and cut into words ``[0-9a-z]`` or non-ASCII.  Every run
   of ``window`` consecutive words of a benchmark item is a window; an item of fewer words, but
   at least one, is a single window of all its words.
2. The distinct windows, with their items, are a sorted array of hashes that is broadcast.  Its
   size is bounded: windows are dealt to blocks of at most ``block`` bytes, each broadcast
   for itself, so a benchmark of any size is searched whole.
3. Every document is scanned once a block, all its windows of each length at once; every hash
   that is found is verified word by word.  Words inside an occurrence are hit.

``scan`` gives spans of hit words and the items, ``digest`` their figures, ``remove`` the texts
without the hit documents or without the hit spans.

Defined results: null and empty texts have no words, no hits and no items.  Items that are null
or have no words are found nowhere; an item without an id is sought and hits words, but is not
counted among the items, and items that share an id count as one.  Repeated rows and rows without
an id are scanned as any other.  Texts of any length are read whole, in slices.  An empty benchmark
hits nothing.  Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import MIX, mix64, stash

WINDOW = 10
#: Bytes of one broadcast: the words of its windows and 64 for each.
BLOCK = 64 << 20
#: Bytes of text whose words are hashed at one time.
SLICE = 1 << 20
#: Bytes that are part of words: digits, letters (upper case is lowered first), all non-ASCII.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SCAN = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


class Words:
    """The words of one text: hashes, and byte offsets in the lowered text."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8").lower()        # bytes.lower() is A-Z only
        data = np.frombuffer(self.raw, np.uint8)
        inside = np.concatenate([[False], _IN_WORD[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.hashes = np.zeros(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SLICE, "right")))
            self.hashes[i:j] = _hash(data, self.starts[i:j], self.ends[i:j])
            i = j

    def windows(self, n: int) -> np.ndarray:
        """Hashes of all runs of ``n`` words."""
        m = len(self.hashes) - n + 1
        h = np.full(max(m, 0), n, np.uint64)
        for i in range(n if m > 0 else 0):
            h = (h + self.hashes[i:i + m]) * MIX
            h ^= h >> np.uint64(29)
        return mix64(h)

    def phrase(self, at: int, n: int) -> bytes:
        return b" ".join(self.raw[s:e] for s, e in zip(self.starts[at:at + n], self.ends[at:at + n], strict=True))


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: its bytes, weighed by powers of an odd number."""
    size = ends - starts
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max()), MIX))
    value = (data[within + np.repeat(starts, size)] + np.uint64(1)) * power[within]
    return mix64(np.add.reduceat(value, first) + size.astype(np.uint64))


class Windows:
    """Windows of one block: sorted hashes by length, words for the check, items."""

    def __init__(self, rows):
        by_n: dict[int, list] = {}
        for r in rows:
            by_n.setdefault(r["n"], []).append((np.int64(r["h"]).view(np.uint64), bytes(r["phrase"]), r["item"]))
        self.by_n = {}
        for n, found in sorted(by_n.items()):
            found.sort(key=lambda x: x[0])
            self.by_n[n] = (np.array([x[0] for x in found], np.uint64), [x[1] for x in found], [x[2] for x in found])

    def find(self, words: Words) -> tuple[list[tuple[int, int]], list[str]]:
        spans, items = [], set()
        for n, (hashes, phrases, ids) in self.by_n.items():
            got = words.windows(n)
            at = np.searchsorted(hashes, got)
            known: dict[bytes, bool] = {}
            for i in np.flatnonzero(hashes[np.minimum(at, len(hashes) - 1)] == got).tolist():
                phrase = words.phrase(i, n)
                if phrase not in known:
                    j = int(at[i])
                    last = int(np.searchsorted(hashes, got[i], "right"))
                    same = [k for k in range(j, last) if phrases[k] == phrase]
                    items.update(ids[k] for k in same if ids[k] is not None)
                    known[phrase] = bool(same)
                if known[phrase]:
                    spans.append((i, i + n))
        return _union(spans), sorted(items)


def _union(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """Every distinct window of every item: its number of words, hash, words (joined by blanks), item."""
    def run(batches):
        for pdf in batches:
            rows = []
            for item, text in zip(pdf["item"], pdf["text"], strict=True):
                words = Words(text)
                n = min(window, len(words.hashes))
                rows += [(n, h, words.phrase(i, n), item) for i, h in enumerate(
                    words.windows(n).view(np.int64).tolist() if n else ())]
            if rows:
                yield pd.DataFrame(rows, columns=["n", "h", "phrase", "item"])

    return (benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
            .where("text IS NOT NULL").mapInPandas(run, "n int, h long, phrase binary, item string")
            .distinct())


def _blocks(windows: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """``windows`` with the column ``_block``, and the number of blocks: dealt by hash to twice as
    many as the bytes need, and to more until none is above ``limit`` (or has one row only)."""
    size = F.length("phrase") + 64
    blocks = -(-(windows.agg(F.sum(size).cast("long")).first()[0] or 0) // limit)
    while True:
        n = 2 * blocks if blocks > 1 else 1
        dealt = windows.withColumn("_block", F.pmod(F.xxhash64("n", "h", "item"), F.lit(n)))
        most = dealt.groupBy("_block").agg(F.sum(size).alias("s"), F.count("*").alias("c")).where("c > 1").agg(F.max("s")).first()[0]
        if (most or 0) <= limit:
            return dealt, n
        blocks = 2 * max(blocks, 1)


def _scanner(spark, rows) -> Column:
    held = spark.sparkContext.broadcast(Windows(rows))

    @F.pandas_udf(_SCAN)
    def scan_texts(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words = Words(text)
            spans, items = held.value.find(words)
            out.append((len(words.hashes), [{"start": a, "end": b} for a, b in spans], items))
        return pd.DataFrame(out, columns=["n_words", "spans", "items"])
    return scan_texts


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block: int = BLOCK, out: str = "found") -> DataFrame:
    """``docs`` and a column ``out`` (in place of one of that name): words of the text, spans of hit
    words (from 0, end exclusive) and the ids, as text, of the items found."""
    spark = docs.sparkSession
    windows = stash(benchmark_windows(benchmark, item_id, item_text, window), "decontaminate-windows")
    dealt, blocks = _blocks(windows, block)
    if blocks == 1:
        return docs.withColumn(out, _scanner(spark, windows.collect())(F.col(text_col)))
    # beyond the bound: every block for itself, merged by the digest of the text they depend on
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), key.alias("doc_key"))
    texts = keyed.select(F.col("doc_key").alias("key"), "text")
    found = None
    for i in range(blocks):
        scanner = _scanner(spark, dealt.where(F.col("_block") == i).collect())
        got = (texts.withColumn("f", scanner("text")).where(F.size("f.spans") > 0)
               .select("key", "f.spans", "f.items").distinct())
        found = got if found is None else found.union(got)
    merged = found.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
                                      F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    @F.pandas_udf(_SCAN)
    def merge(texts: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(
            len(Words(t).hashes),
            [{"start": a, "end": b} for a, b in _union((x["start"], x["end"]) for x in s)] if s is not None else [],
            sorted(i) if i is not None else []) for t, s, i in zip(texts, spans, items, strict=True)],
            columns=["n_words", "spans", "items"])

    return (keyed.join(merged, F.col("doc_key") == F.col("key"), "left")
            .select(*[F.col("row")[c].alias(c) for c in docs.columns if c != out], merge("text", "spans", "items").alias(out)))


def digest(column: str = "found") -> list[Column]:
    """n_words, n_hit, n_items, items_sha256 and contaminated of a column made by ``scan``."""
    c = F.col(column)
    hit = F.aggregate(c["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return [c["n_words"].alias("n_words"), hit.alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
            F.sha2(F.concat_ws(",", c["items"]), 256).alias("items_sha256"), (hit > 0).alias("contaminated")]


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", spans: bool = False, **params) -> DataFrame:
    """``docs`` without the documents that hold a window, or, with ``spans``, without the words
    inside windows (and what stands between them)."""
    out = "_" + max(docs.columns, key=len)           # a name that no column has
    found = scan(docs, benchmark, text_col, out=out, **params)
    if not spans:
        return found.where(F.size(F.col(out)["spans"]) == 0).select(*docs.columns)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, hits: pd.Series) -> pd.Series:
        def one(text, hit):
            if text is None or not len(hit):
                return text
            words, raw = Words(text), text.encode("utf-8")
            out, at = [], 0
            for x in hit:
                out.append(raw[at:words.starts[x["start"]]])
                at = words.ends[x["end"] - 1]
            return b"".join([*out, raw[at:]]).decode("utf-8")
        return pd.Series([one(t, h) for t, h in zip(texts, hits, strict=True)], dtype=object)

    return found.withColumn(text_col, cut(F.col(text_col), F.col(out)["spans"])).select(*docs.columns)
