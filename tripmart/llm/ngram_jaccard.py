"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts link when the Jaccard similarity of their sets of five-word shingles
is at least 0.8.  Steps:

1. Each text becomes a set of 64-bit shingle hashes.  Documents with equal sets
   are copies; only the one with the smallest id goes on.
2. 160 MinHash values per set, read as 32 bands of 5, put texts in buckets
   (a pair at 0.8 shares no bucket with probability 3e-6).  The members of a
   bucket point to its smallest id; connected components of these edges are the
   candidate groups, so a pair is looked at once, however many buckets it shares.
3. A group is cut into blocks of about 256 texts and each pair of blocks is one
   unit of work.  Within it MinHash values are compared 32 at a time.  With a
   uniform prior, m matches of n leave a Beta(m+1, n-m+1) posterior; pairs whose
   posterior probability of reaching the threshold is under ``tolerance`` go.
4. The pairs left are verified on the whole shingle sets.
5. A unit returns, for each text, its number of links and the smallest id of its
   component inside the unit, never the pairs.  Components of those edges give
   the classes.

Defined results: a text that is null, empty or without words links with nothing
and is its own class.  A text of one to four words has one shingle, all its
words.  Rows that share an id are one document.  Rows without an id come back
with null class and text ids, no links, and are kept.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import components, mix64, shingle_hashes, stash, stream_groups, word_hashes

BANDS, ROWS = 32, 5
N_HASHES = BANDS * ROWS
STEP = 32
BLOCK_DOCS = 256
BLOCK_BYTES = 32 << 20
_rng = np.random.default_rng(20240501)
_MUL = (_rng.integers(0, 1 << 31, N_HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, N_HASHES, np.uint32)


def shingle_sets(texts, n: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(shingle_hashes(w, n)) for w in word_hashes(texts)]


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), N_HASHES) uint32; rows of empty sets hold the maximum."""
    out = np.full((len(sets), N_HASHES), np.iinfo(np.uint32).max, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        run, size = [], 0
        while at < len(full) and (not run or size + len(sets[full[at]]) <= 1 << 16):
            run.append(full[at])
            size += len(sets[full[at]])
            at += 1
        x = (np.concatenate([sets[i] for i in run]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(sets[i]) for i in run[:-1]])
        y = np.empty_like(x)
        for k in range(N_HASHES):
            np.multiply(x, _MUL[k], out=y)
            np.add(y, _ADD[k], out=y)
            out[run, k] = np.minimum.reduceat(y, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) int64 keys; a key names its band and the band's values."""
    h = np.zeros((len(sig), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        h = mix64(h ^ sig[:, r::ROWS].astype(np.uint64)) + np.uint64(r)
    return h.view(np.int64)


def needed_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """For n = STEP, 2 STEP, ...: the fewest matches of n that leave a posterior
    probability of at least ``tolerance`` that the similarity reaches ``threshold``.
    P(s >= t | m of n) = P(Binomial(n + 1, t) <= m) under the uniform prior."""
    out = []
    for n in range(STEP, N_HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a[i], b[i])."""
    if len(a) <= 64:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                         for i, j in zip(a, b, strict=True)], np.int64)
    used = np.unique(np.concatenate([a, b]))
    owner = np.repeat(np.arange(len(used)), [len(sets[i]) for i in used])
    _, col, freq = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
    shared = freq[col] > 1
    owner, col = owner[shared], col[shared]
    col = np.unique(col, return_inverse=True)[1]
    by_col = np.argsort(col, kind="stable")
    owner, col = owner[by_col], col[by_col]
    both = np.zeros((len(used), len(used)), np.float64)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        s, e = np.searchsorted(col, [lo, lo + 4096])
        m = np.zeros((len(used), 4096), np.float32)
        m[owner[s:e], col[s:e] - lo] = 1
        both += m @ m.T
    return both[np.searchsorted(used, a), np.searchsorted(used, b)].round().astype(np.int64)


def linked_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None,
                 threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between the sets numbered ``left`` and ``right`` (None: within ``left``)."""
    if right is None:
        i, j = np.triu_indices(len(left), 1)
        a, b = left[i], left[j]
    else:
        a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    size = np.array([len(s) for s in sets], np.int64)
    near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
    a, b = a[near], b[near]
    sig = minhashes(sets)
    matches = np.zeros(len(a), np.int64)
    for n, least in needed_matches(threshold, tolerance):
        matches += (sig[a, n - STEP:n] == sig[b, n - STEP:n]).sum(1)
        alive = matches >= least
        a, b, matches = a[alive], b[alive], matches[alive]
    if not len(a):
        return a, b
    both = _intersections(sets, a, b)
    ok = both / (size[a] + size[b] - both) >= threshold
    return a[ok], b[ok]


def _unit(threshold: float, tolerance: float, n: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame | None:
        pdf = pdf.drop_duplicates("doc_id")
        ids = pdf["doc_id"].to_numpy()
        sets = shingle_sets(pdf["text"].tolist(), n)
        i, j, block = pdf["i"].iloc[0], pdf["j"].iloc[0], pdf["block"].to_numpy()
        a, b = linked_pairs(sets, np.flatnonzero(block == i),
                            None if i == j else np.flatnonzero(block == j), threshold, tolerance)
        if not len(a):
            return None
        links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        low = ids.copy()
        while True:
            old = low.copy()
            np.minimum.at(low, a, old[b])
            np.minimum.at(low, b, old[a])
            if (old == low).all():
                break
        hit = links > 0
        return pd.DataFrame({"doc_id": ids[hit], "links": links[hit], "low": low[hit]})
    return work


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
         shingle: int = 5, tolerance: float = 1e-6) -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id`` (smallest id of the documents
    reachable by links and copies), ``text_id`` (smallest id with the same shingle set),
    ``n_links`` (different texts linked directly), ``kept`` (doc_id = class_id)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    @F.pandas_udf("set_key binary, bands array<bigint>")
    def features(text: pd.Series) -> pd.DataFrame:
        import xxhash
        sets = shingle_sets(text.tolist(), shingle)
        keys = list(band_keys(minhashes(sets)))
        return pd.DataFrame({
            "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "bands": [k if len(s) else None for s, k in zip(sets, keys, strict=True)]})

    feats = stash(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"),
                              features("text").alias("f")).select("doc_id", "bytes", "f.*"), "jaccard-features")
    whole = feats.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = whole.groupBy("set_key").agg(F.min("doc_id").alias("text_id"), F.min_by("bands", "doc_id").alias("bands"),
                                        F.min_by("bytes", "doc_id").alias("bytes"))
    slots = reps.select("text_id", F.explode("bands").alias("key"))
    shared = (slots.groupBy("key").agg(F.min("text_id").alias("root"), F.max("text_id").alias("last"))
              .where("root < last").select("key", "root"))
    edges = slots.join(shared, "key").where("text_id <> root").select("text_id", "root").distinct()
    groups = components(edges.toDF("a", "b"))

    # blocks of a group, and each pair of blocks
    sized = groups.join(reps.select("text_id", "bytes"), groups["node"] == F.col("text_id")) \
        .select("text_id", "component", "bytes")
    cuts = sized.groupBy("component").agg(F.greatest(
        F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    cut = (sized.join(cuts, "component")
           .select("component", "blocks", F.col("text_id").alias("doc_id"),
                   F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int").alias("block")))
    units = (cut.join(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), "doc_id")
             .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                     "block", "doc_id", "text"))
    links = stash(stream_groups(units, ["component", "i", "j"], _unit(threshold, tolerance, shingle),
                                "doc_id long, links long, low long"), "jaccard-links")
    n_links = links.groupBy("doc_id").agg(F.sum("links").alias("n_links")).withColumnRenamed("doc_id", "text_id")
    classes = components(links.select("doc_id", "low").toDF("a", "b")).toDF("text_id", "component")

    texts = reps.select("set_key", "text_id")
    named = texts.join(n_links, "text_id", "left").join(classes, "text_id", "left")
    return (feats.select("doc_id", "set_key").join(named, "set_key", "left")
            .select("doc_id", "text_id", "n_links", "component")
            .select("doc_id",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "text_id", "doc_id")).alias("class_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("text_id", "doc_id")).alias("text_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0))
                    .cast("long").alias("n_links"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True))))
