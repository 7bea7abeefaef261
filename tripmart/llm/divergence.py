"""Source divergence audit: how far the words of a source lie from those of other sources
of its language, and which terms set it apart.

1. ``mapInArrow``: texts are lowered (A-Z only) by ``ascii_lower``, cut by ``split_pattern_regex``,
   terms are dictionary-encoded and counted by a hash ``group_by``: rows (lang, source, term,
   occurrences, documents), merged in the task until they are many.
2. Spark sums these partial counts per (lang, source, term); a language keeps the terms that
   are in at least ``MIN_DOCS`` of its documents.
3. The kept counts are dealt by term to shards of about ``SHARD`` rows a language.  Each shard is
   cogrouped with its language's sources and totals, and gives, in whole numbers, its share of
   every pair's divergence and the value of its terms.
4. Shares are summed; values are ranked per (lang, source).

A probability is p = 1 + floor(SCALE * (count + 1) / (N + V)) with V kept terms of the language
and N occurrences of them; the value of a term is floor((p - q)^2 / q).

Defined results: null text, lang and source count as ''.  Rows that share an id, or have none, are
documents of their own; ids are not read.  Texts of any length are read whole, in slices of a batch
(a slice has at least one text).  A source without kept terms has N = 0; a language without kept terms
gives its pairs the value 0.  Equal values rank by item (UTF-8 order).  An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmart.llm.common import drop_stash, stash

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Runs of characters that are not part of terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text split at one time; rows of partial counts a task merges at one time; rows of a shard.
SLICE, HELD, SHARD = 4 << 20, 400_000, 100_000
_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()),
                      ("n", pa.int64()), ("docs", pa.int64())])


def _slices(batch: pa.RecordBatch):
    """Runs of rows of at most about SLICE bytes of text, at least one row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


def _count(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of every (lang, source, term) of the rows, and a row with the
    term '' for every (lang, source)."""
    lang, source, text = (pc.fill_null(batch.column(c), "") for c in ("lang", "source", "text"))
    split = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    row, term = pc.list_parent_indices(split), pc.list_flatten(split)
    held = pc.not_equal(term, "")
    coded = pc.dictionary_encode(pc.filter(term, held))
    one = pa.table({"row": pc.filter(row, held), "code": coded.indices}).group_by(["row", "code"]).aggregate(
        [("code", "count")])
    counts = pa.table({"lang": lang.take(one["row"]), "source": source.take(one["row"]), "code": one["code"],
                       "n": one["code_count"]}).group_by(["lang", "source", "code"]).aggregate([("n", "sum"), ("n", "count")])
    terms = pa.table([counts["lang"], counts["source"], pc.take(coded.dictionary, counts["code"]),
                      counts["n_sum"], counts["n_count"]], names=_PARTIAL.names).cast(_PARTIAL)
    groups = pa.table({"lang": lang, "source": source}).group_by(["lang", "source"]).aggregate([])
    none, zero = pa.repeat("", len(groups)), pa.repeat(0, len(groups))
    return pa.concat_tables([terms, pa.table([groups["lang"], groups["source"], none, zero, zero],
                                             names=_PARTIAL.names).cast(_PARTIAL)])


def _merge(tables: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return got.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_PARTIAL.names)


def _partial_counts(batches):
    held, n = [], 0
    for batch in batches:
        for rows in _slices(batch):
            held.append(_count(rows))
            n += len(held[-1])
            if n > HELD:
                held = [_merge(held)]
                n = len(held[0])
                if n > HELD // 2:
                    yield from held[0].to_batches(max_chunksize=10_000)
                    held, n = [], 0
    if held:
        yield from _merge(held).to_batches(max_chunksize=10_000)


def counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Occurrences and documents of every (lang, source, term), and one row with the term '' for
    every (lang, source)."""
    part = (docs.select(F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
                        F.col(text).cast("string").alias("text"))
            .mapInArrow(_partial_counts, "lang string, source string, term string, n long, docs long"))
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / total), exact in 64 bits: SCALE is taken in three steps
    of a thousand, so ``total`` may be up to 9 * 10^15."""
    over = count + 1
    out, rest = over // total, over % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


_VALUES = "lang string, source string, part string, item string, value long"


def _shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """One shard of a language: ``left`` has (source, term, n), ``right`` one row with the names
    and totals of all the language's sources and with V."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()),
                        ("value", pa.int64())])
    if not len(left) or not len(right):
        return schema.empty_table()
    lang, v = right["lang"][0].as_py(), right["v"][0].as_py()
    names = pa.array(right["sources"][0].as_py(), pa.string())
    totals = np.array(right["totals"][0].as_py(), np.int64)
    at = pc.index_in(left["source"].combine_chunks(), names).to_numpy()
    coded = left["term"].combine_chunks().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy()
    n = left["n"].to_numpy()
    all_ = np.zeros(len(terms), np.int64)
    np.add.at(all_, code, n)
    q = _share(all_, np.int64(totals.sum() + v))
    pairs = np.zeros((len(names), len(names)), np.int64)
    step = max(1, 500_000 // len(names))            # cells of a block of terms
    for lo in range(0, len(terms), step):
        some = np.flatnonzero((code >= lo) & (code < lo + step))
        c = np.zeros((len(names), min(step, len(terms) - lo)), np.int64)
        c[at[some], code[some] - lo] = n[some]
        p = _share(c, (totals + v)[:, None])
        for i in range(len(names)):
            pairs[i] += _gap(p[i], p).sum(axis=1)
    own = _share(n, totals[at] + v)
    up = np.flatnonzero((n > 0) & (own > q[code]))
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    source = pa.concat_arrays([names.take(pa.array(a)), names.take(pa.array(at[up]))])
    item = pa.concat_arrays([names.take(pa.array(b)), terms.take(pa.array(code[up]))])
    part = pa.array(["pair"] * len(a) + ["term"] * len(up), pa.string())
    value = pa.array(np.concatenate([pairs[a, b], _gap(own[up], q[code[up]])]), pa.int64())
    return pa.table([pa.repeat(pa.scalar(lang, pa.string()), len(source)), source, part, item, value], schema=schema)


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
          min_docs: int = MIN_DOCS, top: int = TOP, shard: int = SHARD) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has every other source of the language,
    part ``term`` the ``top`` terms that the source uses more than its language."""
    all_counts = stash(counts(docs, lang, source, text), "divergence-counts")
    common = (all_counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("d"))
              .where(F.col("d") >= min_docs).select("lang", "term"))
    kept = stash(all_counts.where("term <> ''").join(common, ["lang", "term"], "left_semi")
                 .select("lang", "source", "term", "n"), "divergence-kept")
    shards = max(1, -(-kept.count() // shard))
    total = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    v = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("v"))
    groups = all_counts.where("term = ''").select("lang", "source").join(total, ["lang", "source"], "left")
    # one row a language: its sources, as many as the result has pairs for
    listed = (groups.groupBy("lang").agg(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))).alias("g"))
              .join(v, "lang", "left")
              .select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"),
                      F.coalesce("v", F.lit(0)).alias("v")))
    listed = stash(listed, "divergence-sources")
    left = kept.withColumn("shard", F.pmod(F.xxhash64("term"), F.lit(shards)))
    right = listed.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    values = stash(left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard"))
                   .applyInArrow(_shard, _VALUES), "divergence-values")
    drop_stash(all_counts)
    # languages without kept terms have pairs, too
    zero = (listed.select("lang", F.explode("sources").alias("source"), "sources")
            .select("lang", "source", F.explode("sources").alias("item")).where("source <> item")
            .select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value")))
    pairs = (values.where("part = 'pair'").union(zero).groupBy("lang", "source", "part", "item")
             .agg(F.sum("value").alias("value")))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = values.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).union(terms)
