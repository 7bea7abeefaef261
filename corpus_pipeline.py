"""A training-corpus pipeline over the table ``documents``, in five stages.

1. language: documents that language ID rejects go.  Rejected is a text without a letter,
   and one of at least ``MIN_LETTERS`` letters that is like no language learned (its best
   cosine is under ``MIN_SCORE``).
2. near_duplicates: of each class of copies and near copies (five-word shingles, Jaccard
   similarity of 0.8) the document with the smallest id stays.
3. pii: every span of personal data is replaced by its kind.
4. mixture: every document stays as often as the mix of its source takes it.
5. pieces: the documents' piece ids.

Each stage works on all that the one before it kept, is written as Parquet to the shared
folder and read again.  All but the last return the columns of ``documents``.  No stage
has an equivalent in plain SQL as a whole; tests hold them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.llm import langid, mixing, ngram_jaccard, pieces, pii
from tripmart.llm.common import stash, table
from tripmart.llm.merkle import numbered
from tripmart.llm.queries import MODEL

MIN_LETTERS, MIN_SCORE = 200, 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs)
    named = docs.withColumn("_lang", langid.predict(model)("text"))
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    return named.where((F.col("_lang.lang_pred") != "und")
                       & ((F.col("_lang.score") >= MIN_SCORE) | (letters < MIN_LETTERS))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without an id take no part and stay.  Rows that share id and text are one document (the
    first by the other columns stays); rows that share an id only are documents of their own."""
    cols = docs.columns
    given, unnamed = docs.where("doc_id IS NOT NULL"), docs.where("doc_id IS NULL")
    repeated = stash(given.groupBy(F.col("doc_id").alias("_dup_id")).count().where("count > 1").select("_dup_id"),
                     "pipeline-repeated")
    if repeated.isEmpty():
        kept = ngram_jaccard.join(given).where("kept").select(F.col("doc_id").alias("_dup_id"))
        return given.join(kept, given["doc_id"] == kept["_dup_id"], "left_semi").union(unnamed)
    of_repeated = given["doc_id"] == repeated["_dup_id"]
    single = _own_ids(given, given.join(repeated, of_repeated, "left_semi")).union(
        given.join(repeated, of_repeated, "left_anti").withColumn("_dup_own", F.col("doc_id").cast("long")))
    ids = single.select(F.col("_dup_own").alias("_dup_id"), F.col("doc_id").cast("long").alias("_dup_doc"))
    classes = ngram_jaccard.join(single, id_col="_dup_own").select("doc_id", "class_id")
    kept = (classes.join(ids, classes["doc_id"] == ids["_dup_id"]).groupBy("class_id")
            .agg(F.min(F.struct("_dup_doc", "_dup_id")).alias("_dup_first")).select("_dup_first._dup_id"))
    return single.join(kept, single["_dup_own"] == kept["_dup_id"], "left_semi").select(*cols).union(unnamed)


def _own_ids(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each id and text of ``rows``, with ``_dup_own``: numbers that are no id of ``docs``."""
    cols = rows.columns
    # grouped minima, so rows of one id and text are reduced before the shuffle
    once = (rows.groupBy(F.col("doc_id").alias("_dup_id"), F.sha2(F.col("text").cast("binary"), 256).alias("_dup_text"))
            .agg(F.min(F.struct(*cols)).alias("_dup_row")).select("_dup_row.*", "_dup_text"))
    once = numbered(once.withColumn("_dup_tree", F.lit("")), "_dup_tree", ["doc_id", "_dup_text"], "pipeline-once")
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    n = once.count()
    if high + n < 1 << 63:
        first = high + 1
    elif low - n >= -(1 << 63):
        first = low - n
    else:
        raise ValueError(f"no room for {n} numbers beside the ids {low} to {high}")
    return once.select(*cols, (F.col("pos") + F.lit(first).cast("long")).alias("_dup_own"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(MODEL)
    return (docs.select("doc_id", "lang", "source", pieces.encoder(vocabulary)("text").alias("p"))
            .select("doc_id", "lang", "source", "p.ids", F.size("p.ids").alias("n_ids")))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("pii", personal_data),
          ("mixture", mixture), ("pieces", piece_ids)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
