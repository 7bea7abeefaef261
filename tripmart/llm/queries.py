"""Registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripmart.llm import (
    decontaminate,
    divergence,
    embed_dedup,
    langid,
    merkle,
    mixing,
    ngram_jaccard,
    pieces,
    pii,
    substring,
    topk,
    url_filter,
    warc,
)
from tripmart.llm.common import table

#: The public 32,000-piece model; read by the driver only.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and number of linked texts of every document."""
    return ngram_jaccard.join(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mixture of the sources takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors of every hundredth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat across documents."""
    return substring.find(table(spark, sf_dir, "documents"))


def op5_pstable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-equal vectors of a label."""
    return embed_dedup.dedup(table(spark, sf_dir, "embeddings"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether they decode to its text."""
    vocabulary = pieces.Vocabulary.load(MODEL)
    return (table(spark, sf_dir, "documents").select("doc_id", pieces.encoder(vocabulary)("text").alias("p"))
            .select("doc_id", "p.ids", F.size("p.ids").alias("n_ids"), F.coalesce("p.exact", F.lit(True)).alias("exact")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, as read back from the archives."""
    return warc.archive(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, checked against a table with changed texts."""
    return merkle.dataset(table(spark, sf_dir, "documents"), **merkle.lowered_third())


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of the sources of a language, and the terms that set them apart."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of the benchmark, and the items they come from."""
    found = decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *decontaminate.digest())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline, all its stages."""
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_ngram_jaccard, op2_mix_sources, op3_exact_topk, op4_compact_windows, op5_pstable_dedup,
    op6_sentencepiece, op7_pii, op8_url_filter, op9_langid, op10_warc, op11_merkle_manifest, op12_source_divergence, op13_decontaminate, pipeline)}

# Brute force: all shingles, every pair that shares one.
_OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY s)) AS h FROM shingles GROUP BY 1),
texts AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, h) AS text_id FROM sizes),
rep AS (SELECT s.doc_id, s.s, t.n FROM shingles s JOIN texts t ON s.doc_id = t.doc_id AND t.text_id = t.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM rep a JOIN rep b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.8),
reach AS (SELECT a AS node, a AS other FROM pairs UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a),
classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY 1),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1)
SELECT d.doc_id, coalesce(c.class_id, t.text_id, d.doc_id) AS class_id, coalesce(t.text_id, d.doc_id) AS text_id,
  coalesce(l.n, 0) AS n_links, coalesce(c.class_id, t.text_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN texts t ON d.doc_id = t.doc_id LEFT JOIN classes c ON c.node = t.text_id
LEFT JOIN links l ON l.a = t.text_id
"""

_OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT)
  AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP5 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT a AS node, a AS other FROM pairs UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON r.other = p.a),
comp AS (SELECT node, min(other) AS c FROM reach GROUP BY 1),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY 1)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, coalesce(c.c, e.vec_id) AS component_id,
  coalesce(c.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp c ON e.vec_id = c.node LEFT JOIN links l ON e.vec_id = l.a
"""

_OP10 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM t
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op11(levels: int = 10, top_levels: int = 4) -> str:
    """Trees of up to 8^levels rows and 8^top_levels languages, level by level."""
    def field(c):
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"

    def leaf(text):
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name, depth):
        """Levels name0, name1, ... of (g, pos, n, digest), and what is beside each node."""
        out = []
        for k in range(depth):
            out.append(f"""{name}{k + 1} AS (SELECT g, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1
  THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE min(digest) END AS digest FROM {name}{k} GROUP BY g, pos // 8, n)""")
            out.append(f"""{name}b{k} AS (SELECT a.g, a.pos, a.n,
  coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
  coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.pos // 8 = b.pos // 8 GROUP BY a.g, a.pos, a.n)""")
        return out

    def climb(path, name, depth):
        return [f"""{path}{k + 1} AS (SELECT p.* REPLACE (p.pos // 8 AS pos, p.sibs || b.l || b.r AS sibs,
  CASE WHEN b.n > 1 THEN sha256(b.l || p.fold || b.r) ELSE p.fold END AS fold)
  FROM {path}{k} p JOIN {name}b{k} b ON p.g = b.g AND p.pos = b.pos)""" for k in range(depth)]

    text = _LOWER.format("text")
    parts = [
        # crc32 by its table of 256 remainders
        """t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)""",
        f"""d AS (SELECT *, row_number() OVER () AS rid, {leaf("text")} AS leaf, {leaf(text)} AS changed,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
    lambda x: CAST(ascii(x) AS BIGINT))), lambda c, x: xor(t[CAST(xor(c, x) % 256 AS INTEGER) + 1], c // 256)), 4294967295) AS crc
  FROM (SELECT doc_id, source, lang, n_chars, text FROM documents), t)""",
        """a AS (SELECT rid, doc_id, leaf, CASE WHEN crc % 3 = 0 THEN changed ELSE leaf END AS fold, coalesce('+' || lang, '*') AS g,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d)""",
        "x0 AS (SELECT g, pos, n, leaf AS digest FROM a)", *tree("x", levels),
        f"s AS (SELECT g AS name, digest, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM x{levels})",
        "y0 AS (SELECT '' AS g, pos, n, digest FROM s)", *tree("y", top_levels),
        "p0 AS (SELECT rid, doc_id, leaf, g, pos, fold, '' AS sibs FROM a)", *climb("p", "x", levels),
        f"""q0 AS (SELECT p.rid, p.doc_id, p.leaf, s.digest AS subroot, '' AS g, s.pos, p.fold, p.sibs FROM p{levels} p
  JOIN s ON p.g = s.name)""", *climb("q", "y", top_levels)]
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, r.digest AS root, sha256(sibs) AS proof_sha256, fold AS folded_root, fold = r.digest AS verified
FROM q{top_levels} q JOIN y{top_levels} r ON q.g = r.g"""


_OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
tok AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g
  LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
  1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 1) // CAST(g.n + v.v AS HUGEINT) AS p
  FROM g JOIN kept k USING (lang) JOIN v USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL), ln AS (SELECT lang, sum(c) AS n FROM l GROUP BY 1),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * CAST(l.c + 1 AS HUGEINT) // CAST(ln.n + v.v AS HUGEINT) AS q
  FROM l JOIN ln USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term WHERE x.term IS NULL OR y.term IS NOT NULL
  GROUP BY ALL),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p.p - q.q) * (p.p - q.q) // q.q AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r
WHERE part = 'pair' OR rank <= 200
"""

_WORDS = _LOWER.format("coalesce(text, '')")
_OP13 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_WORDS}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2),
  lambda j: array_to_string(w[j:j + least(10, len(w)) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id,
  regexp_extract_all({_WORDS}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
dw AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS b, w FROM d, (SELECT DISTINCT n FROM win)),
hit AS (SELECT dw.rid, dw.b, dw.n, win.item FROM (SELECT rid, n, b, array_to_string(w[b:b + n - 1], ' ') AS s FROM dw) dw
  JOIN win ON dw.n = win.n AND dw.s = win.s),
words AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(b, b + n)) AS pos FROM hit) GROUP BY 1),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT rid, item FROM hit WHERE item IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.s, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

ORACLE_SQL = {
    "op1_ngram_jaccard": _OP1, "op3_exact_topk": _OP3, "op5_pstable_dedup": _OP5, "op10_warc": _OP10,
    "op11_merkle_manifest": _op11(), "op12_source_divergence": _OP12, "op13_decontaminate": _OP13}
