"""Personal data: fixed patterns, and bootstrapped contextual extraction.

Four kinds have patterns of their own (email, ip, card, phone).  Their matches are
the seeds of a pattern-instance graph over the whole corpus.  An instance is an
identifier-like string (it has digits); a lexical pattern is the token just before
it, such as ``passport:`` or ``key=``.  In each round

* a pattern's confidence is the number of times it precedes a known instance, over
  the number of times the token occurs in the corpus at all, and its support the
  number of different known instances; at ``min_conf`` and ``min_support`` it is accepted;
* an instance is known if it is a seed or an accepted pattern precedes it somewhere.

Known instances of one round give other patterns support in the next, until a round
accepts no new pattern.  At the end
whatever identifier follows an accepted pattern is a span of kind ``id``, unless a
fixed pattern already covers part of it.

Identifiers and tokens have any length; those over ``PLAIN_CHARS`` stand in the graph by a 128-bit hash.

Defined results: null text is empty.  Positions are code points, the end exclusive.
Rows that repeat are scanned each by itself.  Very long texts are scanned whole, in time in
proportion to their length.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import _pieces, drop_stash, stash

KINDS = ("email", "ip", "card", "phone", "id")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't begin inside a run of digits whose beginning failed, so the look-behind changes nothing but the time
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
# identifier-like: 6 characters at least, of which 2 digits at least
INSTANCE = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9._@+/-]*[A-Za-z0-9])?")
# a context token: up to an inner '=' or ':', or a word with a free '=' or ':' after it
TOKEN = re.compile(r"\S*[=:](?=\S)|\S+(?:[ \t]+[=:](?=\s))?")
BLANK, INNER = re.compile(r"\s"), re.compile(r"[\s=:]")
#: Characters of a token or an identifier that is kept as it is.
PLAIN_CHARS = 80
#: Texts whose spans leave a task at one time; characters whose tokens are held as
#: strings; tokens counted before their counts leave.
OUT_TEXTS, TOKEN_CHARS, TOKENS = 1000, 1 << 19, 1 << 18


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every fixed-pattern match, in order."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in _emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


class _Name:
    """A lower-cased string built of parts: itself, or the hash of a long one."""

    def __init__(self):
        self.plain, self.size, self.state = "", 0, xxhash.xxh3_128()

    def add(self, part: str) -> _Name:
        # lower() writes a sigma by what follows it, so parts and wholes could differ
        part = part.lower().replace("\u03c2", "\u03c3")
        self.size += len(part)
        self.state.update(part.encode("utf-8", "surrogatepass"))
        if self.size <= PLAIN_CHARS:
            self.plain += part
        return self

    def key(self) -> str:
        return self.plain if self.size <= PLAIN_CHARS else "\0" + self.state.hexdigest()


def name_key(text: str) -> str:
    """How a token or an identifier stands in the graph."""
    return _Name().add(text).key() if len(text) > PLAIN_CHARS // 4 else text.lower().replace("\u03c2", "\u03c3")


class Contexts:
    """The token just before each of rising places of a text, as the corpus counts see it."""

    def __init__(self, text: str):
        self.text = text
        # what ends at a place: the run without blanks, and what it has after its last inner '=' or ':'
        self.ends = {BLANK: (0, _Name()), INNER: (0, _Name())}

    def _ending(self, start: int, limit: re.Pattern) -> str:
        """The text from the last ``limit`` to ``start``; what an earlier call read of it isn't read again."""
        upto, name = self.ends[limit]
        part = self.text[upto:start]
        found = max((m.end() for m in limit.finditer(part)), default=-1)
        if found >= 0:
            name, part = _Name(), part[found:]
        self.ends[limit] = start, name.add(part)
        return name.key()

    def before(self, start: int) -> str | None:
        text = self.text
        if start and text[start - 1] in "=:":
            return self._ending(start, BLANK)
        if start and not text[start - 1].isspace():
            return self._ending(start, INNER)
        end = start
        while end and text[end - 1].isspace():
            end -= 1
        if not end:
            return None
        # back over the last run, and the one before it if the last is a free '=' or ':'
        low = end - 1
        while low and not text[low - 1].isspace():
            low -= 1
            if end - low > PLAIN_CHARS and text[low] in "=:":      # the token begins after an inner one
                low += 1
                break
        if end - low == 1 and text[low] in "=:":
            while low and text[low - 1] in " \t":
                low -= 1
            while low and not text[low - 1].isspace():
                low -= 1
                if end - low > PLAIN_CHARS and text[low] in "=:":
                    low += 1
                    break
        found = TOKEN.findall(text[low:start] + " ")     # the blank stands for what follows
        return name_key(found[-1].replace("\t", " ")) if found else None


def candidates(text: str, base: list[tuple[int, int, int]]):
    """(start, end, context, instance, known) of the seeds and of the other identifiers."""
    out = [(s, e, True) for s, _, e in base]
    at = 0
    for d in DIGIT.finditer(text):
        if d.start() < at:
            continue
        # the whole run around this digit
        lo = d.start()
        while lo > at and text[lo - 1] not in " \n\t\r=:":
            lo -= 1
        for m in INSTANCE.finditer(text, lo):
            if m.start() > d.start():
                break
            if m.end() > d.start():
                s, e = m.start(), m.end()
                at = e
                if e - s >= 6 and len(DIGIT.findall(m[0])) >= 2 and not any(
                        bs < e and s < be for bs, _, be in base):
                    out.append((s, e, False))
                break
        at = max(at, d.end())
    contexts = Contexts(text)
    named = [(s, e, contexts.before(s), name_key(text[s:e]), known) for s, e, known in sorted(out)]
    return [c for c in named if c[2]]


def _token_counts(texts):
    """Counts of the texts' tokens, in dictionaries of about TOKENS at most; a token may be in several."""
    counts, chars, held = {}, 0, []

    def flush():
        codes, names = pd.factorize(np.array(held, dtype=object))
        for name, n in zip(names, np.bincount(codes, minlength=len(names)).tolist(), strict=True):
            name = name.replace("\t", " ")
            name = name if len(name) <= PLAIN_CHARS else name_key(name)
            counts[name] = counts.get(name, 0) + n

    for text in texts:
        for piece in _pieces(text) if isinstance(text, str) else ():
            held += TOKEN.findall(piece.lower().replace("\u03c2", "\u03c3"))
            chars += len(piece)
            if chars > TOKEN_CHARS:
                flush()
                chars, held = 0, []
                if len(counts) >= TOKENS:
                    yield counts
                    counts = {}
    flush()
    if counts:
        yield counts


def _scan(batches):
    """One row for each text, and one for each batch's count of each token."""
    fields = ["base", "found"]
    for pdf in batches:
        for lo in range(0, len(pdf), OUT_TEXTS):
            part = pdf.iloc[lo:lo + OUT_TEXTS]
            base = [base_spans(t if isinstance(t, str) else "") for t in part["text"]]
            found = [candidates(t, b) if isinstance(t, str) else []
                     for t, b in zip(part["text"], base, strict=True)]
            yield pd.DataFrame({
                "row": part["row"], "doc_id": part["doc_id"], "text_key": part["text_key"], "token": None,
                "n": None,
                fields[0]: [[{"start": s, "kind": k, "end": e} for s, k, e in b] for b in base],
                fields[1]: [[{"start": s, "end": e, "context": c, "instance": x, "known": y}
                             for s, e, c, x, y in f] for f in found]})
        for counts in _token_counts(pdf["text"]):
            none = pd.Series([None] * len(counts), dtype=object)
            yield pd.DataFrame({"row": none, "doc_id": none, "text_key": none, "token": list(counts),
                                "n": list(counts.values()), fields[0]: None, fields[1]: None})


# ids pass as text: pandas would make numbers with nulls inexact
SCAN = ("row long, doc_id string, text_key long, token string, n long, base array<struct<start:int,kind:int,end:int>>, "
        "found array<struct<start:int,end:int,context:string,instance:string,known:boolean>>")


def accepted_patterns(uses: DataFrame, tokens: DataFrame, min_conf: float, min_support: int, rounds: int) -> DataFrame:
    """``uses``: (context, instance, n, seed), one row per pair; ``tokens``: (token, n).
    Returns (context, conf) of the accepted patterns.  Accepted patterns and known instances
    only grow, so a round that adds no pattern is the last; fails if ``rounds`` don't reach it."""
    # summed first: the corpus has a token once in every batch, a context once
    totals = (tokens.groupBy("token").agg(F.sum("n").alias("total"))
              .join(uses.select(F.col("context").alias("token")).distinct(), "token", "left_semi"))
    uses = stash(uses.join(totals.withColumnRenamed("token", "context"), "context"), "pii-uses")
    known = uses.where("seed").select("instance").distinct()
    accepted, count, held = None, -1, None
    for _ in range(rounds):
        scored = (uses.join(known, "instance", "left_semi").groupBy("context")
                  .agg(F.sum("n").alias("hits"), F.count("*").alias("support"), F.max("total").alias("total"))
                  .select("context", "support", F.least(F.lit(1.0), F.col("hits") / F.col("total")).alias("conf"))
                  .where((F.col("conf") >= min_conf) & (F.col("support") >= min_support)))
        accepted = stash(scored.select("context", "conf"), "pii-patterns")
        if held is not None:
            drop_stash(held)
        held, now = accepted, accepted.count()
        if now == count:
            break
        count = now
        known = (uses.where("seed").select("instance")
                 .union(uses.join(accepted.select("context"), "context", "left_semi").select("instance")).distinct())
    else:
        raise RuntimeError(f"patterns did not settle in {rounds} rounds")
    return accepted


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_conf: float = 0.5,
         min_support: int = 3, rounds: int = 1000) -> DataFrame:
    """One row per document: ``row`` (a number of this scan's own), ``doc_id``, ``text_key`` (a
    hash of the text), ``base`` and ``spans``, each an array of struct(start, kind, end) by start, kind and end; kinds are numbers in KINDS."""
    scan = stash(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("doc_id"),
                             F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInPandas(_scan, SCAN), "pii-scan")
    rows = scan.where("row IS NOT NULL")
    found = rows.select("row", F.explode("found").alias("f")).select("row", "f.*")
    uses = found.groupBy("context", "instance").agg(F.count("*").alias("n"), F.bool_or("known").alias("seed"))
    patterns = accepted_patterns(uses, scan.where("token IS NOT NULL").select("token", "n"),
                                 min_conf, min_support, rounds)
    extra = (found.where("NOT known").join(patterns, "context", "left_semi").groupBy("row")
             .agg(F.collect_list(F.struct("start", F.lit(KINDS.index("id")).alias("kind"), "end")).alias("extra")))
    return (rows.select("row", "doc_id", "text_key", "base").join(extra, "row", "left")
            .select("row", F.col("doc_id").cast("long").alias("doc_id"), "text_key", "base", F.array_sort(F.concat(
                "base", F.coalesce("extra", F.expr("array()").cast("array<struct<start:int,kind:int,end:int>>"))))
                .alias("spans")))


def span_text(spans: F.Column) -> F.Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the fixed result, from what ``find`` returns."""
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS[:4]],
                        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        span_text(F.col("spans")).alias("spans"))


def _mask(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], f"<{KINDS[s['kind']].upper()}>"]
            at = s["end"]
        else:                       # overlaps the one before: hidden, too
            at = max(at, s["end"])
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The same rows and columns, with every span replaced by ``<KIND>``.

    Only the spans of rows that have any travel, by id and text hash; rows that share both
    share their spans.
    """
    found = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), **params)
    hits = (found.where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("_pii_id"), F.col("text_key").alias("_pii_key"))
            .agg(F.first("spans").alias("_pii_spans")))
    joined = docs.join(hits, F.col(id_col).cast("long").eqNullSafe(F.col("_pii_id"))
                       & (F.xxhash64(text_col) == F.col("_pii_key")), "left")

    @F.pandas_udf("string")
    def masked(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([_mask(t, s) for t, s in zip(text, spans, strict=True)], dtype=object)

    return joined.withColumn(text_col, masked(F.col(text_col), F.col("_pii_spans"))).select(*docs.columns)
