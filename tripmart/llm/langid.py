"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from the letter's code
point.  A trigram binds three letters: their vectors, rotated by 2, 1 and 0
places, are multiplied.  A text's vector bundles (adds) the vectors of all its
trigrams; a language's prototype bundles those of all its training texts.  The
prediction is the language whose prototype has the largest cosine with the text.

Letters are lower-cased; a run of anything else is one blank, which is a letter
of its own, and every text starts and ends with one.  Bundles are kept as trigram
counts until the end of a chunk of text, where one matrix product makes the
vectors.  The model is one vector for each language.

Defined results: a text that is null or has no letter is ``und`` with score 0,
as is every text if nothing could be learned.  Ties go to the first language by
name.  Training rows without text or language are left out.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripmart.llm.common import _pieces

DIM = 1024
CHUNK_CHARS, CHUNK_TEXTS, VOCAB = 1 << 19, 512, 2048
#: Texts whose vectors a task holds at one time.
SLICE_TEXTS = 1024
BLANK = 32
_letters: dict[int, np.ndarray] = {}


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _letter(code: int, seed: int) -> np.ndarray:
    if code not in _letters:
        if len(_letters) > 20_000:
            _letters.clear()
        _letters[code] = np.random.default_rng([seed, code]).choice(np.array([-1, 1], np.int8), DIM)
    return _letters[code]


def trigram_vectors(codes: np.ndarray, seed: int) -> np.ndarray:
    """(len(codes), DIM) float32 vectors of packed trigrams."""
    out = np.ones((len(codes), DIM), np.int8)
    for place in range(3):
        chars, at = np.unique((codes >> (21 * (2 - place))) & 0x1FFFFF, return_inverse=True)
        table = np.stack([np.roll(_letter(int(c), seed), 2 - place) for c in chars])
        out *= table[at]
    return out.astype(np.float32)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of all texts, and the text each belongs to."""
    padded = [f" {t} " for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    code = np.where(_is_letter()[code], code, BLANK).astype(np.int64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != BLANK) | (code[:-1] != BLANK) | (owner[1:] != owner[:-1])
    code, owner = code[keep], owner[keep]
    inside = owner[:-2] == owner[2:]
    return ((code[:-2] << 42) | (code[1:-1] << 21) | code[2:])[inside], owner[:-2][inside]


def bundle(texts: list[str], into: np.ndarray, size: int, seed: int) -> np.ndarray:
    """(size, DIM): the bundle of the texts that ``into`` sends to each row."""
    out = np.zeros((size, DIM))
    code, owner = _trigrams(texts)
    at, codes = pd.factorize(code)
    row = into[owner]
    for lo in range(0, len(codes), VOCAB):
        part = codes[lo:lo + VOCAB]
        n = len(part)
        here = (at >= lo) & (at < lo + n) if len(codes) > VOCAB else slice(None)
        counts = np.bincount(row[here] * n + (at[here] - lo), minlength=size * n).reshape(size, n)
        out += counts.astype(np.float32) @ trigram_vectors(part, seed)
    return out


def _chunks(texts):
    """Chunks of (pieces, their text's number); a piece ends between words."""
    pieces, owners, chars = [], [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text.lower()) if isinstance(text, str) else ():
            pieces.append(piece)
            owners.append(i)
            chars += len(piece)
            if chars >= CHUNK_CHARS or len(pieces) >= CHUNK_TEXTS:
                yield pieces, np.array(owners)
                pieces, owners, chars = [], [], 0
    if pieces:
        yield pieces, np.array(owners)


def text_vectors(texts, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The vector of every text, and whether it has a letter."""
    vectors, letters = np.zeros((len(texts), DIM)), np.zeros(len(texts), bool)
    for pieces, owners in _chunks(texts):
        at, rows = pd.factorize(owners)
        vectors[rows] += bundle(pieces, at, len(rows), seed)
        letters[owners] |= [any(map(str.isalpha, p)) for p in pieces]
    return vectors, letters


def fit(texts: DataFrame, text_col: str = "text", lang_col: str = "lang", seed: int = 3) -> dict[str, np.ndarray]:
    """One prototype for each language of the given rows: all of them are bundled,
    in tasks first.  Languages x DIM numbers reach the driver."""
    def learn(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            langs, names = pd.factorize(pdf["lang"])
            for pieces, owners in _chunks(pdf["text"].tolist()):
                got = bundle(pieces, langs[owners], len(names), seed)
                for name, v in zip(names, got, strict=True):
                    total[name] = total.get(name, 0) + v
        for name, v in total.items():
            yield pd.DataFrame({"lang": [name], "v": [v]})

    rows = (texts.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).dropna()
            .mapInPandas(learn, "lang string, v array<double>")
            .select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
            .select("lang", F.transform("v", lambda e: e["x"]).alias("v")).orderBy("lang").collect())
    out = {r["lang"]: np.array(r["v"]) for r in rows}
    return {k: v / np.sqrt(v @ v) for k, v in out.items() if v.any()}


def predict(model: dict[str, np.ndarray], seed: int = 3):
    """A column function: text -> struct(lang_pred string, score double)."""
    names = sorted(model)
    prototypes = np.stack([model[n] for n in names], 1) if names else np.zeros((DIM, 0))

    def name_slice(texts: list[str | None]) -> pd.DataFrame:
        vectors, letters = text_vectors(texts, seed)
        length = np.sqrt((vectors * vectors).sum(1))
        cosine = (vectors @ prototypes) / np.maximum(length, 1e-300)[:, None]
        best = cosine.argmax(1)
        return pd.DataFrame({
            "lang_pred": np.where(letters, np.array(names, object)[best], "und"),
            "score": np.where(letters, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)})

    @F.pandas_udf("lang_pred string, score double")
    def column(text: pd.Series) -> pd.DataFrame:
        if not names or not len(text):
            return pd.DataFrame({"lang_pred": ["und"] * len(text), "score": 0.0})
        return pd.concat([name_slice(text.iloc[lo:lo + SLICE_TEXTS].tolist())
                          for lo in range(0, len(text), SLICE_TEXTS)], ignore_index=True)
    return column


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             seed: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``lang_pred``, ``score``.
    Learns from the documents that have a language and aren't held out, that is
    whose crc32 of the id leaves a remainder other than 2; no id: held out."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(True))
    model = fit(docs.where(~held), seed=seed)
    return (docs.select("doc_id", held.alias("held_out"), predict(model, seed)("text").alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))
