"""Merkle dataset manifest: a digest for every row, folded to one root, with a proof a row.

H is sha256 in lower-case hex; digests are concatenated as hex text.

1. A row's leaf is H of its fields.  The leaves of a tree (one a language) are put in order by a
   range partitioning and numbered from the counts of the partitions, never in one task.
2. Every eight consecutive nodes become one, until one is left.  A superblock of 8^4 nodes is
   reduced by one call of ``applyInPandas``; its nodes are the input of the next round, so a tree
   of n leaves takes log(n) / log(4096) rounds.
3. The subroots, in order of their language, are the leaves of the top tree.
4. Downwards, the nodes of each round and the required outer nodes (what lies beside the path from
   the superblock to the root) are cogrouped by superblock: ``applyInPandas`` reduces the block again,
   joins its siblings with the outer ones to proofs, and folds each row's leaf to a root.

A group is at most 4,096 nodes, whatever the size of a tree.

Defined results: a null field is ``-``.  Rows without an id come first in their tree; rows that share
an id are ordered by their leaf, and equal rows are leaves of their own (which of them stands first
makes no difference).  A null language is a tree of its own, the first.  A tree of one row has its
leaf as subroot, and a row without siblings the proof H(''). Texts of any length are hashed whole.  An
empty table gives no rows.  Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tripmart.llm.common import stash

ARITY, LEVELS = 8, 4
BLOCK = ARITY ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(*values: Column) -> Column:
    """H of the values in order: ``-`` for null, else byte count, ``:`` and value."""
    def one(v):
        v = v.cast("string")
        return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[one(v) for v in values]), 256)


def _h(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def reduce_block(nodes: list[str], alone: bool) -> tuple[list[list[str]], str]:
    """The levels of a superblock and the node above them.  One that is ``alone`` in its tree ends
    as soon as one node is left; others have all LEVELS levels, as their neighbours do."""
    levels = []
    while len(nodes) > 1 or (not alone and len(levels) < LEVELS):
        levels.append(nodes)
        nodes = [_h("".join(nodes[i:i + ARITY])) for i in range(0, len(nodes), ARITY)]
    return levels, nodes[0]


def beside(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """For each level the siblings before and after the path of node ``at``."""
    out = []
    for nodes in levels:
        first = at - at % ARITY
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + ARITY])))
        at //= ARITY
    return out


def fold(digest: str, path) -> str:
    for before, after in path:
        digest = _h(before + digest + after)
    return digest


# ---------------------------------------------------------------- positions

def numbered(rows: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, in ``order`` within ``tree``) and ``n``, the size of the tree."""
    # the last key spreads rows that are equal in all others over the partitions
    sorted_ = (rows.withColumn("_tie", F.monotonically_increasing_id())
               .repartitionByRange(tree, *order, "_tie").sortWithinPartitions(tree, *order, "_tie")
               .drop("_tie").withColumn("_seq", F.monotonically_increasing_id()))
    held = stash(sorted_, name)                     # the ids are those written
    part = F.shiftright("_seq", 33)
    # one row for each partition and tree in it; offsets are sums over the partitions before
    parts = held.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(
        F.count("*").alias("c"), F.min("_seq").alias("first"))
    w = W.partitionBy("_tree")
    before = F.coalesce(F.sum("c").over(w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_tree", "_part", (before - F.col("first")).alias("_offset"), F.sum("c").over(w).alias("n"))
    return (held.join(parts, F.col(tree).eqNullSafe(F.col("_tree")) & (part == F.col("_part")))
            .withColumn("pos", F.col("_seq") + F.col("_offset")).drop("_seq", "_tree", "_part", "_offset"))


# ---------------------------------------------------------------- rounds

_NODE = "tree string, pos long, n long, digest string"
_PATH = "array<struct<before: string, after: string>>"


def _up(nodes: DataFrame) -> DataFrame:
    """The nodes above the superblocks of ``nodes`` (tree, pos, n, digest)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n = int(pdf["n"].iloc[0])
        _, top = reduce_block(pdf["digest"].tolist(), n <= BLOCK)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "pos": [int(pdf["pos"].iloc[0]) // BLOCK],
                             "n": [-(-n // BLOCK)], "digest": [top]})
    return (nodes.withColumn("_block", F.floor(F.col("pos") / BLOCK)).groupBy("tree", "_block").applyInPandas(run, _NODE))


def _down(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """tree, pos, path and root of ``nodes`` from those of the nodes above them."""
    def run(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        levels, _ = reduce_block(pdf["digest"].tolist(), int(pdf["n"].iloc[0]) <= BLOCK)
        rest = [{"before": x["before"], "after": x["after"]} for x in above["path"].iloc[0]]
        path = [[{"before": a, "after": b} for a, b in beside(levels, i)] + rest for i in range(len(pdf))]
        return pd.DataFrame({"tree": pdf["tree"], "pos": pdf["pos"], "path": path, "subroot": above["subroot"].iloc[0],
                             "root": above["root"].iloc[0]})
    return _cogroup(nodes, outer, run, f"tree string, pos long, path {_PATH}, subroot string, root string")


def _cogroup(nodes: DataFrame, outer: DataFrame, run, schema: str) -> DataFrame:
    a = nodes.withColumn("_block", F.floor(F.col("pos") / BLOCK))
    b = outer.withColumn("_block", F.col("pos"))
    return a.groupBy("tree", "_block").cogroup(b.groupBy("tree", "_block")).applyInPandas(run, schema)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the rounds above them, up to one node a tree."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(stash(_up(out[-1]), "merkle-nodes"))
    return out


_PROVEN = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean")


def _prove(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """The last round: local reduction, joining of proofs, folding."""
    pdf = pdf.sort_values("pos")
    digests = pdf["digest"].tolist()
    levels, _ = reduce_block(digests, int(pdf["n"].iloc[0]) <= BLOCK)
    outer = [(x["before"], x["after"]) for x in above["path"].iloc[0]]
    tail = "".join(a + b for a, b in outer)
    subroot, root = above["subroot"].iloc[0], above["root"].iloc[0]
    known: dict[str, str] = {}                      # what the outer path makes of a superblock's node
    proof, folded = [], []
    for i, (digest, changed) in enumerate(zip(digests, pdf["tampered"], strict=True)):
        path = beside(levels, i)
        proof.append(_h("".join(a + b for a, b in path) + tail))
        top = fold(changed if changed is not None else digest, path)
        if top not in known:
            known[top] = fold(top, outer)
        folded.append(known[top])
    return pd.DataFrame({"doc_id": pdf["doc_id"], "leaf": digests, "subroot": subroot, "root": root, "proof_sha256": proof,
                         "folded_root": folded, "verified": np.array(folded, object) == root})


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``leaves``
    (doc_id, tree, leaf, tampered): the leaf is folded by its proof, or the tampered one where it is
    not null, and is verified if that gives the root."""
    # the null tree is '*', others begin with '+', which comes after it
    tree = F.coalesce(F.concat(F.lit("+"), F.col("tree")), F.lit("*"))
    # written first: range partitioning reads its input twice, and texts are to be hashed once
    rows = stash(leaves.select("doc_id", tree.alias("tree"), F.col("leaf").alias("digest"), "tampered"), "merkle-rows")
    base = stash(numbered(rows, "tree", ["doc_id", "digest"], "merkle-sorted"), "merkle-leaves")
    rounds = _rounds(base.select("tree", "pos", "n", "digest"))
    # the top tree: one node for each language, in their order
    subroots = rounds[-1].select(F.col("tree").alias("name"), F.col("digest"), F.lit("").alias("tree"))
    top = stash(numbered(subroots, "tree", ["name"], "merkle-tops"), "merkle-top")
    tops = _rounds(top.select("tree", "pos", "n", "digest"))
    outer = tops[-1].select("tree", "pos", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"),
                            F.col("digest").alias("root"))
    for nodes in reversed(tops[:-1]):
        outer = _down(nodes, outer)
    outer = (top.select(F.col("pos").alias("_pos"), "name", F.col("digest").alias("_subroot"))
             .join(outer, F.col("_pos") == F.col("pos"))
             .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path",
                     F.col("_subroot").alias("subroot"), "root"))
    for nodes in reversed(rounds[1:-1]):
        outer = _down(nodes, outer)
    return _cogroup(base, outer, _prove, _PROVEN)


def dataset(docs: DataFrame, key: str = "doc_id", tree: str = "lang", fields=FIELDS, tampered: Column | None = None,
            changes: dict[str, Column] | None = None) -> DataFrame:
    """Manifest of a table: ``fields`` make the leaf, ``tree`` names the tree, ``key`` orders it.
    Where ``tampered`` holds, the leaf that is checked has the ``changes`` instead of its fields."""
    original = leaf(*[F.col(f) for f in fields])
    other = leaf(*[(changes or {}).get(f, F.col(f)) for f in fields])
    cond = tampered if tampered is not None else F.lit(False)
    return manifest(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(tree).cast("string").alias("tree"),
                                original.alias("leaf"), F.when(cond, other).alias("tampered")))


def lowered_third(key: str = "doc_id", text: str = "text") -> dict:
    """The tampering of the registered query: where 3 divides the key's crc32, A-Z are lower-cased."""
    return {"tampered": F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, F.lit(False)),
            "changes": {text: F.translate(F.col(text), UPPER, LOWER)}}
