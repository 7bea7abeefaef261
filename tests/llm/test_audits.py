"""Manifest, divergence and decontamination on small tables, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tripmart.llm import decontaminate, divergence, merkle

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, pos long, tree string, found string, "
        "term string, n int, _key string")
rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


ITEM = prose(25, 900)
EDGES = [(None, None, None, None), (None, "No id Here", None, "s1"), (None, "No id Here", None, "s1"), (0, "", "en", "s0"),
         (1, "Some Words and Some more", "en", None), (1, "Other words", "en", "s1"), (1, "Other words", "en", "s1"),
         (2, prose(20_000, 5), "en", "s0"), (3, "ÄÖ ü \U0001f600 words İ words", "dé", "s1"), (4, ITEM.upper(), "x", "s1"),
         (5, f"before {ITEM} after it {' '.join(ITEM.split()[3:14])}", "en", "s1"), (6, "one,two;THREE!", "en", "s2"),
         (7, "solo", "alone", "s9"), *[(20 + i, prose(30, i % 40).title(), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(90)]]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 1, "t", "f", "w", 2, "k") for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return docs_of(spark, EDGES)


# ---- manifest

def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    def leaf(i, text, lang, source):
        values = (i, source, lang, None if text is None else n_chars[text], text)
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(nodes):
        """(root, path of every node)."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for k in range(len(nodes)):
                first = at[k] // 8 * 8
                paths[k].append((level[first:at[k]], level[at[k] + 1:first + 8]))
                at[k] //= 8
            level = [h("".join(level[i:i + 8])) for i in range(0, len(level), 8)]
        return level[0], paths

    n_chars = {t: len(t) for _, t, _, _ in rows if t is not None}
    by_lang = defaultdict(list)
    for i, text, lang, source in rows:
        lower = text if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        digest = leaf(i, text, lang, source)
        if i is not None and zlib.crc32(str(i).encode()) % 3 == 0:
            # n_chars stays that of the row
            values = (i, source, lang, None if text is None else len(text), lower)
            changed = h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))
        else:
            changed = digest
        by_lang[lang].append((-1 if i is None else i, digest, changed, i))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[1] for x in sorted(by_lang[g], key=lambda x: x[:2])]) for g in langs}
    root, tops = tree([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops, strict=True):
        for (_, digest, changed, i), path in zip(sorted(by_lang[g], key=lambda x: x[:2]), trees[g][1], strict=True):
            folded, siblings = changed, ""
            for before, after in path + top:
                folded = h("".join(before) + folded + "".join(after))
                siblings += "".join(before + after)
            out.append((i, digest, trees[g][0], root, h(siblings), folded, folded == root))
    return sorted(out, key=str)


def manifest_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
                   .collect()), key=str)


def test_manifest(spark, docs):
    want = brute_manifest(EDGES)
    got = manifest_rows(merkle.dataset(docs, **merkle.lowered_third()))
    assert got == want
    assert {r[6] for r in want} == {True, False}
    again = merkle.dataset(docs.repartition(5), **merkle.lowered_third())
    assert manifest_rows(again) == want


def test_manifest_of_several_superblocks(spark):
    rows = [(i, f"Text {i}", "en" if i % 7 else "de", "s") for i in range(9_500)] + [(3, "Same", "en", "s")] * 400
    got = manifest_rows(merkle.dataset(docs_of(spark, rows), **merkle.lowered_third()))
    assert got == brute_manifest(rows)


def test_manifest_of_many_trees(spark):
    rows = [(i, "x", f"lang{i:05d}", None) for i in range(70)]
    assert manifest_rows(merkle.dataset(docs_of(spark, rows), **merkle.lowered_third())) == brute_manifest(rows)


def test_manifest_of_one_and_of_no_row(spark, docs):
    assert manifest_rows(merkle.dataset(docs.where("doc_id = 7"))) == brute_manifest([EDGES[12]])
    assert merkle.dataset(docs.where("false")).collect() == []


def test_reduce_block_agrees_with_fold():
    nodes = [h(str(i)) for i in range(700)]
    levels, top = merkle.reduce_block(nodes, True)
    assert all(merkle.fold(n, merkle.beside(levels, i)) == top for i, n in enumerate(nodes))
    assert merkle.fold(h("x"), merkle.beside(levels, 5)) != top


# ---- divergence

def brute_audit(rows, min_docs=3, top=200):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(terms)
        in_docs[lang or ""].update(set(terms))
    out = []
    for lang in in_docs:
        kept = {t for t, n in in_docs[lang].items() if n >= min_docs}
        groups = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        whole = {t: sum(c[t] for c in groups.values()) for t in kept}

        def share(c, n_kept=len(kept)):
            total = sum(c.values()) + n_kept
            return {t: 1 + 10**9 * (n + 1) // total for t, n in c.items()}
        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:limit])]
    return sorted(out)


def audit_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence(docs, monkeypatch):
    want = brute_audit(EDGES)
    assert {r[2] for r in want} == {"pair", "term"} and any(r[0] == "" for r in want)
    assert audit_rows(divergence.audit(docs)) == want
    # many shards; the result is the same
    assert audit_rows(divergence.audit(docs, shard=20)) == want


def test_divergence_ranks_stop_at_top(docs):
    got = audit_rows(divergence.audit(docs, top=5))
    assert got == brute_audit(EDGES, top=5)


def test_divergence_merges_partial_counts(docs, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(divergence, "SLICE", 100)
    monkeypatch.setattr(divergence, "HELD", 50)
    table = pa.Table.from_pylist([{"lang": g, "source": s, "text": t} for _, t, g, s in EDGES],
                                 pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())]))
    total = Counter()
    for b in divergence._partial_counts(table.to_batches(max_chunksize=17)):
        for r in b.to_pylist():
            total[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter()
    for _, t, g, s in EDGES:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        want.update((g or "", s or "", x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low))
    assert {k: v for k, v in total.items() if k[2]} == dict(want)
    assert {k[:2] for k in total if not k[2]} == {(g or "", s or "") for _, _, g, s in EDGES}


def test_share_is_exact():
    import numpy as np
    r = random.Random(3)
    for _ in range(300):
        total = r.randint(1, 9 * 10**15)
        n = r.randint(0, total - 1)
        assert divergence._share(np.array([n]), np.int64(total))[0] == 1 + 10**9 * (n + 1) // total


def test_divergence_of_no_row(docs):
    assert divergence.audit(docs.where("false")).collect() == []


# ---- decontamination

ITEMS = [(0, ITEM), (1, prose(9, 901)), (2, None), (3, " ,"), (10, ITEM), (9, "Solo!"), (None, "one two three"), (4, prose(40, 902)),
         (4, "ü 😀 words"), (5, prose(12, 5))]


def brute_scan(rows, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[k:k + n])].add(i)
    out = []
    for i, t, _, _ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k:k + n])]
        found.discard(None)
        ids = sorted(map(str, found))
        out.append((i, len(w), len(hit), len(ids), h(",".join(ids)), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, 7) for i, t in ITEMS], "item_id long, text string, h int")


def scan_rows(docs, items, **params):
    return sorted((tuple(r) for r in decontaminate.scan(docs, items, **params).select(
        "doc_id", *decontaminate.digest("found")).collect()), key=str)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 2000])
def test_decontaminate(docs, items, block):
    want = brute_scan(EDGES, ITEMS)
    assert sum(r[5] for r in want) >= 5
    assert scan_rows(docs.drop("found"), items, block=block) == want


def test_decontaminate_other_window(docs, items):
    assert scan_rows(docs.drop("found"), items, window=3) == brute_scan(EDGES, ITEMS, 3)


def test_decontaminate_empty_tables(docs, items):
    assert {r[2:4] for r in scan_rows(docs.drop("found"), items.where("false"))} == {(0, 0)}
    assert scan_rows(docs.drop("found").where("false"), items) == []


def test_words_of_long_texts_do_not_depend_on_slices(monkeypatch):
    text = prose(3_000, 8) + " " + "é" * 5_000 + " end"
    whole = decontaminate.Words(text).hashes.tolist()
    monkeypatch.setattr(decontaminate, "SLICE", 64)
    assert decontaminate.Words(text).hashes.tolist() == whole
    assert len(whole) == 3_002 and len(set(whole)) == len(set(text.split()))


def test_remove(docs, items):
    hit = {r[0] for r in brute_scan(EDGES, ITEMS) if r[5]}
    left = decontaminate.remove(docs, items)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((e[0] for e in EDGES if e[0] not in hit), key=str)
    cut = {r.doc_id: r.text for r in decontaminate.remove(docs, items, spans=True).collect()}
    assert cut[5] == "before  after it " and cut[4] == "" and cut[7] == "" and cut[0] == ""
    assert cut[20] == EDGES[13][1]
