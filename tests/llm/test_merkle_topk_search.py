"""Merkle manifest, exact top-k search and ranked lexical search against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm_corpus import corpus  # noqa: F401
from pyspark.sql import functions as F

from loom.llm import merkle, ranked_search, topk_search

DOC = "doc_id long, source string, lang string, n_chars int, text string, tree string, pos int, digest string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_merkle(rows):
    """(doc_id, source, leaf, subroot, root, proof, folded, verified) per row of (doc_id, source, lang, n_chars, text)."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def climb(nodes):
        """Last node, and for each node its [(left, right)...] way up."""
        ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
        while len(level) > 1:
            for i, p in enumerate(at):
                run = p // 16 * 16
                ways[i].append(("".join(level[run:p]), "".join(level[p + 1:run + 16])))
                at[i] = p // 16
            level = [H(*level[i:i + 16]) for i in range(0, len(level), 16)]
        return level[0], ways
    by_source = {}
    for r in rows:
        leaf = H(*[field(v) for v in r])
        changed = leaf
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            changed = H(*[field(v) for v in r[:4]], field(r[4].translate({c: c + 32 for c in range(65, 91)})))
        by_source.setdefault(r[1], []).append((r[0], leaf, changed))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in names:
        by_source[s].sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        subs[s] = climb([leaf for _, leaf, _ in by_source[s]])
    if not names:
        return []
    root, tops = climb([subs[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (doc_id, leaf, changed), way in zip(by_source[s], subs[s][1]):
            x = changed
            for a, b in way + top:
                x = H(a, x, b)
            out.append((doc_id, s, leaf, subs[s][0], root, H(*[a + b for a, b in way + top]), x, x == root))
    return out


def manifest_rows(spark, rows):
    docs = spark.createDataFrame([(*r, "x", n, "y") for n, r in enumerate(rows)], DOC)
    got = merkle.merkle_manifest(docs)
    cols = "doc_id source leaf subroot root proof_sha256 folded_root verified".split()
    return got, sorted(got.leaves.select(*cols).collect(), key=str)


def merkle_rows(n, sources, seed=3):
    r = random.Random(seed)
    return [(i, r.choice(sources), r.choice(["en", None]), r.randint(0, 9), r.choice(["Some Text", "é A", "", "plain"]))
            for i in range(n)]


@pytest.mark.parametrize("rows", [
    merkle_rows(1, ["a"]), merkle_rows(16, ["a"]), merkle_rows(17, ["a"]), merkle_rows(300, [None, "", "a", "b", "é"]),
    merkle_rows(60, [f"s{i}" for i in range(40)]),
    [(5, "a", "en", 1, "Text")] * 3 + [(5, "a", "en", 1, "Other"), (None, "a", None, None, None), (None, None, None, None, "A"),
                                      (10, "a", "en", 3, "long " * 50_000), (3, "a", "en", 1, None)],
], ids=["one", "run", "run+1", "sources", "many sources", "ties and nulls"])
def test_merkle_equals_brute_force(spark, rows):
    assert manifest_rows(spark, rows)[1] == sorted(brute_merkle(rows), key=str)


def test_merkle_over_several_rounds_of_blocks(spark, monkeypatch):
    """Blocks of one level: paths run through several rounds, and versions copy only their ancestors."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = merkle_rows(900, ["hot"] * 8 + [f"s{i}" for i in range(30)])
    got, leaves = manifest_rows(spark, rows)
    want = brute_merkle(rows)
    assert leaves == sorted(want, key=str)
    nodes = got.nodes.collect()
    digests = {n.digest for n in nodes}
    hot = sum(r[1] == "hot" for r in rows)
    assert sum(n.source == "hot" for n in nodes) == sum(-(-hot // 16 ** i) for i in (1, 2))
    copied = [r for r in got.leaves.collect() if r.copied]
    assert copied and all(r.copied[-1] == r.folded_root and not digests & set(r.copied) for r in copied)
    assert all((not r.verified) == bool(r.copied) for r in got.leaves.collect())


def test_merkle_of_nothing(spark):
    got, leaves = manifest_rows(spark, [])
    assert leaves == [] and got.nodes is None


def brute_top_k(rows, k):
    fit = [(i, v, [math.floor(64 * x) for x in e]) for i, (v, e) in enumerate(rows)
           if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, q in fit:
        if v is None or v % 20:
            continue
        scored = sorted((-min(max(sum(a * b for a, b in zip(q, c)), -2 ** 63), 2 ** 63 - 1), u is None, u or 0)
                        for j, u, c in fit if j != i)
        out += [(v, rank, None if none else u, -s) for rank, (s, none, u) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def top_rows(spark, rows, k=20):
    df = spark.createDataFrame([(v, e, 7, "z") for v, e in rows], "vec_id long, embedding array<float>, n int, shard string")
    got = topk_search.top_k(df.repartition(5), F.col("vec_id") % 20 == 0, k=k)
    return sorted([tuple(r) for r in got.collect()], key=str)


def vectors(n, dim, seed=1, grid=None):
    r = random.Random(seed)
    return [(i, [round(r.uniform(-1, 1) * (grid or 1000)) / (grid or 1000) for _ in range(dim)]) for i in range(n)]


def as_floats(rows):
    import numpy as np
    return [(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for v, e in rows]


EDGES = (vectors(120, 6, grid=2) + [(40, [1.0, 1.0]), (40, [1.0, 1.0]), (60, []), (None, [0.5] * 6), (None, [0.5] * 6),
                                    (80, None), (100, [None, 1.0]), (120, [float("nan")] * 6), (140, [float("inf")]),
                                    (-20, [-0.1] * 9), (7, vectors(8, 6)[7][1])])


@pytest.mark.parametrize("rows, k", [(vectors(400, 12), 20), (vectors(12, 3), 20), (EDGES, 20), (EDGES, 3),
                                     ([(0, [1e30, -1e30]), (1, [1e30, 1e30]), (2, [3.0, 1e30]), (20, [1.0, 2.0])], 2),
                                     ([(0, [1.0])], 5), ([(1, [1.0]), (2, [2.0])], 5), ([], 5)],
                         ids=["plain", "few", "edges", "edges k=3", "huge", "alone", "no query", "empty"])
def test_top_k_equals_brute_force(spark, rows, k):
    assert top_rows(spark, rows, k) == brute_top_k(as_floats(rows), k)


def test_top_k_over_many_tiles_and_merges(spark, monkeypatch):
    for name, value in dict(SHARD_ROWS=8, GROUP_ROWS=16, GROUP_QUERIES=8, TILE=40, LIST_ROWS=3, FAN_IN=2).items():
        monkeypatch.setattr(topk_search, name, value)
    rows = vectors(500, 5, grid=3) + EDGES
    assert top_rows(spark, rows, 7) == brute_top_k(as_floats(rows), 7)


def brute_search(docs, items, k):
    term = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def terms(text):
        return Counter(term.findall((text or "").translate({c: c + 32 for c in range(65, 91)})))
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in held:
            m = 100 - 90 + (90 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "La la é"), (2, None), (3, ""), (4, "--- ,"), (5, "one TWO one zzz"), (5, "a b c"), (None, "two"),
         (7, "never-seen"), (8, "x y a b c one two la zz0 zz1 zz2")]


def search_rows(spark, docs, items, k=10, **more):
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n int, terms string")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    got = ranked_search.ranked_search(df.repartition(3), asked, k=k, **more)
    return sorted([tuple(r) for r in got.collect()], key=str)


@pytest.mark.parametrize("more", [{}, {"width": 1}, {"width": 7, "block_bytes": 30}, {"k": 2}], ids=str)
def test_search_equals_brute_force(spark, corpus, more):  # noqa: F811
    docs, k = corpus[0], more.get("k", 10)
    items = ITEMS + [(20 + i, docs[i][1]) for i in (0, 3, 33, 41)]
    assert search_rows(spark, docs, items, **more) == brute_search(docs, items, k)


def test_search_cuts_long_texts_between_terms(monkeypatch):
    text = ("Word, é" + "x" * 50 + " ünd-9 ") * 40
    want = ranked_search.term_counts(text.encode())
    monkeypatch.setattr(ranked_search, "PIECE", 11)
    assert ranked_search.term_counts(text.encode()) == want and want.total() == 160


def test_search_of_nothing(spark):
    assert search_rows(spark, [], ITEMS) == [] == search_rows(spark, [(1, "a b")], [])
    assert search_rows(spark, [(1, None), (2, " ")], ITEMS) == []


def test_sketches_bound_scores_and_most_documents_are_not_rescored():
    import numpy as np
    r = np.random.default_rng(4)
    sizes = np.full(2000, 30)
    terms = np.concatenate([np.sort(r.choice(5000, 30, replace=False)) for _ in sizes])
    impacts = r.integers(1, 10 ** 9, len(terms))
    slots = r.integers(0, 512, 5000)
    s = ranked_search.Sketches(terms, sizes, impacts, 5000, slots, 512)
    item = np.unique(np.concatenate([terms[:20], r.choice(5000, 10)]))
    exact = s.scores(np.arange(2000), item)
    assert (s.bounds(slots[item]) >= exact).all()
    best = ranked_search.Best(5)
    done = ranked_search.rescore(s, list(range(2000)), item, slots[item], best)
    assert [x for x, _ in best.rows] == sorted(exact[exact > 0], reverse=True)[:5] and done < 1000
