"""Substring dedup: chunks of texts hashed in one go, against brute force."""

import hashlib
import random
import re

import numpy as np

from loom.llm import substring_dedup as sd
from loom.llm.hashing import prefix_sums
from loom.llm.repeats import runs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_chunks_cover_all_rows():
    sizes = [5, 0, 400, 3, 3, 3, 0]
    got = list(sd.chunks(sizes, 8))
    assert [k for a, b in got for k in range(a, b)] == list(range(len(sizes)))
    assert all(b - a == 1 or sum(sizes[a:b]) <= 8 for a, b in got)
    assert not list(sd.chunks([]))


def test_runs_of_a_chunk_are_those_of_its_texts():
    r = random.Random(3)
    texts = [" ".join(r.choice("ab cd ef gh".split()) for _ in range(r.choice([0, 1, 19, 20, 21, 90]))).encode()
             for _ in range(60)] + [b"", b" \n ", b"x"]
    codes, edge = sd.chunk_codes(texts)
    whose, *got = sd.chunk_runs(codes, edge, 20, 8)
    for k in range(len(texts)):
        want = runs_of(prefix_sums(codes[edge[k]:edge[k + 1]]), 20, 8)
        assert all(np.array_equal(g[whose == k], w) for g, w in zip(got, want))


def test_against_brute_force(spark):
    r = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    passages = [[r.choice(words) for _ in range(r.randint(18, 70))] for _ in range(6)]

    def text():
        out = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(passages)
            k = r.randint(0, 10)
            out += r.choice([p, p[k:], p[:-k or None], [r.choice(words) for _ in range(15)]])
        return "\t".join(out)
    rows = [(i if i % 7 else None, text()) for i in range(80)] + [(3, " ".join(r.choice(words) for _ in range(60_000)))]
    rows += [(200, rows[5][1]), (200, rows[5][1]), (201, None), (202, "")]
    first, place = {}, lambda i: (i is None, i or 0)
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 19):
            at, s = (place(i), k), tuple(w[k:k + 20])
            first[s] = min(first.get(s, at), at)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 19):
            if first[tuple(w[k:k + 20])] < (place(i), k):
                gone[k:k + 20] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    df = spark.createDataFrame([(i, t, -1) for i, t in rows], "doc_id long, text string, piece int")
    got = [(x.doc_id, x.n_words, x.n_removed, x.kept_sha256) for x in sd.substring_dedup(df).collect()]
    assert sum(x[2] for x in want) > 0
    assert sorted(got, key=repr) == sorted(want, key=repr)
