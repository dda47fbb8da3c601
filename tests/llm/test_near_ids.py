"""Near dedup where ids are missing or shared; secrets of any length."""

import re

from llm_corpus import corpus  # noqa: F401

from loom.llm.near_dedup import drop_near_copies, near_dedup
from loom.llm.secrets import scan_secrets

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows):
    """(doc_id, n_shingles, component_id, kept) per row; links are between rows, whatever their ids."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append({tuple(w[k:k + 3]) for k in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if top(b) == top(a)] if sets[a] else [i]
        first = min((x for x in ids if x is not None), default=None)
        out.append((i, len(sets[a]), first, i == first))
    return out


def test_rows_without_an_id_and_texts_that_share_one(spark, corpus):  # noqa: F811
    rows = list(corpus[0])
    words = [f"v{i}" for i in range(40)]
    more = [f"u{i}" for i in range(40)]
    rows += [(None, " ".join(words)), (5, " ".join(words[:-1])),                         # a near copy without an id
             (3, " ".join(more)), (3, " ".join(words[::-1])), (9, " ".join(more[:-1])),    # two texts under one id
             (None, " ".join(more[::-1])), (None, " ".join(more[::-1][:-1])), (None, None)]  # only rows without ids
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, label int")
    got = near_dedup(df).collect()
    want = brute(rows)
    assert sorted(map(str, [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got])) == sorted(map(str, want))
    stay = [tuple(r) for r in drop_near_copies(df).select("doc_id", "text").collect()]
    linked = [" ".join(more[::-1]), " ".join(more[::-1][:-1])]
    assert sum(t in linked for _, t in stay) == 1
    assert (None, " ".join(words)) not in stay and (5, " ".join(words[:-1])) in stay
    assert sum(i == 3 for i, _ in stay) >= 2 and (9, " ".join(more[:-1])) not in stay


def test_urls_with_long_secrets_and_long_runs(spark):
    token, scheme = "t" * 5000, "a" * 300
    texts = [f"see https://user:{token}@host/x", f"{scheme}+b://{token}:{token}@h", "x" * 300_000 + " ftp://u:p@h",
             "a1" * 100_000, "-----BEGIN OPENSSH PRIVATE KEY-----", "-----BEGIN " + "A " * 50 + "PRIVATE KEY-----",
             "https://host/path:80@x", "123://u:p@h", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'s' AS source")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("url", "key")] for r in scan_secrets(df).collect()}
    assert got == {0: [("url", 4, 4 + 8 + 5 + len(token) + 1)], 1: [("url", 0, len(texts[1]) - 1)],
                   2: [("url", 300_001, 300_001 + 10)], 3: [], 4: [("key", 0, 35)], 5: [("key", 0, len(texts[5]))],
                   6: [], 7: [], 8: [], 9: []}
