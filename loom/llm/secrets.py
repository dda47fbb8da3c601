"""Secret scan with corpus-wide ownership frequency [native].

Candidates are found per kind by regular expressions over the whole text (leftmost, non-overlapping).  Positions are
not returned by Spark's regular-expression functions, so a text that holds a candidate is cut into (gap, match) pairs
and the running lengths of the pairs are the spans, in code points.

Ownership: the hash of every candidate value is aggregated over the corpus to the number of distinct repositories
(``repo_col``) and distinct owners (``owner_col``) that hold it, duplicates collapsed before the shuffle.  A value held by
one repository and at most ``max_owners`` owners is owner-specific and live-looking; one that many share is a copied
example.  The verdict is reported beside the spans; it never drops one.

Beyond the base kinds (assign, access, hex) the method adds spans of kind ``key`` (PEM private-key headers) and ``url``
(user:password@ inside a URL).  Defined results: NULL text = empty text = no spans; a NULL repository or owner counts as
one more distinct value; repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, text_of

# kind -> (pattern, group that holds the value, least length of that group, cheap test that a text can hold one)
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (ASSIGN, 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]+)", 1, 24),
    "key": (r"(-----BEGIN [A-Z0-9 ]*?PRIVATE KEY-----)", 1, 1),
    # a scheme is the whole run of scheme characters, with a letter; possessive runs keep the scan linear at any length
    "url": (r"(?<![A-Za-z0-9+.-])[0-9+.-]*+[A-Za-z][A-Za-z0-9+.-]++://[^\x09-\x0D\x20/:@]++:([^\x09-\x0D\x20/@]++)@", 1, 1),
}
BASE = ("assign", "access", "hex")
# what a text must match before it is cut into pairs (runs below the least length are never spans)
TEST = KINDS | {"access": (r"AKIA[A-Z0-9]{16}", 0, 0), "hex": (r"[0-9a-f]{24}", 0, 0)}
# the cut itself: for runs, matching only those of the least length gives the same spans (runs are maximal)
CUT = KINDS | {"access": (r"(AKIA[A-Z0-9]{16,})", 1, 20), "hex": (r"([0-9a-f]{24,})", 1, 24)}


def _spans(kind: str, order: int) -> Column:
    """array<struct<start, rank, end, kind, value>> of the kept matches of one kind."""
    pattern, group, least = CUT[kind]
    # the end of the text closes the last gap: without it the search would start anew at each position of the tail
    pair = rf"([\s\S]*?)(?:({pattern})|\z)"
    gaps, hits, values = (F.regexp_extract_all("text", F.lit(pair), F.lit(g)) for g in (1, 2, 2 + group))
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))
    # running end of the previous match, folded left to right
    folded = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"),
                 F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["gap"]) + F.char_length(p["hit"])).alias("at"),
            F.when(F.char_length(p["value"]) >= least, F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.char_length(p["gap"])).alias("start"), F.lit(order).alias("rank"),
                (acc["at"] + F.char_length(p["gap"]) + F.char_length(p["hit"])).alias("end"),
                F.lit(kind).alias("kind"), p["value"].alias("value"))))).otherwise(acc["out"]).alias("out")),
        lambda acc: acc["out"])
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    return F.when(F.col("text").rlike(TEST[kind][0]), folded).otherwise(empty)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source",
                 owner_col: str | None = None) -> DataFrame:
    """Row per document: doc_id, repo, owner, spans (array, by start then kind)."""
    owner = F.col(owner_col) if owner_col else F.col(id_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(repo_col).cast("string").alias("repo"),
                       owner.cast("string").alias("owner"), text_of(text_col).alias("text"))
    found = base.select("doc_id", "repo", "owner",
                        *[_spans(k, i).alias(f"in_{k}") for i, k in enumerate(KINDS)])
    return found.select("doc_id", "repo", "owner",
                        F.array_sort(F.concat(*[F.col(f"in_{k}") for k in KINDS])).alias("spans"))


def ownership(spans: DataFrame) -> DataFrame:
    """Candidate hash -> distinct repositories and owners; pre-aggregated to distinct triples before each count."""
    each = spans.select("repo", "owner", F.explode("spans").alias("s")) \
        .select(F.sha2("s.value", 256).alias("value_hash"), F.xxhash64(F.coalesce("repo", F.lit("\0"))).alias("repo"),
                F.xxhash64(F.coalesce("owner", F.lit("\0"))).alias("owner"))
    pairs = each.distinct()
    repos = pairs.groupBy("value_hash", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = pairs.groupBy("value_hash", "owner").agg(F.lit(1).alias("one"))
    return (repos.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_repos"))
            .join(owners.groupBy("value_hash").agg(F.count(F.lit(1)).alias("n_owners")), "value_hash"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source",
                 owner_col: str | None = None, max_owners: int = 2) -> DataFrame:
    """Row per document: doc_id, spans, n_live, n_example (candidates by ownership verdict)."""
    spans = staged(secret_spans(docs, id_col, text_col, repo_col, owner_col)
                   .withColumn("row", F.struct(F.spark_partition_id().alias("p"),
                                               F.monotonically_increasing_id().alias("i"))), "secret-spans")
    known = ownership(spans)
    each = spans.select("row", F.explode("spans").alias("s")).select("row", F.sha2("s.value", 256).alias("value_hash"))
    live = (F.col("n_repos") == 1) & (F.col("n_owners") <= max_owners)
    verdict = (each.join(known, "value_hash").groupBy("row")
               .agg(F.sum(live.cast("long")).alias("n_live"), F.sum((~live).cast("long")).alias("n_example")))
    out = spans.join(verdict, "row", "left")
    return out.select("doc_id", "spans", F.coalesce("n_live", F.lit(0)).alias("n_live"),
                      F.coalesce("n_example", F.lit(0)).alias("n_example"))
