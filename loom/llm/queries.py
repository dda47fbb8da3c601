"""Registered queries of the text operators: thin wrappers that apply them to the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loom.session import ensure_checkpoint_dir

from .common import documents
from .decontamination import contamination
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .merkle import merkle_manifest
from .mixing import mix
from .near_dedup import near_dedup
from .ranked_search import ranked_search
from .secrets import BASE, scan_secrets
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import count_tokens
from .topk_search import top_k
from .toxicity import score_toxicity

TOXIC_AT = 0.7


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def toxic_training_rows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text, toxic of the labelled rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").filter(~held_out())
    return docs.select("doc_id", "text").join(labels, "doc_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, toxic_training_rows(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own: the query's result doesn't depend on what ran before
    cache = f"{ensure_checkpoint_dir(spark).rstrip('/')}/loom-llm/token-cache-{uuid.uuid4().hex}"
    return count_tokens(documents(spark, sf_dir), tokenizer_path(), cache)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"), "n_live", "n_example")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir)).drop("text_key", "stays")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("text_key")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = merkle_manifest(documents(spark, sf_dir)).leaves
    copies = F.coalesce(F.size("copied"), F.lit(0))
    return leaves.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified",
                         F.when(copies > 0, copies).otherwise(0).cast("long").alias("n_copied"))


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_substring_dedup, op3_toxicity, op4_token_counts, op5_suffix_dedup,
                            op6_mixing, op7_line_dedup, op8_secrets, op9_near_dedup, op10_exact_dedup, op11_merkle,
                            op12_topk, op13_ranked_search)}

ORACLE: dict[str, str] = {}

ORACLE["op10_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '') AS norm
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS place
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM k
"""

ORACLE["op7_line_dedup"] = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line, len(lines) AS n FROM d),
w AS (
  SELECT doc_id, pos, n, line,
         lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS c
  FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
f AS (
  SELECT doc_id, pos, n, line, pos + 2 < n AND row_number() OVER (PARTITION BY line, b, c ORDER BY pos + 2 >= n, doc_id, pos) > 1
         AS later FROM w),
r AS (
  SELECT doc_id, pos, line, bool_or(later) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
         AS gone FROM f)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""


def _merkle_sql(levels: int = 7) -> str:
    """Levels 1 to 7 of 16 (268 million leaves a source); a tree that has one node left passes it on unchanged."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')".format

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), "
           "lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def tree(name: str, leaves: str) -> str:
        """Levels name0..nameL of (tree, pos, n, digest); name_way0.. the siblings joined left and right."""
        parts = [f"{name}0 AS ({leaves})"]
        for i in range(levels):
            run = f"PARTITION BY tree, pos // 16 ORDER BY pos"
            parts.append(f"""{name}_way{i} AS (
  SELECT tree, pos, n,
         coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}{i})""")
            parts.append(f"""{name}{i + 1} AS (
  SELECT tree, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n,
         CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest
  FROM {name}{i} GROUP BY tree, pos // 16)""")
        return ",\n".join(parts)

    def climb(name: str, rows: str, out: str, keep: str) -> str:
        """rows (pos, tree, x, proof, keep...) carried to the tree's last node, level by level."""
        parts, last = [], rows
        for i in range(levels):
            parts.append(f"""{out}{i + 1} AS (
  SELECT {keep}, a.tree, a.pos // 16 AS pos, CASE WHEN w.n > 1 THEN sha256(l || x || r) ELSE x END AS x,
         proof || l || r AS proof FROM {last} a JOIN {name}_way{i} w ON a.tree = w.tree AND a.pos = w.pos)""")
            last = f"{out}{i + 1}"
        return ",\n".join(parts)
    return f"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {leaf('text')} AS leaf,
         CASE WHEN {crc} % 5 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf('text')} END AS x
  FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos,
             count(*) OVER (PARTITION BY tree) AS n FROM d),
{tree('s', 'SELECT tree, pos, n, leaf AS digest FROM p')},
{tree('t', f"SELECT 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, digest FROM s{levels}")},
subroots AS (SELECT tree AS source, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM s{levels}),
a0 AS (SELECT doc_id, leaf, tree AS source, tree, pos, x, '' AS proof FROM p),
{climb('s', 'a0', 'a', 'doc_id, leaf, source')},
b0 AS (SELECT a.doc_id, a.leaf, a.source, subroot, x AS changed, 'all' AS tree, subroots.pos AS pos, x, proof
       FROM a{levels} a JOIN subroots ON a.source = subroots.source),
{climb('t', 'b0', 'b', 'doc_id, leaf, subroot')},
depth AS (SELECT tree, greatest(0, ceil(round(ln(max(n)) / ln(16), 9)))::BIGINT AS own FROM p GROUP BY tree),
whole AS (SELECT digest AS root, greatest(0, ceil(round(ln((SELECT count(*) FROM subroots)) / ln(16), 9)))::BIGINT AS up
          FROM t{levels})
SELECT b.doc_id, b.leaf, subroot, root, sha256(proof) AS proof_sha256, b.x AS folded_root, b.x = root AS verified,
       CASE WHEN p.x <> p.leaf THEN own + up ELSE 0 END AS n_copied
FROM b{levels} b JOIN p ON p.doc_id IS NOT DISTINCT FROM b.doc_id AND p.leaf = b.leaf JOIN depth ON depth.tree = p.tree, whole
"""


ORACLE["op11_merkle"] = _merkle_sql()

ORACLE["op12_topk"] = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 20
"""

_TERMS = (r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')").format

ORACLE["op13_ranked_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS('text')} AS terms FROM documents),
c AS (SELECT r, doc_id, len(terms)::BIGINT AS n, terms FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM c),
f AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(terms) AS term FROM c)
      GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
      FROM f, total GROUP BY term, n_docs),
q AS (SELECT DISTINCT i, item_id, term FROM (
        SELECT i, item_id, unnest(terms) AS term FROM (
          SELECT row_number() OVER () AS i, item_id, {_TERMS('text')} AS terms FROM benchmark))),
s AS (SELECT i, item_id, r, doc_id,
             sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN f USING (term) JOIN w USING (term), total GROUP BY i, item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 10
"""
