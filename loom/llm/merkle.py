"""Merkle manifest of a table, with tampered versions by path copying in a persistent tree.

Every row is a leaf: H (lowercase hex sha256) of its fields, each ``-`` if NULL, else byte count, ``:``, value.  The
leaves of a source ascend by id; while more than one node remains, every 16 consecutive ones become the H of their
digests.  The sources' last nodes, ordered by source (NULL first, bytewise), are hashed alike up to the root.

Built as Spark jobs over aligned blocks of 16^3 nodes, so that no task ever holds more than a block:

* rows are range-partitioned by (source, id, leaf); a row's position is its place in its range plus the counts of the
  source's earlier ranges, so a hot source is spread over many tasks;
* bottom-up, a task per block makes three levels and hands on one node; rounds go on until each tree has one node.
  All inner nodes are written once: they are the untampered version;
* top-down, a task per block hands each of its nodes the siblings on the way to the root (one path per block below);
* a task per block of leaves hashes each leaf's proof and, for a tampered leaf, copies only its ancestors: inside the
  block first, then on through the block's upper path.  All other nodes are shared with the untampered version.

Defined results: NULL and empty texts differ (``-`` and ``0:``); a row with a NULL id comes last in its source and is
never tampered; rows that share an id are ordered by leaf; fully repeated rows are leaves of their own; extra columns
are ignored; an empty table has no nodes and an empty result.  Texts never leave their scan task, only digests move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

FAN = 16
LEVELS = 3                     # levels made inside one aligned block
BLOCK = FAN ** LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NODES = "tree string, n long, level int, idx long, digest string, top boolean"
PATHS = "tree string, pos long, lefts array<string>, rights array<string>"
PROOFS = ("doc_id long, tree string, leaf string, subroot string, root string, proof_sha256 string, "
          "folded_root string, verified boolean, copied array<string>")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: one row per document; ``nodes``: the inner nodes of the untampered trees."""

    leaves: DataFrame
    nodes: DataFrame | None


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(*values: Column) -> Column:
    """H of the fields, each ``-`` if NULL, else UTF-8 byte count, ``:``, value."""
    def field(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def block_levels(digests: list[str], whole: bool) -> list[list[str]]:
    """The block's nodes, lowest level first: up to the last node of a whole tree, else LEVELS levels up."""
    levels = [digests]
    while len(levels) <= LEVELS and not (whole and len(levels[-1]) == 1):
        low = levels[-1]
        levels.append([digest_of(low[i:i + FAN]) for i in range(0, len(low), FAN)])
    return levels


def siblings(levels: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """Left and right siblings of node i on its way up through the block, joined level by level."""
    lefts, rights = [], []
    for level in levels[:-1]:
        run = i - i % FAN
        lefts.append("".join(level[run:i]))
        rights.append("".join(level[i + 1:run + FAN]))
        i //= FAN
    return lefts, rights


def copied_path(digest: str, lefts: Iterable[str], rights: Iterable[str]) -> list[str]:
    """Digests of the ancestors that a changed node copies, up to the new root."""
    out = []
    for left, right in zip(lefts, rights):
        digest = digest_of((left, digest, right))
        out.append(digest)
    return out


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows plus pos (place in its tree, from 0) and n (nodes of the tree), written once."""
    dealt = staged(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), name)
    in_part = Window.partitionBy("tree", "part").orderBy(*order)
    parts = Window.partitionBy("tree").orderBy("part")
    sizes = (dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("rows"))
             .select("tree", "part", (F.sum("rows").over(parts) - F.col("rows")).alias("before"),
                     F.sum("rows").over(Window.partitionBy("tree")).alias("n")))
    placed = dealt.withColumn("place", F.row_number().over(in_part) - 1).join(sizes, ["tree", "part"])
    return staged(placed.withColumn("pos", F.col("before") + F.col("place")).drop("part", "place", "before"),
                  f"{name}-placed")


def _block(pos: str = "pos") -> Column:
    return F.floor(F.col(pos) / F.lit(BLOCK)).cast("long")


def _rising(round_no: int):
    def rise(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        tree, n, block = (table.column(c)[0].as_py() for c in ("tree", "n", "block"))
        levels = block_levels(table.column("digest").to_pylist(), n <= BLOCK)
        rows = []
        for up, level in enumerate(levels):
            last = up == len(levels) - 1
            if up == 0 and not last:
                continue               # the level below is written already
            first = block * FAN ** (LEVELS - up)
            rows += [(tree, n, round_no * LEVELS + up, first + i, d, last) for i, d in enumerate(level)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_()))],
            ["tree", "n", "level", "idx", "digest", "top"])
    return rise


def _raised(leaves: DataFrame, rounds: int, name: str) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Nodes that each round starts from; each tree's last node with the round that made it; all nodes above leaves."""
    starts, tops, inner = [leaves.select("tree", "pos", "n", "digest")], [], []
    for r in range(rounds):
        made = staged(starts[r].withColumn("block", _block()).groupBy("tree", "block")
                      .applyInArrow(_rising(r), NODES), f"{name}-{r}")
        inner.append(made.select("tree", "level", "idx", "digest"))
        tops.append(made.filter(F.col("top") & (F.col("n") <= BLOCK)).select("tree", "digest", F.lit(r).alias("round")))
        starts.append(made.filter(F.col("top") & (F.col("n") > BLOCK)).select(
            "tree", F.col("idx").alias("pos"), F.ceil(F.col("n") / F.lit(BLOCK)).cast("long").alias("n"), "digest"))
    roots, nodes = tops[0], inner[0]
    for top, more in zip(tops[1:], inner[1:]):
        roots, nodes = roots.union(top), nodes.union(more)
    return starts, roots, nodes


def _handing(nodes: pa.Table, path: pa.Table) -> pa.Table:
    """Each node's siblings up to the root: its own in the block, then the block's."""
    nodes = nodes.sort_by("pos")
    lefts, rights = path.column("lefts")[0].as_py(), path.column("rights")[0].as_py()
    levels = block_levels(nodes.column("digest").to_pylist(), nodes.column("n")[0].as_py() <= BLOCK)
    own = [siblings(levels, i) for i in range(len(nodes))]
    texts = pa.list_(pa.string())
    return pa.Table.from_arrays([nodes.column("tree"), nodes.column("pos"),
                                 pa.array([a + lefts for a, _ in own], texts),
                                 pa.array([b + rights for _, b in own], texts)], ["tree", "pos", "lefts", "rights"])


def _descended(starts: list[DataFrame], above: DataFrame, rounds: int, name: str) -> DataFrame:
    """Siblings from each block of the lowest round up to the root; above: a tree's own way up and its round."""
    paths = None
    for r in reversed(range(rounds)):
        whole = above.filter(F.col("round") == r).select("tree", F.lit(0).cast("long").alias("pos"), "lefts", "rights")
        paths = whole if paths is None else whole.union(paths)
        if r:
            paths = staged(_handed(starts[r], paths), f"{name}-path-{r}")
    return paths


def _handed(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    return (nodes.withColumn("block", _block()).groupBy("tree", "block")
            .cogroup(paths.withColumnRenamed("pos", "block").groupBy("tree", "block"))
            .applyInArrow(_handing, PATHS))


def _proving(root: str):
    def prove(leaves: pa.Table, path: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        lefts, rights, subroot = (path.column(c)[0].as_py() for c in ("lefts", "rights", "subroot"))
        digests = leaves.column("digest").to_pylist()
        levels = block_levels(digests, leaves.column("n")[0].as_py() <= BLOCK)
        upper = "".join(a + b for a, b in zip(lefts, rights))
        proofs, folded, copies = [], [], []
        for i, (leaf, changed) in enumerate(zip(digests, leaves.column("changed").to_pylist())):
            a, b = siblings(levels, i)
            proofs.append(digest_of([x + y for x, y in zip(a, b)] + [upper]))
            way = copied_path(changed or leaf, a + lefts, b + rights)
            folded.append(way[-1] if way else changed or leaf)
            copies.append(way if changed and changed != leaf else None)
        size = len(digests)
        return pa.Table.from_arrays(
            [leaves.column("doc_id"), leaves.column("tree"), leaves.column("digest"), pa.array([subroot] * size),
             pa.array([root] * size), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded]),
             pa.array(copies, pa.list_(pa.string()))],
            ["doc_id", "tree", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copied"])
    return prove


def _rounds(numbered: DataFrame) -> int:
    most, rounds = numbered.agg(F.max("n")).first()[0] or 0, 1
    while most > BLOCK:
        most, rounds = -(-most // BLOCK), rounds + 1
    return rounds if most else 0


def merkle_manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang",
                    chars_col: str = "n_chars", text_col: str = "text", tamper_every: int = 5) -> Manifest:
    """Leaves: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified, copied (digests of the
    ancestors the tampered version copies, lowest first; NULL where nothing changed).  Nodes: source, level, idx,
    digest of the inner nodes of the sources' trees (level 1 is just above the leaves).

    Tampered (A-Z of the text in lower case) are the rows whose crc32(decimal id) is divisible by tamper_every.
    """
    spark = docs.sparkSession
    head = [F.col(f"`{c}`") for c in (id_col, source_col, lang_col, chars_col)]
    text = F.col(f"`{text_col}`")
    hit = F.crc32(head[0].cast("string")) % tamper_every == 0
    source = head[1].cast("string")
    rows = docs.select(
        head[0].cast("long").alias("doc_id"),
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("tree"),   # NULL first
        leaf_digest(*head, text).alias("digest"),
        F.when(hit, leaf_digest(*head, F.translate(text, UPPER, LOWER))).alias("changed"))
    leaves = _numbered(rows, [F.asc_nulls_last("doc_id"), F.col("digest")], "merkle-leaves")
    rounds = _rounds(leaves)
    name = F.when(F.col("tree") != "", F.expr("substring(tree, 2)")).alias("source")
    if not rounds:
        return Manifest(_named(spark.createDataFrame([], PROOFS), name), None)
    starts, subroots, nodes = _raised(leaves, rounds, "merkle")

    # the tree of the sources' last nodes
    tops = _numbered(subroots.select(F.lit("all").alias("tree"), F.col("tree").alias("source"), "digest", "round"),
                     [F.col("source")], "merkle-sources")
    top_rounds = _rounds(tops)
    top_starts, top_root, _ = _raised(tops, top_rounds, "merkle-top")
    root = top_root.first()["digest"]
    none = F.array().cast("array<string>")
    start = top_root.select("tree", "round", none.alias("lefts"), none.alias("rights"))
    way = _handed(top_starts[0], _descended(top_starts, start, top_rounds, "merkle-top"))
    above = staged(tops.select("pos", "source", "digest", "round").join(way.drop("tree"), "pos").select(
        F.col("source").alias("tree"), F.col("digest").alias("subroot"), "round", "lefts", "rights"), "merkle-above")

    paths = _descended(starts, above, rounds, "merkle").join(above.select("tree", "subroot"), "tree")
    proved = (leaves.withColumn("block", _block()).groupBy("tree", "block")
              .cogroup(paths.withColumnRenamed("pos", "block").groupBy("tree", "block"))
              .applyInArrow(_proving(root), PROOFS))
    return Manifest(_named(proved, name), nodes.filter("level > 0").select(name, "level", "idx", "digest"))


def _named(proved: DataFrame, name: Column) -> DataFrame:
    return proved.select("doc_id", name, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "copied")
