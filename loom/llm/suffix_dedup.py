"""Suffix-array dedup: repeated byte strings by range-partitioned suffixes.

Removes each byte covered by a ``width``-byte string that also starts anywhere else, same document included.  Suffixes that can
repeat (see ``repeats``) are range-partitioned by their leading bytes: Spark samples the splitters, whose key ends in the
suffix's place, so even equal suffixes spread over several buckets.  Each bucket is sorted by a multikey quicksort over
the suffix's words (leading eight bytes, then a 64-bit digest of all ``width`` bytes, sorted only within ties) and neighbours are
compared; first and last suffixes of the buckets are compared across boundaries afterwards.  Two suffixes count as equal on 128
bits (leading bytes and digest).

Defined results: NULL text = empty text; texts under ``width`` bytes lose nothing; repeated rows are different documents, so
they remove each other's windows; invalid ids (NULL) are fine; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, prefix_sums, rolling
from .repeats import candidates, codes_of, described, refined, removed, spread, unpacked

WIDTH = 400
GRAIN, FINER = 128, 370      # bytes of an anchor, at first and inside what it leaves open
SIGN = U(1 << 63)


def _suffixes(width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, (text, runs) in enumerate(unpacked(b)):
                at = spread(runs[runs[:, 3] == 1])
                if not len(at):
                    continue
                data = np.frombuffer(text, np.uint8)
                lead = np.zeros(len(at), U)
                for k in range(8):
                    lead = lead << U(8) | data[at + k].astype(U)
                digest = rolling(prefix_sums(codes_of(text, "byte")[0]), width)[at]
                one = np.ones(len(at), np.int64)
                doc, key = b.column("doc_id")[row].as_py(), b.column("text_key")[row].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array((lead ^ SIGN).view(np.int64)), pa.array(digest.view(np.int64)),
                     pa.array(one * doc) if doc is not None else pa.nulls(len(at), pa.int64()),
                     pa.array(np.full(len(at), key, np.int64)), pa.array(at.astype(np.int32))],
                    names=["lead", "digest", "doc_id", "text_key", "at"])
    return cut


def multikey_sort(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, tied): rows by words[0], rows equal there by words[1], and so on; later words are read within ties only.
    tied[i]: the i-th row in order equals its predecessor in all words."""
    order = np.argsort(words[0], kind="stable")
    tied = np.zeros(len(order), bool)
    tied[1:] = words[0][order[1:]] == words[0][order[:-1]]
    for word in words[1:]:
        inside = tied.copy()
        inside[:-1] |= tied[1:]
        part = np.flatnonzero(inside)
        if not len(part):
            break
        block = np.cumsum(~tied)[part]
        fine = np.lexsort((word[order[part]], block))
        order[part] = order[part][fine]
        same = np.zeros(len(order), bool)
        same[1:] = tied[1:] & (word[order[1:]] == word[order[:-1]])
        tied = same
    return order, tied


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket; yield repeated starts per document, and its first and last suffix for the boundary comparison."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    lead, digest, at = (t.column(c).to_numpy() for c in ("lead", "digest", "at"))
    order, tied = multikey_sort([lead, digest])
    again = tied.copy()
    again[:-1] |= tied[1:]
    hit = order[again]
    edge = np.unique(order[[0, -1]])
    rows = pa.array(np.concatenate([hit, edge]))
    is_edge = pa.array(np.arange(len(hit) + len(edge)) >= len(hit))
    ends = t.take(rows)
    # repeated starts leave as one list per document
    key = ends.column("text_key").to_numpy()
    doc = ends.column("doc_id").fill_null(-(2 ** 62)).to_numpy()
    flag = np.asarray(is_edge)
    group = np.lexsort((doc, key, flag))
    new = np.concatenate([[True], (key[group][1:] != key[group][:-1]) | (doc[group][1:] != doc[group][:-1])
                          | flag[group][1:]])
    first = np.flatnonzero(new)
    head = ends.take(pa.array(group[first]))
    starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(group)).astype(np.int32)),
                                      pa.array(at[np.asarray(rows)[group]].astype(np.int32)))
    out = pa.table({"lead": head.column("lead"), "digest": head.column("digest"), "doc_id": head.column("doc_id"),
                    "text_key": head.column("text_key"), "edge": pa.array(flag[group[first]]), "starts": starts})
    yield from out.combine_chunks().to_batches()


def repeated_starts(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, starts: windows among the open runs that occur more than once."""
    from .common import staged
    suffixes = texts.mapInArrow(_suffixes(width), "lead long, digest long, doc_id long, text_key long, at int")
    dealt = suffixes.repartitionByRange("lead", "digest", "text_key", "at")
    sorted_ = staged(dealt.mapInArrow(_bucket, "lead long, digest long, doc_id long, text_key long, edge boolean, "
                                      "starts array<int>"), "suffix-buckets")
    edges = sorted_.filter("edge")
    across = edges.groupBy("lead", "digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("lead", "digest")
    return sorted_.filter("not edge").select("doc_id", "text_key", "starts").unionByName(
        edges.join(across, ["lead", "digest"]).select("doc_id", "text_key", "starts"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                 grain: int = GRAIN) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows, told = described(docs, id_col, text_col, "byte", width, grain)
    texts = candidates(rows, told, earlier_only=False)
    texts = refined(texts, "byte", width, max(grain, width * FINER // WIDTH), earlier_only=False)
    out = removed(told, texts, repeated_starts(texts, width), "byte", width)
    return out.withColumnRenamed("n_units", "n_bytes")
