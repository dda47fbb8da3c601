"""Where can a window of a text repeat?  Anchored contexts, shared by the two repeated-passage operators.

A window is ``width`` consecutive units (bytes or words) of one document.  Its anchor is the leftmost smallest hash of the
``grain``-unit pieces inside it, so equal windows have equal anchors at the same offset.  Neighbouring windows with the
same anchor form a run; a run's context is the text its windows span.  Hence, without looking at single windows:

* a run whose anchor occurs nowhere else holds no repeated window;
* runs with equal contexts repeat each other window by window (copies of long passages collapse here, before any shuffle of
  single windows);
* only where different contexts share an anchor must windows be compared one by one, and then one run of each context
  stands for all its copies.

Runs are about 2 / (width - grain) of the units.  Anchors and contexts are counted with map-side combining, and joined back
to their runs by joins that adaptive execution can split, so a passage in a third of all documents loads no single task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged, text_of
from .hashing import BYTE_CODE, U, mixed, prefix_sums, rolling, spans_hash, window_minima, word_codes

HIGH = U(0xFFFFFFFF00000000)
LOW = U(0x00000000FFFFFFFF)


def codes_of(text: bytes, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code per unit, with the units' byte spans (empty for bytes)."""
    data = np.frombuffer(text, np.uint8)
    if unit == "byte":
        none = np.zeros(0, np.int64)
        return BYTE_CODE[data], none, none
    return word_codes(data)


def joined_words(text: bytes, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> bytes:
    return b" ".join([text[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist())])


def runs_of(sums: np.ndarray, width: int, grain: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, first window, last window) of each run."""
    pieces = rolling(sums, grain)
    inside = width - grain + 1
    if len(pieces) < inside:
        none = np.zeros(0, np.int64)
        return none.astype(U), none.astype(U), none, none
    marked = (pieces & HIGH) | np.arange(len(pieces), dtype=U)
    anchor = (window_minima(marked, inside) & LOW).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    hi = np.concatenate([lo[1:] - 1, [len(anchor) - 1]])
    at = anchor[lo]
    context = mixed(spans_hash(sums, lo, hi + width) + mixed((at - lo).astype(U)))
    return pieces[at], context, lo, hi


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind))


def _described(unit: str, width: int, grain: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        for b in batches:
            size, sha, found = [], [], []
            for t in b.column("text"):
                text = t.as_py().encode()
                codes, start, end = codes_of(text, unit)
                whole = text if unit == "byte" else joined_words(text, start, end, np.arange(len(start)))
                size.append(len(codes))
                sha.append(hashlib.sha256(whole).hexdigest())
                found.append(runs_of(prefix_sums(codes), width, grain))
            cols = [[f[k] for f in found] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(size, pa.int64()), pa.array(sha, pa.string()),
                 _lists([c.view(np.int64) for c in cols[0]], pa.int64()),
                 _lists([c.view(np.int64) for c in cols[1]], pa.int64()),
                 _lists(cols[2], pa.int32()), _lists(cols[3], pa.int32())],
                names=["doc_id", "text_key", "n_units", "sha", "anchor", "context", "lo", "hi"])
    return describe


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_key"),
             pa.array([pack.compress(x.as_py().encode()) for x in b.column("text")], pa.binary())],
            names=["doc_id", "text_key", "packed"])


def same_doc(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.text_key") == F.col(f"{right}.text_key"))


def place(at: str) -> Column:
    """Order of occurrences: smaller id first (NULL last), then the earlier start."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(at).alias("at"))


def described(docs: DataFrame, id_col: str, text_col: str, unit: str, width: int, grain: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_key, text;  staged: doc_id, text_key, n_units, sha, runs as arrays)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")) \
        .withColumn("text_key", F.xxhash64("text"))
    told = rows.mapInArrow(_described(unit, width, grain),
                           "doc_id long, text_key long, n_units long, sha string, anchor array<long>, "
                           "context array<long>, lo array<int>, hi array<int>")
    return rows, staged(told, "repeat-runs")


def candidates(rows: DataFrame, told: DataFrame, earlier_only: bool) -> DataFrame:
    """Documents with candidate runs (staged): doc_id, text_key, packed text, runs (lo, hi, whole, open).

    whole: all windows of the run repeat (with ``earlier_only``: an equal context starts earlier); open: its windows must
    be compared one by one, for itself and for the runs of equal context.
    """
    runs = told.select("doc_id", "text_key", F.explode_outer(F.arrays_zip("anchor", "context", "lo", "hi")).alias("r")) \
        .select("doc_id", "text_key", "r.*").filter("anchor is not null")
    per = _judged(runs, earlier_only)
    packed = rows.select("doc_id", "text_key", "text").mapInArrow(_packed, "doc_id long, text_key long, packed binary")
    return staged(packed.alias("t").join(per.alias("p"), same_doc("t", "p"))
                  .select("t.doc_id", "t.text_key", "packed", "runs").dropDuplicates(["doc_id", "text_key"]),
                  "repeat-texts")


def _judged(runs: DataFrame, earlier_only: bool) -> DataFrame:
    """Per document the runs that repeat as a whole or must be opened."""
    repeated = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    live = staged(runs.join(repeated, "anchor", "left_semi"), "repeat-live")
    contexts = live.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(place("lo")).alias("first"))
    kinds = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    verdict = contexts.join(kinds, "anchor")
    is_first = place("lo") == F.col("first")
    whole = ~is_first if earlier_only else F.col("n") > 1
    marked = (live.join(verdict, ["anchor", "context"])
              .select("doc_id", "text_key", "lo", "hi", whole.alias("whole"),
                      (is_first & (F.col("kinds") > 1)).alias("open")).filter("whole or open").distinct())
    return marked.groupBy("doc_id", "text_key").agg(
        F.sort_array(F.collect_list(F.struct("lo", "hi", "whole", "open"))).alias("runs"))


def refined(texts: DataFrame, unit: str, width: int, grain: int, earlier_only: bool) -> DataFrame:
    """The candidates judged once more with longer anchors, inside their open runs only (staged)."""
    finer = texts.mapInArrow(_reopened(unit, width, grain), "doc_id long, text_key long, anchor long, context long, "
                             "lo int, hi int")
    per = _judged(finer, earlier_only)
    settled = F.transform(F.filter("t.runs", lambda r: r["whole"]),
                          lambda r: r.withField("open", F.lit(False)))
    both = F.concat(settled, F.coalesce("p.runs", F.array().cast(texts.schema["runs"].dataType)))
    return staged(texts.alias("t").join(per.alias("p"), same_doc("t", "p"), "left")
                  .select("t.doc_id", "t.text_key", "packed", both.alias("runs")).filter(F.size("runs") > 0),
                  "repeat-refined")


def _reopened(unit: str, width: int, grain: int):
    """Runs by longer anchors, cut to the open windows."""
    def reopen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, (text, runs) in enumerate(unpacked(b)):
                open_ = runs[runs[:, 3] == 1]
                if not len(open_):
                    continue
                sums = prefix_sums(codes_of(text, unit)[0])
                pieces = rolling(sums, grain)
                marked = (pieces & HIGH) | np.arange(len(pieces), dtype=U)
                at = spread(open_)
                anchor = (window_minima(marked, width - grain + 1) & LOW).astype(np.int64)[at]
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
                lo = at[new]
                hi = at[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(at) - 1]])]
                place_ = anchor[new]
                context = mixed(spans_hash(sums, lo, hi + width) + mixed((place_ - lo).astype(U)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("doc_id")[row].as_py()] * len(lo), pa.int64()),
                     pa.array(np.full(len(lo), b.column("text_key")[row].as_py(), np.int64)),
                     pa.array(pieces[place_].view(np.int64)), pa.array(context.view(np.int64)),
                     pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                    names=["doc_id", "text_key", "anchor", "context", "lo", "hi"])
    return reopen


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """(text, runs as an array of lo, hi, whole, open) per row."""
    import zstandard
    unpack = zstandard.ZstdDecompressor()
    for text, runs in zip(b.column("packed"), b.column("runs").to_pylist()):
        table = np.array([(r["lo"], r["hi"], r["whole"], r["open"]) for r in runs], np.int64).reshape(-1, 4)
        yield unpack.decompress(text.as_py()), table


def spread(runs: np.ndarray, extra: int = 0) -> np.ndarray:
    """All positions lo..hi+extra of the runs, ascending and distinct."""
    if not len(runs):
        return np.zeros(0, np.int64)
    size = runs[:, 1] - runs[:, 0] + 1 + extra
    offset = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out = np.repeat(runs[:, 0], size) + offset
    return np.unique(out) if extra else out


def _cut(unit: str, width: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        for b in batches:
            removed, spans, sha = [], [], []
            for (text, runs), more in zip(unpacked(b), b.column("starts")):
                codes, start, end = codes_of(text, unit)
                edge = np.zeros(len(codes) + 1, np.int64)
                whole = runs[runs[:, 2] == 1]
                np.add.at(edge, whole[:, 0], 1)
                np.add.at(edge, np.minimum(whole[:, 1] + width, len(codes)), -1)
                if more.is_valid:
                    at = more.values.to_numpy(zero_copy_only=False).astype(np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + width, len(codes)), -1)
                gone = np.cumsum(edge)[:-1] > 0
                removed.append(int(gone.sum()))
                spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                kept = (np.frombuffer(text, np.uint8)[~gone].tobytes() if unit == "byte"
                        else joined_words(text, start, end, np.flatnonzero(~gone)))
                sha.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_key"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array(sha, pa.string())], names=["doc_id", "text_key", "n_removed", "n_spans", "kept_sha256"])
    return cut


def removed(told: DataFrame, texts: DataFrame, starts: DataFrame, unit: str, width: int) -> DataFrame:
    """Row per input row: doc_id, n_units, n_removed, n_spans, kept_sha256; starts: doc_id, text_key, starts (arrays)."""
    per = starts.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    cut = texts.alias("t").join(per.alias("s"), same_doc("t", "s"), "left") \
        .select("t.doc_id", "t.text_key", "packed", "runs", "starts") \
        .mapInArrow(_cut(unit, width), "doc_id long, text_key long, n_removed long, n_spans long, kept_sha256 string")
    out = told.select("doc_id", "text_key", "n_units", "sha").alias("d").join(cut.alias("c"), same_doc("d", "c"), "left")
    return out.select("d.doc_id", "d.n_units", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
                      F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))
