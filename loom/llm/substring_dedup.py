"""Substring dedup by level-wise doubling.

Removes each word covered by a window of ``width`` words whose word sequence also starts earlier (smaller id, or same document and
earlier start).  Among the runs that can repeat (see ``repeats``), windows are judged level by level: windows of ``width`` / 4 words
that repeat alone survive; a window of twice that length is tried only where both its halves survived; and so on up to
``width``, or until no candidates survive.  At the last level the first occurrence of every repeated window is found and the later ones
cover their words.  Each level shuffles hashes only, counted with map-side combining.

Steps, and what each moves:

* the anchors alone are counted; only runs whose anchor occurs twice are written with their contexts and places;
* a run of equal anchor and context as an earlier one (two 64-bit hashes) repeats as a whole; the first run of a context that
  shares its anchor with other contexts is opened: its word codes leave the text once, as a piece;
* pieces are judged once more by longer anchors, then window by window by doubling; no step after the first reads texts;
* at the end each text meets the spans that go.

Defined results: NULL text = no words; texts shorter than a window lose nothing; rows that share an id are one document
for the order (only the start counts); a NULL id comes last; repeated rows are judged alike; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged, text_of
from .hashing import U, mixed, prefix_sums, rolling, spans_hash, window_minima, word_codes
from .repeats import HIGH, LOW, _packed, place, same_doc

WIDTH = 20
GRAIN, FINER = 8, 14         # words of an anchor, at first and inside what it leaves open
CHUNK = 1 << 18              # bytes of text hashed in one go; a longer text is a chunk of its own
RUN = "anchor long, context long, doc_id long, text_key long, piece int, lo int, hi int"


def chunks(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive rows first..last (exclusive) of together at most ``limit``, one row at least."""
    first, have = 0, 0
    for row, size in enumerate(sizes):
        if row > first and have + size > limit:
            yield first, row
            first, have = row, 0
        have += size
    if first < len(sizes):
        yield first, len(sizes)


def chunk_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts in a row, and the first word of each text (with the end)."""
    codes, start, _ = word_codes(np.frombuffer(b" ".join(texts), np.uint8))
    begin = np.cumsum([0] + [len(t) + 1 for t in texts])
    return codes, np.searchsorted(start, begin)


def chunk_runs(codes: np.ndarray, edge: np.ndarray, width: int, grain: int) -> tuple[np.ndarray, ...]:
    """(owner, anchor hash, context hash, first window, last window) of each run; owner k has the codes edge[k]..edge[k + 1].

    Windows never cross owners; first and last window are counted from the owner's first code.
    """
    owner = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    at = np.flatnonzero(owner[:len(owner) - width + 1] == owner[width - 1:]) if len(owner) >= width else owner[:0]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none.astype(U), none.astype(U), none, none
    sums = prefix_sums(codes)
    pieces = rolling(sums, grain)
    marked = (pieces & HIGH) | np.arange(len(pieces), dtype=U)
    anchor = (window_minima(marked, width - grain + 1)[at] & LOW).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[at[1:]] != owner[at[:-1]])])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)
    lo, hi, anchor = at[new], at[last], anchor[new]
    context = mixed(spans_hash(sums, lo, hi + width) + mixed((anchor - lo).astype(U)))
    whose = owner[lo]
    return whose, pieces[anchor], context, lo - edge[whose], hi - edge[whose]


def _texts(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word codes, edges) of each chunk of a batch."""
    texts = [t.as_py().encode() for t in b.column("text")]
    for first, last in chunks([len(t) for t in texts]):
        yield first, *chunk_codes(texts[first:last])


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same of a batch of pieces."""
    column = b.column("codes")
    edge = column.offsets.to_numpy().astype(np.int64)
    codes = column.values.to_numpy(zero_copy_only=False).view(U)
    for first, last in chunks((8 * np.diff(edge)).tolist()):
        yield first, codes[edge[first]:edge[last]], edge[first:last + 1] - edge[first]


def _anchors(read, width: int, grain: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [chunk_runs(codes, edge, width, grain)[1] for _, codes, edge in read(b)]
            if found:
                anchor, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n)], names=["anchor", "n"])
    return count


def _runs(read, width: int, grain: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, codes, edge in read(b):
                whose, anchor, context, lo, hi = chunk_runs(codes, edge, width, grain)
                row = pa.array(whose + first)
                piece = (b.column("lo").take(row).to_numpy() if "lo" in b.schema.names else np.zeros(len(lo), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), b.column("doc_id").take(row),
                     b.column("text_key").take(row), pa.array(piece.astype(np.int32)),
                     pa.array((piece + lo).astype(np.int32)), pa.array((piece + hi).astype(np.int32))],
                    names=["anchor", "context", "doc_id", "text_key", "piece", "lo", "hi"])
    return runs


def judged(table: DataFrame, read, width: int, grain: int) -> DataFrame:
    """Runs that repeat or must be opened (staged): doc_id, text_key, piece, lo, hi, open.

    open: the first run of a context beside other contexts of its anchor; all others repeat as a whole.
    """
    repeated = (table.mapInArrow(_anchors(read, width, grain), "anchor long, n long")
                .groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"))
    repeated = staged(repeated, "substring-anchors")     # a join of two plain shuffles is one that can be split
    live = staged(table.mapInArrow(_runs(read, width, grain), RUN).join(repeated, "anchor", "left_semi"), "substring-live")
    contexts = live.groupBy("anchor", "context").agg(F.min(place("lo")).alias("first"))
    kinds = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
    is_first = place("lo") == F.col("first")
    return staged(live.join(contexts.join(kinds, "anchor"), ["anchor", "context"])
                  .filter(~is_first | (F.col("kinds") > 1))
                  .select("doc_id", "text_key", "piece", "lo", "hi", is_first.alias("open")), "substring-marks")


def _cut_out(width: int):
    """The word codes under each open run."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            texts = [unpack.decompress(t.as_py()) for t in b.column("packed")]
            spans = b.column("spans")
            ends = spans.offsets.to_numpy().astype(np.int64)
            lo, hi = (spans.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            for first, last in chunks([len(t) for t in texts]):
                codes, edge = chunk_codes(texts[first:last])
                mine = slice(ends[first], ends[last])
                row = np.repeat(np.arange(first, last), np.diff(ends[first:last + 1]))
                size = hi[mine] - lo[mine] + width
                off = np.append(0, np.cumsum(size))
                at = np.arange(off[-1]) + np.repeat(edge[row - first] + lo[mine] - off[:-1], size)
                values = pa.array(codes[at].view(np.int64))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(rows), b.column("text_key").take(rows), pa.array(lo[mine].astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)],
                    names=["doc_id", "text_key", "lo", "codes"])
    return cut


def _level(size: int, width: int, first: bool):
    """Windows of ``size`` words: at the first level all inside open spans, later those with two surviving halves.

    ``off`` counts from the piece's first code; the last level adds what places a window in its document.
    """
    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            column, spans = b.column("codes"), b.column("spans")
            edge = column.offsets.to_numpy().astype(np.int64)
            codes = column.values.to_numpy(zero_copy_only=False).view(U)[edge[0]:edge[-1]]
            edge = edge - edge[0]
            piece = b.column("lo").to_numpy().astype(np.int64)

            def on_codes(lists: pa.ListArray, values: np.ndarray, start: np.ndarray) -> np.ndarray:
                ends = lists.offsets.to_numpy().astype(np.int64)
                return values[ends[0]:ends[-1]] + np.repeat(start, np.diff(ends))
            inside = np.zeros(len(codes) + 1, np.int64)
            np.add.at(inside, on_codes(spans, spans.values.field(0).to_numpy(), edge[:-1] - piece), 1)
            np.add.at(inside, on_codes(spans, spans.values.field(1).to_numpy(), edge[:-1] - piece) + width - size + 1, -1)
            here = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
            if not first:
                alive = np.zeros(len(codes) + 1, bool)
                alive[on_codes(b.column("alive"), b.column("alive").values.to_numpy(zero_copy_only=False), edge[:-1])] = True
                here = here[alive[here] & alive[here + size // 2]]
            row = np.searchsorted(edge, here, "right") - 1
            rows, off, sums = pa.array(row), here - edge[row], prefix_sums(codes)
            out = {"key": pa.array(spans_hash(sums, here, here + size).view(np.int64)), "id": b.column("id").take(rows),
                   "off": pa.array(off.astype(np.int32))}
            if size == width:
                out |= {"lead": pa.array(spans_hash(sums, here, here + (size + 1) // 2).view(np.int64)),
                        "doc_id": b.column("doc_id").take(rows), "text_key": b.column("text_key").take(rows),
                        "at": pa.array((piece[row] + off).astype(np.int32))}
            yield pa.RecordBatch.from_pydict(out)
    return level


def same_piece(left: str, right: str):
    return same_doc(left, right) & (F.col(f"{left}.lo") == F.col(f"{right}.piece"))


def later_starts(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_key, at: windows inside the open spans of the pieces (numbered by ``id``) whose words also start earlier.

    Windows count as equal on 128 bits: the hash of all their words and that of the first half.  The levels before the last
    are a screen on the first hash alone.
    """
    brief, full = "key long, id long, off int", "key long, id long, off int, lead long, doc_id long, text_key long, at int"
    size = width // 4 if width % 4 == 0 else width
    found = pieces.mapInArrow(_level(size, width, True), full if size == width else brief)
    while True:
        found = staged(found, f"doubling-{size}")
        if size == width:
            break
        repeated = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
        alive = found.join(repeated, "key", "left_semi").groupBy("id").agg(F.collect_list("off").alias("alive"))
        size *= 2
        found = pieces.join(alive, "id").mapInArrow(_level(size, width, False), full if size == width else brief)
    first = found.groupBy("key", "lead").agg(F.count(F.lit(1)).alias("n"), F.min(place("at")).alias("first")).filter("n > 1")
    return found.join(first, ["key", "lead"]).filter(place("at") > F.col("first")).select("doc_id", "text_key", "at")


def _spans(marks: DataFrame, *keys: str) -> DataFrame:
    return marks.groupBy("doc_id", "text_key", *keys).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _removed(width: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        import zstandard
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            n_words, n_removed, n_spans, sha = [], [], [], []
            for packed, spans in zip(b.column("packed"), b.column("spans")):
                words = unpack.decompress(packed.as_py()).split()
                n_words.append(len(words))
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, spans.values.field(0).to_numpy(), 1)
                    np.add.at(edge, spans.values.field(1).to_numpy() + width, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                    n_spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
                else:
                    n_spans.append(0)
                n_removed.append(n_words[-1] - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(n_spans, pa.int64()), pa.array(sha, pa.string())],
                names=["doc_id", "n_words", "n_removed", "n_spans", "kept_sha256"])
    return remove


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    grain: int = GRAIN) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, n_spans, kept_sha256 (kept words joined by one space)."""
    small_batches(docs.sparkSession)
    grain = min(grain, width)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")) \
        .withColumn("text_key", F.xxhash64("text"))
    packed = rows.mapInArrow(_packed, "doc_id long, text_key long, packed binary")
    coarse = judged(rows, _texts, width, grain)
    pieces = staged(packed.alias("t").join(_spans(coarse.filter("open")).alias("p"), same_doc("t", "p"))
                    .select("t.doc_id", "t.text_key", "packed", "spans")
                    .mapInArrow(_cut_out(width), "doc_id long, text_key long, lo int, codes array<long>"), "substring-pieces")
    finer = judged(pieces, _pieces, width, max(grain, width * FINER // WIDTH))
    opened = staged(pieces.alias("t").join(_spans(finer.filter("open"), "piece").alias("p"), same_piece("t", "p"))
                    .select(F.monotonically_increasing_id().alias("id"), "t.doc_id", "t.text_key", "t.lo", "codes", "spans"),
                    "substring-opened")
    gone = (coarse.unionByName(finer).filter("not open").select("doc_id", "text_key", "lo", "hi")
            .unionByName(later_starts(opened, width).select("doc_id", "text_key", F.col("at").alias("lo"), F.col("at").alias("hi"))))
    return packed.alias("t").join(_spans(gone).alias("p"), same_doc("t", "p"), "left") \
        .select("t.doc_id", "packed", "spans") \
        .mapInArrow(_removed(width), "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string")
