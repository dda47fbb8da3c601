"""Ranked lexical search of a batch of items over all documents, by hashed max-sketches.

Terms are the maximal matches of TERM in the whole text, only A-Z lower-cased.  A term's weight and a document's length
factor give the term's impact in the document (a whole number); a score is the sum of an item's terms' impacts.

1. Every document is read once: its term count and the counts of those terms that some item holds (a document's other
   terms never enter a score) are written.  One aggregate gives the number of documents, of terms, and the document
   frequencies.
2. Batch by batch of documents, impacts fold into a sketch per document: WIDTH hashed slots, each the maximum of the
   impacts that fall into it.  An item looks up its terms' slots for the whole batch at once; their sum is an upper
   bound of its score, since a slot is never below any impact it holds.
3. Documents are rescored exactly in the order of falling bounds, until a bound lies below the item's k-th best score
   so far in the task.  A task hands on at most k rows per item; a rank window takes the best of them.

Items are taken in blocks of at most BLOCK_BYTES of text (measured first), so what goes to the driver and to every
task is bounded; each further block is a pass of its own over the documents.

Defined results: a NULL text, like one without terms, has none: such a document is not counted and no item without
terms finds anything; documents with score 0 aren't returned; rows that share an id are documents of their own and may
both appear; a NULL id loses ties; items that share an id each get a list under that id; extra columns are ignored; empty
tables give empty results.  A very long text is cut into pieces between terms, so counting it stays within memory.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, staged

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
PIECE = 1 << 20            # bytes of a text counted at a time
WIDTH = 4096               # slots of a sketch
CHUNK = 64                 # documents rescored at a time
BLOCK_BYTES = 1 << 23      # text of the items that share a pass
COUNTED = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item int, doc_id long, score long"


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a UTF-8 text (bytes above 0x7F belong to terms, so the pattern works on bytes)."""
    counts, at = Counter(), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = GAP.search(text, end)
            end = gap.start() if gap else len(text)
        counts.update(TERM.findall(text[at:end].lower()))        # bytes.lower changes A-Z only
        at = end
    return counts


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n: int, n_docs: int, n_terms: int) -> int:
    return 100 - 90 + 90 * n * n_docs // n_terms


def _counting(vocabulary: dict[bytes, int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, terms, times = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts = term_counts(text.as_buffer().to_pybytes())
                if counts:
                    known = sorted((vocabulary[t], c) for t, c in counts.items() if t in vocabulary)
                    ids.append(doc_id)
                    sizes.append(counts.total())
                    terms.append([t for t, _ in known])
                    times.append([c for _, c in known])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                                              pa.array(terms, ints), pa.array(times, ints)],
                                             names=["doc_id", "n", "terms", "counts"])
    return count


class Best:
    """The k best (score, doc_id) so far of one item."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    def floor(self) -> int:
        """Bounds below this can't enter the list any more."""
        return self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, scores: np.ndarray, ids: list) -> None:
        new = [(int(s), d) for s, d in zip(scores, ids) if s >= self.floor()]
        if new:
            self.rows = sorted(self.rows + new, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:self.k]


class Sketches:
    """Impacts of a batch of documents and their max-sketches."""

    def __init__(self, terms, sizes, impacts, n_terms: int, slots: np.ndarray, width: int):
        docs = np.repeat(np.arange(len(sizes)), sizes)
        self.n_terms, self.impacts = n_terms, impacts
        self.keys = docs * n_terms + terms                      # ascending: terms ascend inside a document
        self.slots = np.zeros((width, len(sizes)), np.int64)
        np.maximum.at(self.slots, (slots[terms], docs), impacts)

    def bounds(self, slots: np.ndarray) -> np.ndarray:
        """Upper bound of the score of every document for an item whose terms fall into these slots."""
        return self.slots[slots].sum(axis=0)

    def scores(self, docs: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Exact scores of some documents."""
        if not len(self.keys):
            return np.zeros(len(docs), np.int64)
        wanted = docs[:, None] * self.n_terms + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.impacts[at], 0).sum(axis=1)


def rescore(sketches: Sketches, ids: list, terms: np.ndarray, slots: np.ndarray, best: Best) -> int:
    """Exact scores by falling bounds until no bound reaches the list; returns how many documents were rescored."""
    bounds = sketches.bounds(slots)
    able = np.flatnonzero(bounds >= best.floor())
    able = able[np.argsort(-bounds[able], kind="stable")]
    done = 0
    while done < len(able) and bounds[able[done]] >= best.floor():
        some = able[done:done + CHUNK]
        best.add(sketches.scores(some, terms), [ids[d] for d in some])
        done += len(some)
    return done


def _searching(items: list[np.ndarray], weights: np.ndarray, slots: np.ndarray, n_docs: int, n_terms: int, k: int,
               width: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        looked_up = [slots[t] for t in items]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
            terms = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            times = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            factor = np.array([length_factor(n, n_docs, n_terms) for n in batch.column(1).to_pylist()], np.int64)
            impacts = weights[terms] * (1000000000 * times // (1000 * times + 8 * np.repeat(factor, sizes)))
            sketches = Sketches(terms, sizes, impacts, len(weights), slots, width)
            for i, item in enumerate(items):
                rescore(sketches, ids, item, looked_up[i], best[i])
        rows = [(i, d, s) for i, b in enumerate(best) for s, d in b.rows]
        columns = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))],
                                         names=["item", "doc_id", "score"])
    return search


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _block(texts: DataFrame, items: list, k: int, width: int) -> DataFrame:
    """The search for one block of items: a list of (item_id, text bytes)."""
    spark = texts.sparkSession
    counted = [(item_id, sorted(term_counts(text))) for item_id, text in items]
    words = sorted({t for _, terms in counted for t in terms})
    vocabulary = {t: i for i, t in enumerate(words)}
    docs = staged(texts.mapInArrow(_counting(vocabulary), COUNTED), "search-counts")
    total = docs.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total.docs or not words:
        return _empty(spark)
    found = docs.select(F.explode("terms").alias("term")).groupBy("term").count().collect()     # at most the vocabulary
    weights = np.zeros(len(words), np.int64)
    for row in found:
        weights[row["term"]] = weight(total.docs, row["count"])
    slots = np.array([zlib.crc32(t) % width for t in words], np.int64)
    asked = [np.array([vocabulary[t] for t in terms], np.int64) for _, terms in counted]
    hits = docs.mapInArrow(_searching(asked, weights, slots, total.docs, total.terms, k, width), FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(counted)], "item int, item_id long")
    return (hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH,
                  block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0, equal
    scores by ascending doc_id."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.col(f"`{text_col}`").cast("binary").alias("text")).filter("text IS NOT NULL")
    asked = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"),
                         F.col(f"`{item_text_col}`").cast("binary").alias("text")).filter("text IS NOT NULL")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for b in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else asked
        some = _block(texts, [(r.item_id, bytes(r.text)) for r in mine.collect()], k, width)
        out = some if out is None else out.union(some)
    return out
