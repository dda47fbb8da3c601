"""Token counts through a digest cache.

Texts are joined by (content digest, tokenizer digest) to a stored table of counts; only distinct contents without a
stored count are encoded, and their counts are appended to the cache, each run as one Parquet commit.  The tokenizer
digest covers the vocabulary file and the library's version, so another version never meets old counts.

Texts travel to the encoder once per distinct content, compressed.  A content that many rows share is one row after map-side
combining.  Encoding runs in Arrow batches inside the tasks.

Defined results: NULL text = empty text = 0 tokens; repeated rows share one count; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_of

LIMIT = 4096
CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + b"sentencepiece" + version("sentencepiece").encode()).hexdigest()


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        import zstandard
        model, unpack = sentencepiece.SentencePieceProcessor(model_file=path), zstandard.ZstdDecompressor()
        for b in batches:
            counts = [len(model.encode(unpack.decompress(x.as_py()).decode(), num_threads=1))
                      for x in b.column("packed")]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())],
                                             names=["digest", "n_tokens"])
    return encode


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    pack = zstandard.ZstdCompressor(level=1, write_content_size=True)
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column("digest"), pa.array([pack.compress(x.as_py().encode()) for x in b.column("text")], pa.binary())],
            names=["digest", "packed"])


def count_tokens(docs: DataFrame, model_path: str, cache_dir: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit; fills the cache at cache_dir."""
    spark = docs.sparkSession
    small_batches(spark)
    tokenizer = tokenizer_digest(model_path)
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"),
                       F.sha2(text, 256).alias("digest"), text.alias("text"))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_dir)   # a first run finds an empty cache
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).filter(F.col("tokenizer") == tokenizer) \
        .groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    misses = (base.select("digest", "text").mapInArrow(_packed, "digest string, packed binary")
              .join(stored.select("digest"), "digest", "left_anti")
              .groupBy("digest").agg(F.first("packed").alias("packed")))
    fresh = misses.mapInArrow(_encoder(model_path), "digest string, n_tokens long")
    fresh.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_dir)
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).filter(F.col("tokenizer") == tokenizer) \
        .groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return base.select("doc_id", "n_bytes", "digest").join(known, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
