"""Mixing sources to target weights [native].

Each source's documents form one token stream, cut into blocks of ``block`` words.  Targets share the total by the
repeating weights 5, 2, 1 over the sources in code-point order (NULL last), none above ``cap`` times its source.  The
mix is a deck with one slot per taken block; a pseudorandom permutation deals the deck to output shards of
``shard_slots`` slots.  The counts of the sources in a shard are thereby a multinomial draw conditioned on the sources'
quotas, so a source's taken words equal its rounded target and do not merely approach it.  A source's slots run through
its block indices in pseudorandom order, once per pass (another permutation for every pass), and blocks join by index.

Permutations are swap-or-not networks on any domain size (one hash a round), so slots are made on the fly: nothing is
ranked or sorted.  Stream offsets come from two-level running sums (hashed chunks, about sqrt(rows) of them), so a source
that holds most rows is spread over many window partitions.  Only the per-source table (one row a source) is ever in
a single window.

Defined results: NULL text or no words: size 0, taken 0; repeated rows are separate documents; a source without words has
target 0; an empty table gives an empty result; reruns agree (hashes only, no randomness).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, shuffle_width, staged, text_of

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 256            # words of a block
SHARD_SLOTS = 4096     # slots of an output shard
ROUNDS = 16
CHUNK_SLOTS = 1024     # slots generated by one row


def _permuted(x: Column, n: Column, seed: Column, inverse: bool = False) -> Column:
    """Pseudorandom permutation of 0..n-1 (swap-or-not); each round is an involution, so the inverse runs backwards."""
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(v: Column, r: Column) -> Column:
        # key - v mod n, written without overflow
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - v, n)
        return F.when(F.pmod(F.xxhash64(seed, r, F.greatest(v, other), F.lit(1)), F.lit(2)) == 1, other).otherwise(v)

    return F.aggregate(rounds, x.cast("long"), step)


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: weights shared over the sources, none above CAP times its size.

    Resharing the excess until no source is above its cap ends in target = min(cap, level x weight): with sources in
    order of cap / weight, the level is the first (total - caps before) / (weights from here on) at most cap / weight.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    weighted = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]),
                                                     F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1))
    ratio = F.col("source_size") * F.lit(float(CAP)) / F.col("weight")
    by_ratio = Window.orderBy(ratio, F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (weighted
              .withColumn("total", F.sum("source_size").over(everything))
              .withColumn("ratio", ratio)
              .withColumn("level", (F.col("total") - CAP * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
                          / F.sum("weight").over(after)))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)   # the first of them
    return ranked.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(
        F.least(F.col("source_size") * F.lit(float(CAP)), level * F.col("weight"))).alias("target"))


def _quotas(goal: DataFrame, block: int, seed: int) -> DataFrame:
    """Per source: blocks, length of its last block, slots to take, words of the last slot, place in the deck."""
    words = F.round("target").cast("long")
    goal = (goal.filter("source_size > 0")
            .withColumn("seed", F.xxhash64(F.lit(seed), F.col("source").isNull(), F.coalesce("source", F.lit(""))))
            .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)))
            .withColumn("short", F.col("source_size") - (F.col("blocks") - 1) * block)
            .withColumn("words", F.least(words, F.col("source_size") * CAP))
            .withColumn("passes", F.floor(F.col("words") / F.col("source_size")))
            .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size")))
    # where the short last block comes up in the last, partial pass
    pass_seed = F.xxhash64("seed", "passes")
    goal = goal.withColumn("short_at", _permuted(F.col("blocks") - 1, F.col("blocks"), pass_seed, inverse=True))
    at_short = F.col("short_at") * block
    grown = F.col("rest") + F.when(F.col("rest") > at_short + F.col("short"), block - F.col("short")).otherwise(F.lit(0))
    goal = (goal.withColumn("extra", F.ceil(grown / F.lit(block)))
            .withColumn("tail", F.when(F.col("extra") == 0, F.lit(0)).otherwise(grown - (F.col("extra") - 1) * block))
            .withColumn("slots", F.col("passes") * F.col("blocks") + F.col("extra")))
    running = Window.orderBy(F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (goal.withColumn("deck_at", F.coalesce(F.sum("slots").over(running), F.lit(0)))
            .withColumn("deck", F.sum("slots").over(everything)))


def dealt_slots(goal: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> DataFrame:
    """One row per slot of the mix: shard, slot, source, block index, words taken from that block's start."""
    quota = _quotas(goal, block, seed)
    chunks = quota.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(
        (F.col("slots") - 1) / F.lit(CHUNK_SLOTS))))).filter("slots > 0").repartition(shuffle_width(goal.sparkSession), "source", "chunk")
    first = F.col("chunk") * CHUNK_SLOTS
    each = chunks.withColumn("j", F.explode(F.sequence(
        first, F.least(first + CHUNK_SLOTS, F.col("slots")) - 1)))
    each = each.withColumn("turn", F.floor(F.col("j") / F.col("blocks"))) \
        .withColumn("place", _permuted(F.col("deck_at") + F.col("j"), F.col("deck"), F.lit(seed)))
    index = _permuted(F.pmod(F.col("j"), F.col("blocks")), F.col("blocks"), F.xxhash64("seed", "turn"))
    upto = F.when((F.col("extra") > 0) & (F.col("j") == F.col("slots") - 1), F.col("tail")).otherwise(F.lit(block))
    return each.select(F.floor(F.col("place") / F.lit(shard_slots)).alias("shard"),
                       F.pmod(F.col("place"), F.lit(shard_slots)).alias("slot"),
                       "source", index.alias("block"), upto.cast("long").alias("upto"))


def streamed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size and the document's start in its source's stream (by hashed chunk, then id)."""
    text = text_of(text_col)
    sized = staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                               F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
                               F.xxhash64(text).alias("text_key")), "mix-sizes")
    chunks = max(1, math.isqrt(sized.count()))
    sized = sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(chunks)))
    per_chunk = sized.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select("source", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("chunk_at"))
    inside = Window.partitionBy("source", "chunk").orderBy(F.asc_nulls_last("doc_id"), "text_key", "size")
    rows = (sized.withColumn("nth", F.row_number().over(inside))
            .withColumn("inner_at", F.coalesce(F.sum("size").over(
                inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    rows, offsets = rows.alias("r"), offsets.alias("o")
    return (rows.join(offsets, F.col("r.source").eqNullSafe(F.col("o.source")) & (F.col("r.chunk") == F.col("o.chunk")))
            .select("r.doc_id", "r.source", "r.chunk", "r.nth", "r.size",
                    (F.col("chunk_at") + F.col("inner_at")).alias("start")))


def mix_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(plan, documents).  plan: one row per piece of a dealt block - shard, slot, doc_id, from_word, to_word (0-based,
    end exclusive, within the document); documents: doc_id, size, source_size, target, taken."""
    placed = staged(streamed(docs, id_col, text_col, source_col), "mix-stream")
    goal = staged(targets(placed), "mix-targets")
    end = F.col("start") + F.col("size")
    pieces = (placed.filter("size > 0")
              .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.lit(block)),
                                                        F.floor((end - 1) / F.lit(block)))))
              .withColumn("at", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)))
              .withColumn("upto_doc", F.least(end - F.col("block") * block, F.lit(block))))
    slots = dealt_slots(goal, block, shard_slots, seed)
    # the slots come from a few rows, so the optimiser takes them for small; they grow with the mix and are never broadcast
    joined = pieces.alias("p").join(slots.hint("merge").alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))
                                    & (F.col("p.block") == F.col("s.block")))
    last = F.least(F.col("upto_doc"), F.col("upto"))
    shift = F.col("p.block") * block - F.col("start")
    plan = joined.filter(last > F.col("at")).select(
        "shard", "slot", "p.doc_id", "p.source", "chunk", "nth", "size",
        (F.col("at") + shift).alias("from_word"), (last + shift).alias("to_word"))
    none = placed.select("doc_id", "source", "chunk", "nth", "size", F.lit(0).cast("long").alias("words"))
    took = plan.select("doc_id", "source", "chunk", "nth", "size",
                       (F.col("to_word") - F.col("from_word")).alias("words"))
    per = none.unionByName(took).groupBy("source", "chunk", "nth", "doc_id", "size") \
        .agg(F.sum("words").alias("taken")).alias("d")
    mixed = per.join(F.broadcast(goal).alias("g") if goal.count() <= 100_000 else goal.alias("g"),
                     F.col("d.source").eqNullSafe(F.col("g.source"))) \
        .select("d.doc_id", "d.size", "g.source_size", "g.target", "d.taken")
    return plan.select("shard", "slot", "doc_id", "from_word", "to_word"), mixed


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target (its source's), taken (words, repeats counted)."""
    return mix_blocks(docs, **options)[1]
