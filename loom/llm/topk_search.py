"""Exact top-k inner-product search by tiles.

Vectors are quantised (floor(scale * x), x as double) and packed into shards, small binary matrices sorted by id.
Shards are dealt to candidate groups, the query rows among them to query groups; a tile is one query group against one
candidate group.  A tile task multiplies its matrices in blocks, keeps the best k of each query, and tile lists are
merged in a tree, FAN_IN groups at a time, until one list per query is left.

Groups are sized by rows and bytes, so a tile's memory doesn't grow with the table; what moves is each shard once per
query group, each query once per candidate group, and k entries per query and tile.

Defined results: vectors that are NULL, or hold a NULL, NaN or infinite component, take no part; vectors of different
lengths are padded with zeros (an empty one scores 0); a row with a NULL id is a candidate that loses every tie and is
never a query; rows that share an id are rows of their own, as queries and as candidates (a query skips its own row
only); products are exact, and a score outside the range of a long counts as the nearest end of it.  Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, small_batches, staged

SHARD_ROWS = 1024
GROUP_ROWS, GROUP_QUERIES = 65_536, 16_384      # most rows of a tile's two sides
GROUP_BYTES = 1 << 26                           # most bytes of either, as doubles
TILE = 1 << 21                                  # scores computed at a time
LIST_ROWS = 512                                 # queries whose lists travel in one row
FAN_IN = 16
FOUND_ROWS = "query_id long, rank int, vec_id long, score long"
LOW, HIGH = -2 ** 63, 2 ** 63 - 1
EXACT = 2.0 ** 53                               # doubles add integers exactly below this
KNOWN, ASKED = 1, 2                             # flags of a row: it has an id, it is a query
FOUND, NO_ID, NOTHING = 0, 1, 2                 # states of a list's entry

_SHARD = pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("dim", pa.int32()), ("kind", pa.string()),
                    ("ids", pa.binary()), ("rows", pa.binary()), ("flags", pa.binary()), ("matrix", pa.binary())])
_LISTS = pa.schema([("block", pa.int64()), ("grp", pa.int64()), ("n", pa.int32()), ("queries", pa.binary()),
                    ("scores", pa.binary()), ("ids", pa.binary()), ("state", pa.binary())])
SHARD = "shard long, n int, dim int, kind string, ids binary, rows binary, flags binary, matrix binary"
LISTS = "block long, grp long, n int, queries binary, scores binary, ids binary, state binary"


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them (doubles where none does)."""
    peak = np.abs(values).max(initial=0)
    for kind, limit in (("int8", 127), ("int16", 32767), ("int32", 2 ** 31 - 1)):
        if peak <= limit:
            return values.astype(kind)
    return values


def _shard(number: int, ids: np.ndarray, rows: np.ndarray, flags: np.ndarray, matrix: np.ndarray) -> pa.RecordBatch:
    packed = _narrow(matrix)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(
            ([number], [len(ids)], [matrix.shape[1]], [packed.dtype.name], [ids.astype("int64").tobytes()],
             [rows.astype("int64").tobytes()], [flags.astype("int8").tobytes()], [packed.tobytes()]), _SHARD)],
        schema=_SHARD)


def _packing(scale: float):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = shard = TaskContext.get().partitionId() << 40       # unique over the table
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                ids, vectors, asked = batch.slice(at, SHARD_ROWS).columns
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                matrix = np.zeros((len(sizes), int(sizes.max(initial=0))))
                matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = np.floor(
                    scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
                flags = (np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, KNOWN)
                         + np.where(asked.to_numpy(zero_copy_only=False), ASKED, 0))
                yield _shard(shard, ids.fill_null(0).to_numpy(zero_copy_only=False),
                             np.arange(row, row + len(sizes)), flags, matrix)
                row, shard = row + len(sizes), shard + 1
    return pack


def _asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of the query rows alone; each takes the number of the first shard it was filled from."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if table.num_rows:
            ids, rows, flags, matrix = _opened(table)
            mine = np.flatnonzero(flags & ASKED)
            number = min(table.column("shard").to_pylist())
            for at in range(0, len(mine), SHARD_ROWS):
                m = mine[at:at + SHARD_ROWS]
                yield _shard(number + at // SHARD_ROWS, ids[m], rows[m], flags[m], matrix[m])


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, row numbers, flags and matrix of all shards of the table, ordered by id, rows without one last."""
    shards = table.to_pylist()
    dim = max(s["dim"] for s in shards)
    parts = []
    for s in shards:
        m = np.frombuffer(s["matrix"], s["kind"]).reshape(s["n"], s["dim"]).astype(np.float64)
        parts.append((np.frombuffer(s["ids"], "int64"), np.frombuffer(s["rows"], "int64"),
                      np.frombuffer(s["flags"], "int8"), np.pad(m, ((0, 0), (0, dim - s["dim"])))))
    ids, rows, flags, matrix = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((rows, ids, flags & KNOWN == 0))
    return ids[order], rows[order], flags[order], matrix[order]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of a and b (int64; beyond its range, its ends)."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(width, 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    big = np.dot(whole(a), whole(b).T)
    return np.frompyfunc(lambda x: min(max(x, LOW), HIGH), 1, 1)(big).astype(np.int64)


def best_columns(scores: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores per row, ties to the smaller column; own: a column left out, or -1.

    Columns come in any order and may include the one left out where there are no others.
    """
    n, width = scores.shape
    if width > k + 1:
        peak = max(abs(int(scores.max())), abs(int(scores.min())))
        if peak * width < 2 ** 62:
            unique = scores * width + (width - 1 - np.arange(width))
            here = np.flatnonzero(own >= 0)
            unique[here, own[here]] = LOW
            return np.argpartition(unique, width - k, axis=1)[:, width - k:]
        return np.argsort(~scores, axis=1, kind="stable")[:, :k + 1]
    return np.broadcast_to(np.arange(width), (n, width))


def _best_lists(queries, scores, ids, state, k: int) -> tuple[np.ndarray, ...]:
    """The first k entries of each query's list: higher scores, then smaller ids; padded with NOTHING."""
    order = np.lexsort((ids, state == NO_ID, ~scores, state == NOTHING), axis=1)[:, :k]
    out = [np.take_along_axis(x, order, axis=1) for x in (scores, ids, state)]
    short = ((0, 0), (0, max(0, k - out[0].shape[1])))
    return (queries, np.pad(out[0], short), np.pad(out[1], short), np.pad(out[2], short, constant_values=NOTHING))


def _list_row(block: int, grp: int, lists: tuple[np.ndarray, ...]) -> list:
    queries, scores, ids, state = lists
    return [block, grp, queries.shape[1], queries.astype("int64").tobytes(), scores.astype("int64").tobytes(),
            ids.astype("int64").tobytes(), state.astype("int8").tobytes()]


def _list_table(rows: list[list]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(_LISTS)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LISTS)], schema=_LISTS)


def _read_list(row: dict, k: int) -> tuple[np.ndarray, ...]:
    n = row["n"]
    return (np.frombuffer(row["queries"], "int64").reshape(2, n), np.frombuffer(row["scores"], "int64").reshape(n, k),
            np.frombuffer(row["ids"], "int64").reshape(n, k), np.frombuffer(row["state"], "int8").reshape(n, k))


def _tiling(k: int, spread: int):
    def tile(key: tuple[pa.Scalar, ...], asked: pa.Table, shards: pa.Table) -> pa.Table:
        if not asked.num_rows or not shards.num_rows:
            return _list_table([])
        query_ids, query_rows, _, queries = _opened(asked)
        ids, rows, flags, matrix = _opened(shards)
        by_row = np.argsort(rows)
        found = []
        for at in range(0, len(query_ids), max(1, TILE // len(ids))):
            mine = slice(at, at + max(1, TILE // len(ids)))
            scores = products(queries[mine], matrix)
            place = np.minimum(np.searchsorted(rows, query_rows[mine], sorter=by_row), len(rows) - 1)
            own = np.where(rows[by_row[place]] == query_rows[mine], by_row[place], -1)
            columns = best_columns(scores, own, k)
            state = np.where(columns == own[:, None], NOTHING, np.where(flags[columns] & KNOWN, FOUND, NO_ID))
            found.append(_best_lists(np.stack([query_rows[mine], query_ids[mine]]),
                                     np.take_along_axis(scores, columns, axis=1), ids[columns], state, k))
        queries, scores, out_ids, state = (np.concatenate(x, axis=1 if i == 0 else 0)
                                           for i, x in enumerate(zip(*found)))
        group, grp = key[0].as_py(), key[1].as_py()
        # the queries of a group come in the same order in all its tiles, so a block holds the same ones everywhere
        return _list_table([
            _list_row(group * spread + at // LIST_ROWS, grp, (queries[:, at:at + LIST_ROWS], *(
                x[at:at + LIST_ROWS] for x in (scores, out_ids, state))))
            for at in range(0, queries.shape[1], LIST_ROWS)])
    return tile


def _merging(k: int):
    def merge(key: tuple[pa.Scalar, ...], lists: pa.Table) -> pa.Table:
        block, grp = key[0].as_py(), key[1].as_py()
        read = [_read_list(r, k) for r in lists.to_pylist()]
        parts = [np.concatenate([r[i] for r in read], axis=1) for i in (1, 2, 3)]
        return _list_table([_list_row(block, grp, _best_lists(read[0][0], *parts, k))])
    return merge


def _unpacking(k: int):
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                queries, scores, ids, state = _read_list(row, k)
                at, rank = np.nonzero(state != NOTHING)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[1][at]), pa.array(rank + 1, pa.int32()),
                     pa.array(ids[at, rank], mask=state[at, rank] == NO_ID), pa.array(scores[at, rank])],
                    names=["query_id", "rank", "vec_id", "score"])
    return unpack


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of every query row, ties to the
    smaller id.  is_query is a condition on the column ``vec_id`` (the id under that name)."""
    spark = vectors.sparkSession
    small_batches(spark)
    vector = F.col(f"`{vec_col}`").cast("array<double>")
    fit = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (vectors.filter(vector.isNotNull() & fit)
            .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("vector"))
            .withColumn("asked", F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull()))
    shards = staged(rows.mapInArrow(_packing(scale), SHARD), "topk-shards")
    size = shards.agg(F.sum("n").alias("n"), F.max("dim").alias("dim")).first()
    queries = staged(shards.mapInArrow(_asking, SHARD), "topk-queries")
    n_queries = queries.agg(F.sum("n")).first()[0]
    if not n_queries:
        return spark.createDataFrame([], FOUND_ROWS)
    fit_rows = max(SHARD_ROWS, GROUP_BYTES // (8 * max(size.dim, 1)))
    # no more rows in a group than fit; at least as many groups as shuffle partitions where there are rows enough
    groups = -(-size.n // min(GROUP_ROWS, fit_rows, max(SHARD_ROWS, size.n // shuffle_width(spark))))
    query_groups = -(-n_queries // min(GROUP_QUERIES, fit_rows))

    def dealt(table: DataFrame, own: str, own_n: int, other: str, other_n: int) -> DataFrame:
        return (table.withColumn(own, F.pmod(F.xxhash64("shard"), F.lit(own_n)))
                .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other_n - 1).cast("long")))))
    lists = (dealt(queries, "query_group", query_groups, "grp", groups).groupBy("query_group", "grp")
             .cogroup(dealt(shards, "grp", groups, "query_group", query_groups).groupBy("query_group", "grp"))
             .applyInArrow(_tiling(k, 1 << 32), LISTS))
    while groups > 1:
        groups = -(-groups // FAN_IN)
        lists = (lists.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("long")).groupBy("block", "grp")
                 .applyInArrow(_merging(k), LISTS))
    return lists.mapInArrow(_unpacking(k), FOUND_ROWS)
