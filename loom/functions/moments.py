"""Mean vector and co-moment matrix of any number of columns in one pass.

Each task keeps one count, one mean vector and one matrix of centred cross
products, updated batch by batch (a matrix product per Arrow batch).  Two such
records merge exactly (pairwise update of centred sums), so the records, one
per task, merge in two steps; a merge step streams its records and holds two.
Nothing of it passes the driver.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import col

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # tasks need not find this module

MERGED_AT_ONCE = 256
_RECORD = "grp long, n long, mean binary, cross binary"
_FIELDS = pa.schema([("grp", pa.int64()), ("n", pa.int64()), ("mean", pa.binary()), ("cross", pa.binary())])


class Moments:
    """Count, means and centred cross products of k columns."""

    def __init__(self, k: int):
        self.n, self.mean, self.cross = 0, np.zeros(k), np.zeros((k, k))

    def merge(self, n: int, mean: np.ndarray, cross: np.ndarray) -> None:
        if not n:
            return
        total = self.n + n
        shift = mean - self.mean
        self.cross += cross + np.outer(shift, shift) * (self.n * n / total)
        self.mean = self.mean + shift * (n / total)
        self.n = total

    def add(self, rows: np.ndarray) -> None:
        if len(rows):
            mean = rows.mean(axis=0)
            centred = rows - mean
            self.merge(len(rows), mean, centred.T @ centred)

    def record(self, grp: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([grp]), pa.array([self.n]), pa.array([self.mean.tobytes()]),
                                           pa.array([self.cross.tobytes()])], schema=_FIELDS)


def _measuring(k: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(k)
        for batch in batches:
            with np.errstate(invalid="ignore", over="ignore"):
                rows = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
                missing = np.isnan(rows).any(axis=1)
                own.add(rows[~missing] if missing.any() else rows)
        yield own.record(TaskContext.get().partitionId() // MERGED_AT_ONCE)
    return measure


def _merging(k: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Moments(k)
        for batch in batches:
            for n, mean, cross in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                with np.errstate(invalid="ignore", over="ignore"):
                    own.merge(n, np.frombuffer(mean), np.frombuffer(cross).reshape(k, k))
        yield own.record(0)
    return merge


def _correlating(names: Sequence[str]):
    k = len(names)

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cross in batch.column(3).to_pylist():
                m = np.frombuffer(cross).reshape(k, k)
                spread = np.sqrt(np.diag(m))
                for i in range(k):
                    with np.errstate(invalid="ignore", divide="ignore"):
                        r = m[i, i:] / (spread[i] * spread[i:])
                    values = [float(v) if math.isfinite(v) else None for v in np.clip(r, -1.0, 1.0)]
                    values[0] = 1.0                   # a column correlates fully with itself, constant or not
                    yield pa.RecordBatch.from_arrays([pa.array([names[i]] * (k - i)), pa.array(list(names[i:])),
                                                      pa.array(values, pa.float64())], names=["x", "y", "r"])
    return correlate


def correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x, y, r) for x up to and including y over the rows of ``df`` that hold no NULL or NaN in ``cols``.

    Incomplete rows are left out batch by batch: a filter on computed columns would compute each of them twice more.
    The row travels as one array, whose ``transform`` also keeps the projection out of whole-stage code: there many
    computed columns make one method too long to be compiled.

    r is NULL where a column doesn't vary (or there are no rows), and 1 for a column with itself.
    """
    k = len(cols)
    wide = df.select(F.transform(F.array(*[col(c).cast("double") for c in cols]),
                                 lambda x: F.coalesce(x, F.lit(float("nan")))).alias("row"))
    nothing = Moments(k).record(0)           # an empty table has no tasks: its record comes from here
    none = df.sparkSession.createDataFrame(
        [tuple(nothing.column(i)[0].as_py() for i in range(4))], _RECORD)
    records = wide.mapInArrow(_measuring(k), _RECORD).union(none)
    some = records.groupBy("grp").applyInArrow(_merging(k), _RECORD)
    whole = some.groupBy("grp").applyInArrow(_merging(k), _RECORD)
    return whole.mapInArrow(_correlating(list(cols)), "x string, y string, r double")
