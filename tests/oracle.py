"""Side-by-side check of a registered Spark query against its DuckDB oracle SQL.

Mirrors the driver's gate: same column names, same row count, same values
(order-insensitive; doubles compared after rounding to ``digits``).
"""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
if str(ROOT) not in sys.path:
    sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v, digits):
    if v is None:
        return "∅"
    try:
        import pandas as pd
        if v is pd.NaT or (not isinstance(v, (str, bytes, list, tuple)) and pd.isna(v)):
            return "∅"
    except (TypeError, ValueError):
        pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        r = round(v, digits)
        if r == 0:
            r = 0.0
        if r == int(r) and abs(r) < 1e15:
            return str(int(r))
        return repr(r)
    if hasattr(v, "item"):
        return _norm(v.item(), digits)
    if isinstance(v, int):
        return str(v)
    return str(v)


def rows_of(pdf, digits):
    cols = sorted(pdf.columns)
    rows = [tuple(_norm(v, digits) for v in rec) for rec in pdf[cols].itertuples(index=False, name=None)]
    return cols, sorted(rows)


def compare(spark, name: str, sf_dir: str, queries: dict, sqls: dict, digits: int = 5, con=None) -> tuple[bool, str]:
    sdf = queries[name](spark, sf_dir).toPandas()
    con = con or duck(sf_dir)
    odf = con.execute(sqls[name]).df()
    scols, srows = rows_of(sdf, digits)
    ocols, orows = rows_of(odf, digits)
    if scols != ocols:
        return False, f"columns differ: spark={scols} oracle={ocols}"
    if len(srows) != len(orows):
        return False, f"row count differs: spark={len(srows)} oracle={len(orows)}"
    if srows != orows:
        diff = [(a, b) for a, b in zip(srows, orows) if a != b][:3]
        return False, f"values differ (first): {diff}"
    return True, f"{len(srows)} rows"


if __name__ == "__main__":
    import time

    from __spark_entry__ import oracle_sql, queries
    from loom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:] or None
    spark = local_session()
    qs, sq = queries(), oracle_sql()
    con = duck(sf)
    bad = 0
    for n in qs:
        if only and n not in only:
            continue
        if n not in sq:
            t = time.time()
            rows = qs[n](spark, sf).count()
            print(f"ROWS  {n}: {rows} rows (no oracle) {time.time()-t:.1f}s", flush=True)
            continue
        t = time.time()
        try:
            ok, msg = compare(spark, n, sf, qs, sq, con=con)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK  ' if ok else 'FAIL'}  {n}: {msg} {time.time()-t:.1f}s", flush=True)
    print("failures:", bad)
