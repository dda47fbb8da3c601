"""Projection and type operators (C1-C3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import col, is_numeric, one_row
from ..fixed import NUMERIC_TEXT
from ..workspace import OSUF, Workspace



# C1 -----------------------------------------------------------------------------------
def drop_features(ws: Workspace, cols) -> Workspace:
    """Drop columns from both copies."""
    ws.check_open()
    cols = [cols] if isinstance(cols, str) else list(cols)
    unknown = [c for c in cols if c not in ws.raw and c not in ws.work]
    if unknown:
        raise ValueError(f"unknown column(s): {unknown}")
    phys = set()
    for c in cols:
        p = ws.wcol(c)
        phys |= {c, p, c + OSUF, p + OSUF}
    out = ws.df.select(*[col(x) for x in ws.df.columns if x not in phys])
    return ws.evolve(out, raw=tuple(c for c in ws.raw if c not in cols),
                     work=tuple(c for c in ws.work if c not in cols),
                     phys={k: v for k, v in ws.phys.items() if k not in cols},
                     tags={k: v for k, v in ws.tags.items() if k not in cols})


def number_text(x: Column) -> Column:
    """Number -> text the way R prints it (5 not 5.0)."""
    # integers and decimals keep every digit; only floating values go through double
    d = x.cast("double")
    text = x.cast("string")
    integral = F.typeof(x).isin("tinyint", "smallint", "int", "bigint")
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(1e15))
    fixed = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(integral, text).when(F.typeof(x).startswith("decimal"), fixed).when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))


def _factor_meta(origin: str) -> dict:
    return {"role": "factor", "origin": origin}


def _copies(ws: Workspace, c: str) -> list[str]:
    """Physical columns holding the raw and the working copy of ``c`` (one when shared)."""
    out = [c] if c in ws.raw else []
    if c in ws.work and ws.wcol(c) not in out:
        out.append(ws.wcol(c))
    return out


# C2 -----------------------------------------------------------------------------------
def num_to_cat(ws: Workspace, cols) -> Workspace:
    """Numeric -> categorical (factor) in both copies; original values kept for restoration."""
    ws.check_open()
    cols = [cols] if isinstance(cols, str) else list(cols)
    ws.require(cols)
    mapping, extra = {}, []
    for c in cols:
        if not is_numeric(ws.df, c):
            raise ValueError(f"{c!r} is not numeric")
        for p in _copies(ws, c):
            origin = ws.df.schema[p].dataType.simpleString()
            mapping[p] = number_text(col(p)).alias(p, metadata=_factor_meta(origin))
            extra.append(col(p).alias(p + OSUF))
    out = ws.df.select(*[mapping.get(x, col(x)) for x in ws.df.columns], *extra)
    return ws.evolve(out)


def _restored(df, p: str) -> Column:
    """The kept original of an untouched value, the number in a changed one; codes of an encoder give the original."""
    origin, now = df.schema[p + OSUF].dataType, df.schema[p].dataType
    if not isinstance(now, T.StringType):
        return col(p + OSUF)
    return F.when(number_text(col(p + OSUF)).eqNullSafe(col(p)), col(p + OSUF)).otherwise(col(p).try_cast(origin))


# C3 -----------------------------------------------------------------------------------
def cat_to_num(ws: Workspace, cols) -> tuple[Workspace, list[str], list[str]]:
    """Categorical -> numeric.

    Restores kept originals where the value is still the one they gave (a value that
    cleaning changed since is converted); otherwise converts only if every
    non-missing working value matches ``^[0-9.-]+$`` (strings such as ``1-2``
    pass the pattern and become NULL); columns that fail are reported and left
    unchanged.  One aggregate pass checks all columns.
    """
    ws.check_open()
    cols = [cols] if isinstance(cols, str) else list(cols)
    ws.require(cols)
    restore = [c for c in cols if c + OSUF in ws.df.columns]
    test = [c for c in cols if c not in restore]
    bad = {}
    if test:
        checks = []
        for c in test:
            w = col(ws.wcol(c))
            checks.append(F.count_if(w.isNotNull() & ~w.cast("string").rlike(NUMERIC_TEXT)).alias(c))
        row = one_row(ws.df, checks)
        bad = {c: row[c] for c in test}
    converted = restore + [c for c in test if bad[c] == 0]
    failed = [c for c in test if bad[c] != 0]
    mapping = {}
    drop = set()
    for c in restore:
        for p in _copies(ws, c):
            if p + OSUF in ws.df.columns:
                mapping[p] = _restored(ws.df, p).alias(p)
                drop.add(p + OSUF)
    for c in converted:
        if c in restore:
            continue
        for p in _copies(ws, c):
            mapping[p] = col(p).cast("string").try_cast("double").alias(p, metadata={})
    out = ws.df.select(*[mapping.get(x, col(x)) for x in ws.df.columns if x not in drop])
    return ws.evolve(out), converted, failed
