"""Fitted preparation steps applied to streaming (or batch) DataFrames.

The reference has no streaming; what carries over is a design property: every
scaler and encoder is split into ``fit`` (a batch aggregate over the training
table) and ``apply`` (stateless).  Scalers become literal projections; label
encoders become a stream-static left join against the fitted dictionary, which
Structured Streaming supports without state.  So new data arriving through
``readStream`` is prepared exactly like the training table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.encode import apply_label_encoder, fit_label_encoder
from ..operators.scale import fit_scaler, scale_expr
from ..functions.stats import col


@dataclass
class FittedPrep:
    scalers: list = field(default_factory=list)      # fitted scaler dicts, applied in order
    encoders: dict = field(default_factory=dict)     # column -> (dictionary DataFrame, level count)
    nan_to_null: bool = True


def fit_prep(df: DataFrame, scale: dict | None = None, label_encode=(), nan_to_null: bool = True) -> FittedPrep:
    """Fit on a batch table.  ``scale``: method -> columns (applied in the order given)."""
    fitted = FittedPrep(nan_to_null=nan_to_null)
    for method, cols in (scale or {}).items():
        fitted.scalers.append(fit_scaler(df, cols, method))
    for c in label_encode:
        fitted.encoders[c] = fit_label_encoder(df, c)
    return fitted


def apply_prep(df: DataFrame, fitted: FittedPrep) -> DataFrame:
    """Apply fitted steps; no aggregation, so ``df`` may be a streaming DataFrame."""
    out = df
    nan = F.lit(None).cast("double")
    for sc in fitted.scalers:
        mapping = {}
        for c, p in sc["params"].items():
            e = scale_expr(col(c), sc["method"], p)
            mapping[c] = F.nanvl(e, nan) if fitted.nan_to_null else e
        out = out.select(*[mapping[c].alias(c) if c in mapping else col(c) for c in out.columns])
    for c, (dictionary, n) in fitted.encoders.items():
        out = apply_label_encoder(out, c, dictionary, n)
    return out
