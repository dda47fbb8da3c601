"""Sink (S4): the working table as CSV.  Fitted models (S5) are saved by ``operators.models``."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame


def training_file_name(today: _dt.date | None = None) -> str:
    """Name the reference gives the saved training table."""
    return f"training_data_{(today or _dt.date.today()).isoformat()}.csv"


def save_table_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no row names, NULL written as NA, strings quoted only when needed with "" escaping.

    Written by every task in parallel (a folder of part files), never funnelled
    through one task.
    """
    (df.write.mode(mode)
     .options(header=True, nullValue="NA", emptyValue='""', quote='"', escape='"')
     .csv(path))


def save_training(ws, path: str, mode: str = "overwrite") -> None:
    """Save the working table of a submitted workspace (the reference allows it only after submission)."""
    if not ws.frozen:
        raise ValueError("submit the workspace before saving the training table")
    save_table_csv(ws.working(), path, mode)
