"""Plan inspection used by the tests: what the physical plan of a query contains."""

from __future__ import annotations

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def has_python_udf(df: DataFrame) -> bool:
    plan = physical_plan(df)
    return any(n in plan for n in PYTHON_NODES)


def scan_count(df: DataFrame) -> int:
    plan = physical_plan(df)
    return plan.count("FileScan parquet") + plan.count("Scan parquet")
