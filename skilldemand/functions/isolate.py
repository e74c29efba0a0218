"""Python steps that fail for one row only.

The contract of a step is a pair (value, error): a row that raises has a null value and the
message, its neighbours go on, and the caller decides where errors are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def message(exc: Exception) -> str:
    return f"{type(exc).__name__}: {exc}"


def isolated(function: Callable, kind: str) -> Callable[[Column], Column]:
    """``function`` of one value as a function of a column, struct(value ``kind``, error string)."""

    @F.pandas_udf(f"value {kind}, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        rows = []
        for value in values:
            try:
                rows.append((function(value), None))
            except Exception as exc:
                rows.append((None, message(exc)))
        return pd.DataFrame({"value": pd.Series([r[0] for r in rows], dtype=object), "error": [r[1] for r in rows]})

    return run


def isolated_stage(function: Callable, kind: str, out: str, col: str = "text") -> Callable[[DataFrame], DataFrame]:
    """A stage that adds ``out``, ``function`` of each text, and ``out``_error."""
    run = isolated(function, kind)

    def stage(df: DataFrame) -> DataFrame:
        done = df.withColumn("_step", run(F.col(col)))
        return done.withColumns({out: F.col("_step.value"), f"{out}_error": F.col("_step.error")}).drop("_step")

    return stage
