"""Checks that stop a job early when there is nothing to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise ``ValueError`` if ``df`` is empty. One small job at plan time."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_column(df: DataFrame, *names: str) -> str:
    """The first of ``names`` that the DataFrame has."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of these columns is present: {', '.join(names)}")
