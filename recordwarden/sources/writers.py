"""CSV and JSON outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def write_csv(df: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    """A directory of CSV parts; `order` sorts across all parts."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", True).option(
        "escape", '"'
    ).option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
