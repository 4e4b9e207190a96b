"""The long measurement form: undefined is a NULL value with a reason, never 0 or NaN."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURE_COLUMNS = ("metric", "status", "value", "reason", "unit", "sample_size")


def measure(metric: str, value: Column, reason: str | Column, n: Column, unit: str = "ratio") -> Column:
    """One measurement struct; ``reason`` applies where ``value`` is NULL."""
    why = reason if isinstance(reason, Column) else F.lit(reason)
    missing = value.isNull()
    return F.struct(
        F.lit(metric).alias("metric"),
        F.when(missing, "undefined").otherwise("measured").alias("status"),
        value.cast("double").alias("value"),
        F.when(missing, why).alias("reason"),
        F.lit(unit).alias("unit"),
        n.cast("long").alias("sample_size"),
    )


def to_long(df: DataFrame, measures: Iterable[Column], keys: Iterable[str] = ()) -> DataFrame:
    """One row per measurement, key columns first."""
    return df.select(*keys, F.inline(F.array(*measures)))
