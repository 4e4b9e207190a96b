"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
from collections.abc import Callable
from types import ModuleType
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rows that one Arrow batch may hold: bounds what a Python worker keeps of very long texts at a time.
BATCH_ROWS = 512


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS where it is larger."""
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


T = TypeVar("T")


def per_worker(key: object, make: Callable[[], T]) -> T:
    """What ``make`` gave when this Python process first asked for ``key``.

    Functions travel to executors by value and so have new globals in each task; this lasts from task to task.
    """
    state = sys.modules.setdefault("_plumbline_worker", ModuleType("_plumbline_worker")).__dict__.setdefault("state", {})
    if key not in state:
        state[key] = make()
    return state[key]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns, so that any others of the input cannot clash with working names."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(ids: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(ids.cast("string"), F.lit("")).cast("binary")) % F.lit(folds) == F.lit(fold)
