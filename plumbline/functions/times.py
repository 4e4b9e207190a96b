"""Strict UTC timestamps: ``YYYY-MM-DDTHH:MM:SS[.f{1,3}]Z`` and nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UTC_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?Z\z"


def utc_timestamp(text: Column) -> Column:
    """The instant as TIMESTAMP_NTZ in UTC, independent of the session zone; NULL for impossible dates."""
    body = F.substr(text, F.lit(1), F.length(text) - F.lit(1))
    return F.when(text.rlike(UTC_PATTERN), body.try_cast("timestamp_ntz"))


def utc_day(text: Column) -> Column:
    """Calendar day as ``YYYY-MM-DD`` text."""
    return F.when(utc_timestamp(text).isNotNull(), F.substr(text, F.lit(1), F.lit(10)))
