"""64-bit hashes held as signed BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 64


def hash64(text: Column) -> Column:
    """Up to 16 hex digits (the last 16 of a longer text) to a signed 64-bit integer; NULL if malformed."""
    digits = F.right(text, F.lit(16))
    return F.when(digits.rlike(r"^[0-9a-fA-F]{1,16}\z"), F.conv(digits, 16, -10).try_cast("bigint"))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; all 64 when either hash is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(HASH_BITS))


def average_hash(values: Column) -> Column:
    """Bit i (from the top) is set where the i-th of 64 numbers exceeds their mean."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    mean = total / F.size(values)
    return F.aggregate(
        values,
        F.lit(0).cast("bigint"),
        lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(F.when(v.cast("double") > mean, 1).otherwise(0).cast("bigint")),
    )


def array_stats(values: Column) -> Column:
    """mean, population std, std / 255, and shares of numbers >= 250 and <= 5 of a pixel array."""
    n = F.size(values).cast("double")
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    mean = total / n
    spread = F.aggregate(
        values, F.lit(0.0), lambda acc, v: acc + (v.cast("double") - mean) * (v.cast("double") - mean)
    )
    variance = spread / n
    std = F.when(variance < 1e-12, F.lit(0.0)).otherwise(F.sqrt(variance))
    return F.struct(
        mean.alias("mean"),
        std.alias("std"),
        (std / 255.0).alias("rms_contrast"),
        (F.size(F.filter(values, lambda v: v >= 250)) / n).alias("clipped_share"),
        (F.size(F.filter(values, lambda v: v <= 5)) / n).alias("crushed_share"),
    )
