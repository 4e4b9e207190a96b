"""Predicates and conversions on text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that mark a missing cell, and the accepted decimal form.
MISSING_WORDS = ("null", "na", "nan", "n/a")
DECIMAL_PATTERN = r"(?i)^[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?\z"
BLANKS = " \t\n\r\f\u000b ﻿"


def trimmed(cell: Column) -> Column:
    return F.btrim(cell, F.lit(BLANKS))


def strip_bom(text: Column) -> Column:
    """Remove one leading byte-order mark, then surrounding blanks."""
    bom = F.when(F.startswith(text, F.lit("﻿")), F.substr(text, F.lit(2))).otherwise(text)
    return F.btrim(bom, F.lit(BLANKS))


def is_missing(cell: Column) -> Column:
    text = F.lower(trimmed(cell))
    return F.coalesce((text == "") | text.isin(*MISSING_WORDS), F.lit(True))


def sentinel_form(cell: Column) -> Column:
    """Which spelling a missing cell used; NULL for a present cell."""
    text = F.lower(trimmed(cell))
    return F.when(cell.isNull() | (text == ""), F.lit("empty")).when(text.isin(*MISSING_WORDS), text)


def decimal_value(cell: Column) -> Column:
    """The finite number a cell spells, else NULL. A plain cast would accept '1d', ' 1 ', 'nan' and 1e400."""
    value = F.when(cell.rlike(DECIMAL_PATTERN), cell.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def in_label_pair(cell: Column, positive: str, negative: str) -> Column:
    return F.coalesce(cell.isin(positive, negative), F.lit(False))


def is_probability(value: Column) -> Column:
    return F.coalesce(value.between(0.0, 1.0), F.lit(False))


def predict(probability: Column, threshold: float | Column, positive: str = "1", negative: str = "0") -> Column:
    """The positive label iff probability >= threshold (inclusive)."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(probability >= limit, F.lit(positive)).otherwise(F.lit(negative))


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(value.isNotNull(), F.greatest(low, F.least(high, value)))


def delta_points(value: Column, base: Column) -> Column:
    """Difference in percentage points."""
    return (value - base) * F.lit(100.0)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NULL (not zero) when the denominator is zero."""
    return F.when(denominator != 0, numerator.cast("double") / denominator.cast("double"))


def file_stem(name: Column) -> Column:
    """File name without folders and without its last extension; a leading dot is kept."""
    base = F.regexp_extract(name, r"([^/\\]*)\z", 1)
    return F.regexp_replace(base, r"(?s)^(.+)\.[^.]*\z", "$1")


def scaled_percent(value: Column, percent: Column, bounded: Column) -> Column:
    """Divide an explicit percentage by 100, for bounded metrics only."""
    return F.when(percent & bounded, value / F.lit(100.0)).otherwise(value)


def extras_map(columns: list[str], known: list[str]) -> Column:
    """Columns outside ``known`` as a map; blank cells are dropped."""
    rest = [c for c in columns if c not in known]
    if not rest:
        return F.create_map().cast("map<string,string>")
    pairs = F.map_from_arrays(
        F.array(*[F.lit(c) for c in rest]), F.array(*[trimmed(F.col(c).cast("string")) for c in rest])
    )
    return F.map_filter(pairs, lambda _, v: v.isNotNull() & (v != ""))


def bin_label(name: str, low: Column, high: Column) -> Column:
    """``name [low to high]`` with two decimals; open ends read ``min`` and ``> low``."""
    low_text, high_text = F.format_string("%.2f", low), F.format_string("%.2f", high)
    return (
        F.when(high.isNull(), F.concat(F.lit(f"{name} [> "), low_text, F.lit("]")))
        .when(low.isNull(), F.concat(F.lit(f"{name} [min to "), high_text, F.lit("]")))
        .otherwise(F.concat(F.lit(f"{name} ["), low_text, F.lit(" to "), high_text, F.lit("]")))
    )
