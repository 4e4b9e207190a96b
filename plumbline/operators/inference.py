"""Tests on count tables and on ratings: proportions, exact test, corrections, agreement, strata."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import kappa, newcombe, normal_cdf, pooled_error, proportion, wilson
from .running import running

SMALL_CELL = 5
POWER_FLOOR = 25


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """ln n!: exact products below 16, then Stirling's series (error below 1e-13)."""
    x = np.maximum(n, 16).astype(float)
    inverse = 1.0 / x
    square = inverse * inverse
    tail = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square / 1680)))
    series = (x + 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + tail
    table = np.array([math.lgamma(i + 1) for i in range(16)])
    return np.where(n < 16, table[np.minimum(n, 15)], series)


def _log_choose(n, k) -> np.ndarray:
    n, k = np.asarray(n, dtype=np.int64), np.asarray(k, dtype=np.int64)
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def exact_p(k1: int, n1: int, k2: int, n2: int) -> float:
    """Two-sided Fisher p: the mass of all tables no likelier than the observed one.

    Only tables within 20 sqrt(smaller margin) of the expected count are summed. By Hoeffding's bound
    the rest is below the smallest double, so the sum is whole and its length stays near sqrt(n).
    """
    hits, rows = k1 + k2, n1 + n2
    if rows == 0:
        return 1.0
    margin = min(n1, hits)
    expected, reach = n1 * hits / rows, 20 * math.sqrt(margin) + 1
    low = max(0, n1 - (rows - hits), math.floor(expected - reach))
    x = np.arange(low, min(margin, math.ceil(expected + reach)) + 1)
    weight = lambda v: _log_choose(hits, v) + _log_choose(rows - hits, n1 - v) - _log_choose(rows, n1)
    mass = weight(x)
    return float(min(1.0, np.exp(mass[mass <= weight(k1) + 1e-9]).sum()))


@F.pandas_udf(T.DoubleType())
def _exact_p(k1: pd.Series, n1: pd.Series, k2: pd.Series, n2: pd.Series) -> pd.Series:
    """Rows with a NULL count are passed over: they need no exact test."""
    rows = zip(k1, n1, k2, n2)
    return pd.Series([None if pd.isna(row[0]) else exact_p(*map(int, row)) for row in rows], dtype="float64")


def fisher_exact(df: DataFrame, k1: str = "k1", n1: str = "n1", k2: str = "k2", n2: str = "n2") -> DataFrame:
    """Append the exact p of each row of counts.

    Spark has no log-gamma, so this runs as an Arrow-batched function over already aggregated rows. It
    also keeps a very long expression out of the plans that filter and join on p.
    """
    return df.select("*", _exact_p(k1, n1, k2, n2).alias("p"))


def with_difference(df: DataFrame, k1: str = "k1", n1: str = "n1", k2: str = "k2", n2: str = "n2") -> DataFrame:
    """Append p1, p2, diff and its Newcombe-Wilson bounds.

    Written in steps: a name used more than once stays a column instead of being copied into every use.
    """
    c1, m1, c2, m2 = (F.col(c) for c in (k1, n1, k2, n2))
    rates = df.select("*", proportion(c1, m1).alias("p1"), proportion(c2, m2).alias("p2"))
    low1, high1 = wilson(c1, m1)
    low2, high2 = wilson(c2, m2)
    bounds = rates.select(
        "*", low1.alias("__l1"), high1.alias("__h1"), low2.alias("__l2"), high2.alias("__h2")
    )
    low, high = newcombe(*[F.col(c) for c in ("p1", "__l1", "__h1", "p2", "__l2", "__h2")])
    return bounds.select(
        *rates.columns, (F.col("p1") - F.col("p2")).alias("diff"), low.alias("diff_low"), high.alias("diff_high")
    )


def two_proportion(
    df: DataFrame, k1: str = "k1", n1: str = "n1", k2: str = "k2", n2: str = "n2", floor: int = POWER_FLOOR
) -> DataFrame:
    """Difference of two proportions with interval, test, risk ratio and power flag, appended to each row.

    Fisher's test where any cell is below five, else the pooled z. An infinite risk ratio is NULL
    with ``rr_infinite``.
    """
    c1, m1, c2, m2 = (F.col(c) for c in (k1, n1, k2, n2))
    small = F.least(c1, m1 - c1, c2, m2 - c2) < SMALL_CELL
    compared = with_difference(df.select("*", small.alias("__small")), k1, n1, k2, n2)
    tiny, diff, p1, p2 = (F.col(c) for c in ("__small", "diff", "p1", "p2"))
    exact = compared.select(
        "*",
        _exact_p(*[F.when(tiny, c) for c in (c1, m1, c2, m2)]).alias("__exact"),
        F.when(~tiny, pooled_error(c1, m1, c2, m2)).alias("__error"),
    )
    error = F.col("__error")
    scored = exact.select("*", F.when(tiny | (error == 0), 0.0).otherwise(diff / error).alias("z"))
    z = F.col("z")
    p = F.when(tiny, F.col("__exact")).when(error == 0, 1.0).otherwise(2 * (1 - normal_cdf(F.abs(z))))
    return scored.select(
        *df.columns,
        "p1",
        "p2",
        "diff",
        "diff_low",
        "diff_high",
        "z",
        p.alias("p"),
        F.when(p2 > 0, p1 / p2).when(p1 == 0, 1.0).alias("risk_ratio"),
        ((p2 == 0) & (p1 > 0)).alias("rr_infinite"),
        F.when(tiny, "fisher_exact").otherwise("z_test").alias("test"),
        ((m1 < floor) | (m2 < floor)).alias("underpowered"),
    )


def wilson_ci(df: DataFrame, k: str = "k", n: str = "n") -> DataFrame:
    low, high = wilson(F.col(k), F.col(n))
    return df.select("*", low.alias("low"), high.alias("high"))


def bh_cummin(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Running minimum of ``value`` from the largest ``order`` down; ``order`` is unique within ``by``."""
    return running(df, order, {"running_min": ("min", F.col(value))}, by, descending=True)


def bh_adjust(df: DataFrame, by: Sequence[str], p: str = "p", name: str = "p_adjusted") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each investigation.

    Equal p-values share one adjusted value, so the step-up runs over distinct p-values.
    """
    known = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(known, p, {"__rank": ("sum", F.col("__n"))}, by)
    step = F.least(F.lit(1.0), F.col(p) * F.col("all___rank") / F.col("__rank"))
    stepped = ranked.select(*by, p, step.alias("__step"))
    adjusted = bh_cummin(stepped, by, p, "__step").select(*by, p, F.col("running_min").alias(name))
    return df.join(adjusted, [*by, p], "left")


def cohen_kappa(ratings: DataFrame, first: str = "r1", second: str = "r2", by: Sequence[str] = ()) -> DataFrame:
    one, two = F.col(first) == 1, F.col(second) == 1
    counts = ratings.groupBy(*by).agg(
        F.count_if(one & two).alias("both"),
        F.count_if(one & ~two).alias("only_first"),
        F.count_if(~one & two).alias("only_second"),
        F.count_if(~one & ~two).alias("neither"),
    )
    value = kappa(*[F.col(c) for c in ("both", "only_first", "only_second", "neither")])
    return counts.select(*by, (F.col("both") + F.col("only_first") + F.col("only_second") + F.col("neither")).alias("n"), value.alias("kappa"))


def effect_counts(labelled: DataFrame, by: Sequence[str]) -> DataFrame:
    """Errors and rows with (k1, n1) and without (k2, n2) the concept."""
    has, bad = F.col("label") == 1, F.col("is_error")
    return labelled.groupBy(*by).agg(
        F.count_if(has & bad).alias("k1"), F.count_if(has).alias("n1"), F.count_if(~has & bad).alias("k2"), F.count_if(~has).alias("n2")
    )


def strata_rows(labelled: DataFrame, stratum: str = "site", least: int = 5) -> DataFrame:
    """The effect within each stratum holding at least five rows on either side."""
    counts = effect_counts(labelled, ("concept_id", stratum)).filter((F.col("n1") >= least) & (F.col("n2") >= least))
    tested = two_proportion(counts, floor=least)
    return tested.select(
        "concept_id",
        F.col(stratum).alias("stratum"),
        (F.col("diff") * 100).alias("difference_pp"),
        "p",
        (F.col("diff") > 0).alias("consistent"),
    )


def stratified_effect(labelled: DataFrame, stratum: str = "site", share: float = 0.7) -> DataFrame:
    """Does the effect keep its direction in at least 70 % of the usable strata?"""
    rows = strata_rows(labelled, stratum)
    return rows.groupBy("concept_id").agg(
        F.count(F.lit(1)).alias("strata"),
        F.count_if("consistent").alias("consistent"),
        (F.count_if("consistent") / F.count(F.lit(1)) >= share).alias("survives"),
    )
