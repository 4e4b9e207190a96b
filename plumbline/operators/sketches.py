"""Mergeable sketches: approximate modes that a caller asks for; the exact operators do not use them.

A sketch is a row of a few kilobytes per dataset and feature. It can be written, kept, and merged with those of other days
or sites without reading any row again, and no value is shuffled to build one.

* KLL: quantiles, within ``rank_error(k)`` of the exact rank for 99 of 100 sketches; for distribution distances and equal-frequency cuts.
* HLL: numbers of distinct values, relative standard error 1.04 / sqrt(2**lg).
* Theta: distinct values of one side that the other lacks or shares; a standard error of about 1 / sqrt(2**lg) of the larger set.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import is_missing, trimmed

KLL_K = 800
HLL_LG = 14
THETA_LG = 14
STEPS = 500


def rank_error(k: int = KLL_K) -> float:
    """The two-sided 99 % bound on a KLL sketch's normalised rank error."""
    return 2.446 / k**0.9433


def hll_error(lg: int = HLL_LG) -> float:
    return 1.04 / 2 ** (lg / 2)


def theta_error(lg: int = THETA_LG) -> float:
    return 2 ** (-lg / 2)


def number_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    """(by..., feature, n, low, high, sketch) of the finite numbers of each column; none for a column without any."""
    finite = lambda c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))
    cells = df.select(*by, F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), finite(c).alias("number")) for c in columns]))).where("number IS NOT NULL")
    return cells.groupBy(*by, "feature").agg(
        F.count("*").alias("n"), F.min("number").alias("low"), F.max("number").alias("high"), F.kll_sketch_agg_double("number", k).alias("sketch")
    )


def merged_numbers(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One sketch per group and feature from those of its parts."""
    return sketches.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile_cuts(sketches: DataFrame, parts: int) -> DataFrame:
    """The sketch rows with ``cuts``: the distinct values that end the first parts - 1 of ``parts`` equally full ones, ascending."""
    ranks = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    return sketches.withColumn("cuts", F.array_distinct(F.kll_sketch_get_quantile_double("sketch", ranks)))


def quantile_levels(sketches: DataFrame, parts: Mapping[str, int]) -> DataFrame:
    """feature, n and ``cuts``: the quantiles i / parts of every feature, repeats included, each with its own number of parts."""
    cuts = None
    for feature, k in parts.items():
        of = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(i / k) for i in range(1, k)]))
        mine = F.col("feature") == feature
        cuts = F.when(mine, of) if cuts is None else cuts.when(mine, of)
    return sketches.select("feature", "n", cuts.alias("cuts"))


def distances(ref: DataFrame, comp: DataFrame, steps: int = STEPS) -> DataFrame:
    """feature, n_ref, n_comp, ks and w1 from two tables of sketches.

    Each distribution function is read off its side's ``steps`` quantiles, so it is within 1 / steps and the rank error of
    the exact one; ks is within twice that, w1 within that share of the range.
    """
    ranks = F.array(*[F.lit(i / steps) for i in range(1, steps)])
    both = None
    for df, p in ((ref, "a"), (comp, "b")):
        held = df.withColumn("quantiles", F.array_append(F.kll_sketch_get_quantile_double("sketch", ranks), F.col("high")))
        side = held.select("feature", *[F.col(c).alias(f"{p}_{c}") for c in ("n", "low", "quantiles")])
        both = side if both is None else both.join(side, "feature")
    ends = F.array("a_low", "b_low")
    places = F.explode(F.array_distinct(F.concat("a_quantiles", "b_quantiles", ends))).alias("place")
    upto = lambda p: F.size(F.filter(f"{p}_quantiles", lambda x: x <= F.col("place"))) / F.size(f"{p}_quantiles")
    rows = both.select("*", places).select("feature", "a_n", "b_n", "place", F.abs(upto("a") - upto("b")).alias("gap"))
    following = F.lead("place").over(Window.partitionBy("feature").orderBy("place"))  # at most 2 * steps + 2 rows a feature
    steps_of = rows.withColumn("width", following - F.col("place"))
    return steps_of.groupBy("feature").agg(
        F.first("a_n").alias("n_ref"), F.first("b_n").alias("n_comp"), F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * F.col("width")), F.lit(0.0)).alias("w1")
    )


def _cells(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("cell")) for c in columns])
    return df.select(*by, F.inline(cells)).where(~is_missing(F.col("cell"))).withColumn("cell", trimmed(F.col("cell")))


def distinct_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), lg: int = HLL_LG) -> DataFrame:
    """(by..., feature, n, sketch): present cells and an HLL sketch of the different ones."""
    return _cells(df, columns, by).groupBy(*by, "feature").agg(F.count("*").alias("n"), F.hll_sketch_agg("cell", lg).alias("sketch"))


def distinct_counts(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, n, distinct) from the union of the sketches of each group."""
    return sketches.groupBy(*by, "feature").agg(F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def value_sketches(df: DataFrame, columns: Sequence[str], lg: int = THETA_LG) -> DataFrame:
    """(feature, sketch): a theta sketch of the different present cells of each column."""
    return _cells(df, columns, ()).groupBy("feature").agg(F.theta_sketch_agg("cell", lg).alias("sketch"))


def tuple_sketch(df: DataFrame, columns: Sequence[str], lg: int = THETA_LG) -> DataFrame:
    """(feature, sketch) of the different rows over ``columns``, nulls included, under the columns' names."""
    whole = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.select(whole.alias("cell")).groupBy(F.lit(", ".join(columns)).alias("feature")).agg(F.theta_sketch_agg("cell", lg).alias("sketch"))


def unseen_estimates(ref: DataFrame, comp: DataFrame) -> DataFrame:
    """feature, seen, unseen and shared: different values of ``comp``, those that ``ref`` lacks and those that both have."""
    other = ref.select("feature", F.col("sketch").alias("known"))
    size = F.theta_sketch_estimate
    both = comp.join(other, "feature", "left")
    return both.select(
        "feature",
        size("sketch").alias("seen"),
        F.when(F.col("known").isNull(), size("sketch")).otherwise(size(F.theta_difference("sketch", "known"))).alias("unseen"),
        F.when(F.col("known").isNull(), F.lit(0).cast("long")).otherwise(size(F.theta_intersection("sketch", "known"))).alias("shared"),
    )
