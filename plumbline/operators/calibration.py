"""Brier score and reliability bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import clamp
from ..functions.measures import measure, to_long
from .running import count_below_fixed, order_statistics, value_counts
from .sketches import number_sketches, quantile_cuts


def brier(ev: DataFrame, positive: str = "1") -> DataFrame:
    """Mean squared error of the probabilities; any missing probability leaves it undefined."""
    error = F.col("y_probability") - F.when(F.col("y_true") == positive, 1.0).otherwise(0.0)
    totals = ev.agg(
        F.avg(error * error).alias("mean_error"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("y_probability").isNull()).alias("unscored"),
    )
    value = F.when((F.col("n") > 0) & (F.col("unscored") == 0), F.col("mean_error"))
    reason = F.when(F.col("n") == 0, "no rows").otherwise("missing probabilities")
    return to_long(totals, [measure("brier_score", value, reason, F.col("n"))])


def _bins(ev: DataFrame, edges: list[float], positive: str) -> DataFrame:
    """Summaries of [edge i, edge i+1) bins, the last one closed; empty bins keep NULL summaries.

    A population with a missing probability gets no bins at all.
    """
    last = len(edges) - 2
    spark = ev.sparkSession
    table = spark.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(last + 1)], "bin long, lower double, upper double"
    )
    place = count_below_fixed(edges, F.col("y_probability")) - F.lit(1)
    bin_of = F.when(F.col("y_probability").isNotNull(), F.least(place, F.lit(last)))
    # At most len(edges) rows after the map-side combine; the NULL bin holds unscored rows.
    filled = ev.groupBy(bin_of.cast("long").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("y_probability").alias("mean_p"),
        F.avg((F.col("y_true") == positive).cast("double")).alias("rate"),
    )
    unscored = F.max(F.col("bin").isNull() & F.col("n").isNotNull()).over(Window.partitionBy())
    joined = table.join(filled, "bin", "full_outer").withColumn("unscored", unscored)
    return joined.filter(F.col("bin").isNotNull() & ~F.col("unscored")).select(
        "bin",
        "lower",
        "upper",
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
        clamp(F.col("mean_p"), F.col("lower"), F.col("upper")).alias("mean_probability"),
        F.col("rate").alias("observed_rate"),
    )


def calibration_equal_width(ev: DataFrame, bins: int = 10, positive: str = "1") -> DataFrame:
    if not 2 <= bins <= 100:
        raise ValueError("bins must be in 2..100")
    return _bins(ev, [i / bins for i in range(bins + 1)], positive)


def calibration_equal_frequency(ev: DataFrame, bins: int = 10, positive: str = "1", approx: bool = False) -> DataFrame:
    """Cuts halfway between the order statistics ceil(n i / k) and its successor.

    Equal scores never split, so fewer bins than asked for may result. The cuts (at most ``bins - 1``
    numbers) are found by a first job; the bins themselves stay lazy. ``approx`` takes the quantiles of a mergeable
    sketch as cuts (within ``sketches.rank_error`` of their ranks) and shuffles no score for them.
    """
    if not 2 <= bins <= 100:
        raise ValueError("bins must be in 2..100")
    if approx:
        about = quantile_cuts(number_sketches(ev, ["y_probability"]), bins).first()
        return _bins(ev, [0.0, *[c for c in (about.cuts if about else []) if 0 < c < 1], 1.0], positive)
    counts = value_counts(ev.filter(F.col("y_probability").isNotNull()), "y_probability")
    size = F.col("all_upto").cast("double")
    wanted = [F.ceil(size * i / bins).cast("long") for i in range(1, bins)]
    ranks = F.array_distinct(F.array(*[r for at in wanted for r in (at, at + F.lit(1))]))
    found = order_statistics(counts, "y_probability", ranks).collect()
    by_rank = {r["rank"]: r["value"] for r in found}
    edges = [0.0]
    size_n = found[0]["size"] if found else 0
    for at in (math.ceil(size_n * i / bins) for i in range(1, bins)):
        if at in by_rank and at + 1 in by_rank:
            left, right = by_rank[at], by_rank[at + 1]
            middle = left + (right - left) / 2
            if left < middle < right and middle > edges[-1]:
                edges.append(middle)
    return _bins(ev, edges + [1.0], positive)


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    """Sample-weighted absolute gap between mean probability and observed rate."""
    totals = bins.agg(
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("observed_rate"))).alias("gap"),
    )
    value = F.least(F.lit(1.0), F.col("gap") / F.when(F.col("total") > 0, F.col("total")))
    size = F.coalesce("total", F.lit(0))
    return to_long(totals, [measure("expected_calibration_error", value, "no complete scores", size)])
