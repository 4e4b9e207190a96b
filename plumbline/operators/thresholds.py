"""Operating points: sweeps, selection rules and before/after verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import predict
from ..functions.measures import measure, to_long
from .metrics import metric_rows, rate_columns
from .running import count_below_fixed

GRID = tuple(i / 100 for i in range(101))
SELECTABLE = ("accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1", "minority_recall")


def union_thresholds(spark, grid: Sequence[float] = GRID, baseline: float | None = None) -> DataFrame:
    """Distinct grid points plus the baseline policy's threshold."""
    points = spark.createDataFrame([(float(t),) for t in grid], "threshold double")
    if baseline is not None:
        points = points.union(spark.createDataFrame([(float(baseline),)], "threshold double"))
    return points.distinct()


def threshold_sweep(ev: DataFrame, thresholds: Sequence[float] = GRID, positive: str = "1") -> DataFrame:
    """Confusion counts at every threshold from one pass over the rows.

    A row only decides how many thresholds lie at or below its score, so rows collapse to at most
    ``len(thresholds) + 1`` buckets (map-side) and the counts are cumulated over those buckets.
    ``position`` keeps the order in which thresholds were given.
    """
    ordered = sorted(set(float(t) for t in thresholds))
    if not ordered or ordered[0] < 0 or ordered[-1] > 1:
        raise ValueError("give thresholds in [0, 1]")
    reached = count_below_fixed(ordered, F.col("y_probability"))
    buckets = ev.groupBy(reached.alias("reached")).agg(
        F.count_if(F.col("y_true") == positive).alias("pos"),
        F.count_if(F.col("y_true") != positive).alias("neg"),
        F.count_if(F.col("y_probability").isNull()).alias("unscored"),
    )
    spark = ev.sparkSession
    first = {}
    for position, t in enumerate(thresholds):
        first.setdefault(float(t), position)
    points = spark.createDataFrame(
        [(0, None, None)] + [(i + 1, t, first[t]) for i, t in enumerate(ordered)],
        "reached int, threshold double, position long",
    )
    # At most len(thresholds) + 1 rows from here on.
    counted = points.join(buckets, "reached", "left").na.fill(0, ["pos", "neg", "unscored"])
    above = Window.orderBy(F.col("reached").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everyone = Window.partitionBy()
    rows = counted.select(
        "threshold",
        "position",
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("neg").over(everyone).alias("all_neg"),
        F.sum("pos").over(everyone).alias("all_pos"),
        F.sum("unscored").over(everyone).alias("unscored"),
    )
    return rows.filter(F.col("threshold").isNotNull() & (F.col("unscored") == 0)).select(
        "position",
        "threshold",
        "tp",
        "fp",
        (F.col("all_neg") - F.col("fp")).alias("tn"),
        (F.col("all_pos") - F.col("tp")).alias("fn"),
    )


def with_cost(sweep: DataFrame, fn_cost: float, fp_cost: float) -> DataFrame:
    """Total (not per-row) error cost of each operating point."""
    if fn_cost < 0 or fp_cost < 0 or fn_cost + fp_cost == 0:
        raise ValueError("costs must be nonnegative and not both zero")
    return sweep.select("*", (F.col("fn") * F.lit(float(fn_cost)) + F.col("fp") * F.lit(float(fp_cost))).alias("total_cost"))


def sweep_metrics(sweep: DataFrame) -> DataFrame:
    keys = ("position", "threshold")
    rows = metric_rows(sweep, keys)
    if "total_cost" in sweep.columns:
        n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
        rows = rows.unionByName(to_long(sweep, [measure("total_cost", F.col("total_cost"), "", n, "cost")], keys))
    return rows


def cost_select(costed: DataFrame) -> DataFrame:
    """The cheapest operating point; exact ties pick the highest threshold."""
    rank = F.struct(F.col("total_cost"), (-F.col("threshold")).alias("tie"))
    return costed.agg(F.min_by("threshold", rank).alias("threshold"), F.min("total_cost").alias("total_cost"))


def criterion_select(sweep: DataFrame, metric: str, operator: str, value: float) -> DataFrame:
    """Among points meeting a declared criterion the best one, ties to the highest threshold.

    ``at_least`` a performance ratio, or ``at_most`` a total cost. One row:
    status candidate / no_eligible_candidate / insufficient_evidence, and the threshold.
    """
    if metric == "total_cost":
        if operator != "at_most" or value < 0 or "total_cost" not in sweep.columns:
            raise ValueError("cost criteria are at_most a nonnegative total over a costed sweep")
        score, meets, rank = F.col("total_cost"), F.col("score") <= value, -F.col("score")
    else:
        if metric not in SELECTABLE or operator != "at_least" or not 0 <= value <= 1:
            raise ValueError("use at_least a supported performance ratio in [0, 1]")
        score, meets, rank = rate_columns()[metric][0], F.col("score") >= value, F.col("score")
    points = sweep.select("threshold", score.alias("score"))
    best = F.when(meets, F.struct(rank.alias("rank"), F.col("threshold").alias("threshold"), F.col("score").alias("score")))
    found = points.agg(F.max(best).alias("best"), F.count("score").alias("measured"))
    status = (
        F.when(F.col("best").isNotNull(), "candidate")
        .when(F.col("measured") > 0, "no_eligible_candidate")
        .otherwise("insufficient_evidence")
    )
    return found.select(
        status.alias("status"), F.col("best.threshold").alias("threshold"), F.col("best.score").alias("score")
    )


def baseline_check(ev: DataFrame, threshold: float, positive: str = "1", negative: str = "0") -> DataFrame:
    """Do the supplied predictions equal ``probability >= threshold`` on every row?"""
    differs = ~F.col("y_pred").eqNullSafe(predict(F.col("y_probability"), threshold, positive, negative))
    return ev.agg(F.count_if(differs).alias("mismatches"), F.count(F.lit(1)).alias("n")).select(
        (F.col("mismatches") == 0).alias("reproduces"), "mismatches", "n"
    )


def _policy_counts(ev: DataFrame, policies: dict[str, float], positive: str) -> DataFrame:
    """Confusion counts of several thresholds from one aggregate, one row per stage."""
    actual = F.col("y_true") == positive
    aggs = []
    for stage, t in policies.items():
        guess = F.col("y_probability") >= F.lit(float(t))
        aggs += [
            F.count_if(actual & guess).alias(f"{stage}_tp"),
            F.count_if(~actual & guess).alias(f"{stage}_fp"),
            F.count_if(~actual & ~guess).alias(f"{stage}_tn"),
            F.count_if(actual & ~guess).alias(f"{stage}_fn"),
        ]
    wide = ev.agg(*aggs)
    rows = [
        F.struct(F.lit(s).alias("stage"), F.lit(float(t)).alias("threshold"), *[F.col(f"{s}_{c}").alias(c) for c in ("tp", "fp", "tn", "fn")])
        for s, t in policies.items()
    ]
    return wide.select(F.inline(F.array(*rows)))


def policy_measurements(
    ev: DataFrame, baseline: float, after: float, costs: tuple[float, float] | None = None, positive: str = "1"
) -> DataFrame:
    """Long measurements of two policies on the same rows, keyed by stage."""
    counts = _policy_counts(ev, {"baseline": baseline, "after": after}, positive)
    rows = metric_rows(counts, ("stage",))
    if costs:
        n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
        priced = with_cost(counts, *costs)
        rows = rows.unionByName(to_long(priced, [measure("total_cost", F.col("total_cost"), "", n, "cost")], ("stage",)))
    return rows


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Join two measurement tables by metric and name the direction of change."""
    b = before.select("metric", F.col("value").alias("before"))
    a = after.select("metric", F.col("value").alias("after"))
    return b.join(a, "metric").select("metric", "before", "after", direction(F.col("before"), F.col("after")).alias("direction"))


def direction(before: Column, after: Column) -> Column:
    return (
        F.when(before.isNull() | after.isNull(), "undefined")
        .when(after > before, "increased")
        .when(after < before, "decreased")
        .otherwise("unchanged")
    )


def repair_reevaluate(
    ev: DataFrame,
    baseline: float,
    after: float,
    metric: str,
    value: float,
    costs: tuple[float, float] | None = None,
    positive: str = "1",
) -> DataFrame:
    """Every metric before and after, and whether the accepted metric reached its declared target."""
    cost = metric == "total_cost"
    if cost and costs is None or not cost and metric not in SELECTABLE:
        raise ValueError("declare a supported metric, or costs for total_cost")
    rows = policy_measurements(ev, baseline, after, costs, positive)
    pair = rows.groupBy("metric").agg(
        F.max(F.when(F.col("stage") == "baseline", F.col("value"))).alias("before"),
        F.max(F.when(F.col("stage") == "after", F.col("value"))).alias("after"),
    )
    b, a = F.col("before"), F.col("after")
    target = F.col("metric") == metric
    meets = a <= value if cost else a >= value
    better = a < b if cost else a > b
    undefined = a.isNull() | b.isNull()
    return pair.select(
        "metric",
        "before",
        "after",
        direction(b, a).alias("direction"),
        F.when(target, F.when(undefined, "inconclusive").when(meets, "passed").otherwise("failed")).alias("status"),
        F.when(
            target,
            F.when(undefined, "undefined").when(a == b, "unchanged").when(better, "improved").otherwise("worsened"),
        ).alias("improvement"),
    )


def apply_policy(ev: DataFrame, threshold: float, positive: str = "1", negative: str = "0") -> DataFrame:
    """The same rows with predictions replaced by the policy's."""
    return ev.withColumn("y_pred", predict(F.col("y_probability"), threshold, positive, negative))
