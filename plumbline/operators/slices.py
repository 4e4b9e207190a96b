"""Independent one-column slices of an evaluation frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_missing, trimmed
from ..functions.times import utc_day
from ..session import cut
from .metrics import CONFUSION, metric_rows, ranking_of_counts

SLICE_COLUMNS = ("group", "site", "environment", "device", "timestamp")


def _slice_value(column: str) -> Column:
    cell = F.col(column).cast("string")
    present = F.when(~is_missing(cell), trimmed(cell))
    return utc_day(present) if column == "timestamp" else present


def unpivot(ev: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per (evaluation row, metadata column): ``column``, ``raw``, ``value`` (NULL if unusable)."""
    unknown = [c for c in columns if c not in SLICE_COLUMNS or c not in ev.columns]
    if unknown:
        raise ValueError(f"not sliceable: {unknown}")
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            is_missing(F.col(c).cast("string")).alias("is_missing"),
            _slice_value(c).alias("value"),
        )
        for c in columns
    ]
    return ev.select("y_true", "y_pred", "y_probability", F.inline(F.array(*cells)))


def _coverage(cells: DataFrame) -> DataFrame:
    grouped = cells.groupBy("column", "value", "is_missing").agg(F.count(F.lit(1)).alias("n"))
    rows = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return grouped.groupBy("column").agg(
        rows(F.col("value").isNotNull()).alias("grouped"),
        rows(F.col("is_missing")).alias("missing"),
        rows(~F.col("is_missing") & F.col("value").isNull()).alias("invalid"),
        F.count("value").alias("groups"),
    )


def slice_coverage(ev: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Grouped, missing and invalid rows and the number of groups per column."""
    return _coverage(unpivot(ev, columns))


def slice_metrics(ev: DataFrame, columns: Sequence[str], minimum: int = 30, positive: str = "1") -> DataFrame:
    """The full metric set of every slice, however many a column has.

    The (slice, score) counts are written once; confusion and ranking metrics both come from them.
    """
    keys = ("column", "slice_value")
    truth, guess = F.col("y_true") == positive, F.col("y_pred") == positive
    counts = (
        unpivot(ev, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column", F.col("value").alias("slice_value"), F.col("y_probability").alias("score"))
        .agg(
            F.count_if(truth & guess).alias("tp"),
            F.count_if(~truth & guess).alias("fp"),
            F.count_if(~truth & ~guess).alias("tn"),
            F.count_if(truth & ~guess).alias("fn"),
        )
    )
    counts = cut(counts, "slices")
    table = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in CONFUSION])
    scores = counts.select(*keys, "score", (F.col("tp") + F.col("fn")).alias("pos"), (F.col("fp") + F.col("tn")).alias("neg"))
    metrics = metric_rows(table, keys).unionByName(ranking_of_counts(scores, keys))
    return metrics.select(
        *keys, "metric", "status", "value", "reason", F.col("sample_size").alias("n"), (F.col("sample_size") < minimum).alias("small")
    )


def slice_vs_overall(slices: DataFrame, overall: DataFrame) -> DataFrame:
    """Slice metric minus the overall metric, in points. Minority recall is never compared: the
    minority class may differ between populations."""
    base = overall.select("metric", F.col("value").alias("overall"))
    delta = F.when(F.col("metric") != "minority_recall", (F.col("value") - F.col("overall")) * 100)
    return slices.join(F.broadcast(base), "metric").select(
        "column", "slice_value", "metric", "value", "overall", delta.alias("delta_pp")
    )
