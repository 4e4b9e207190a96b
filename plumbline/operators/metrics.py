"""Confusion counts and the threshold-dependent measurements.

Evaluation frames carry ``row_id, y_true, y_pred, y_probability`` plus metadata columns. Every
function takes ``by``: the key columns to measure separately (none for the whole population).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import clamp, safe_ratio
from ..functions.measures import measure, to_long
from .running import running

CONFUSION = ("tp", "fp", "tn", "fn")


def confusion(ev: DataFrame, positive: str = "1", by: Sequence[str] = (), predicted: Column | None = None) -> DataFrame:
    """TP/FP/TN/FN over all rows: one map-side combined aggregate."""
    actual = F.col("y_true") == positive
    guess = (predicted if predicted is not None else F.col("y_pred")) == positive
    return ev.groupBy(*by).agg(
        F.count_if(actual & guess).alias("tp"),
        F.count_if(~actual & guess).alias("fp"),
        F.count_if(~actual & ~guess).alias("tn"),
        F.count_if(actual & ~guess).alias("fn"),
    )


def rate_columns() -> dict[str, tuple[Column, str]]:
    """Metric name -> (value or NULL, reason when undefined) over confusion columns."""
    tp, fp, tn, fn = (F.col(c) for c in CONFUSION)
    n, positives, negatives = tp + fp + tn + fn, tp + fn, tn + fp
    recall, specificity = safe_ratio(tp, positives), safe_ratio(tn, negatives)
    both = (positives > 0) & (negatives > 0)
    minority = F.when(positives < negatives, recall).when(positives > negatives, specificity)
    return {
        "accuracy": (safe_ratio(tp + tn, n), "no rows"),
        "precision": (safe_ratio(tp, tp + fp), "no predicted positives"),
        "recall": (recall, "no actual positives"),
        "specificity": (specificity, "no actual negatives"),
        "f1": (safe_ratio(tp * 2, tp * 2 + fp + fn), "no actual or predicted positives"),
        "positive_prevalence": (safe_ratio(positives, n), "no rows"),
        "negative_prevalence": (safe_ratio(negatives, n), "no rows"),
        "balanced_accuracy": (F.when(both, (recall + specificity) / 2), "one class only"),
        "minority_recall": (F.when(both, minority), "no unique minority class"),
    }


BALANCED = ("balanced_accuracy", "minority_recall")


def metric_rows(counts: DataFrame, by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Measurements of confusion rows in long form."""
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    chosen = {k: v for k, v in rate_columns().items() if names is None or k in names}
    return to_long(counts, [measure(k, value, reason, n) for k, (value, reason) in chosen.items()], by)


def rate_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return metric_rows(counts, by, [k for k in rate_columns() if k not in BALANCED])


def balanced_minority(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return metric_rows(counts, by, BALANCED)


def score_counts(ev: DataFrame, positive: str = "1", by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score; rows without one form a NULL score."""
    return ev.groupBy(*by, F.col("y_probability").alias("score")).agg(
        F.count_if(F.col("y_true") == positive).alias("pos"),
        F.count_if(F.col("y_true") != positive).alias("neg"),
    )


def _score_steps(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running positives and negatives, best score first; unscored rows come last."""
    sums = {"cum_pos": ("sum", F.col("pos")), "cum_neg": ("sum", F.col("neg"))}
    return running(counts, "score", sums, by, descending=True)


def cum_counts(ev: DataFrame, positive: str = "1", by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at or above each distinct score. Equal scores form one row."""
    steps = _score_steps(score_counts(ev, positive, by), by)
    return steps.filter(F.col("score").isNotNull()).drop("all_cum_pos", "all_cum_neg")


def ranking_metrics(ev: DataFrame, positive: str = "1", by: Sequence[str] = ()) -> DataFrame:
    """Trapezoidal ROC AUC and non-interpolated average precision, tie groups entering together.

    Undefined when one class is absent or any probability is missing: no filtered subset is scored.
    """
    return ranking_of_counts(score_counts(ev, positive, by), by)


def ranking_of_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``ranking_metrics`` of (by, score, pos, neg) rows."""
    before, upto = F.col("cum_pos") - F.col("pos"), F.col("cum_pos")
    # Shares of the totals, not counts: the area stays below 1 and cannot overflow.
    strip = F.col("neg") / F.col("all_cum_neg") * (before + upto) / F.col("all_cum_pos") / 2
    step = F.col("pos") / F.col("all_cum_pos") * (upto / (upto + F.col("cum_neg")))
    size = F.col("pos") + F.col("neg")
    zero = F.lit(0).cast("long")
    defined = (F.col("all_cum_pos") > 0) & (F.col("all_cum_neg") > 0)
    facts = _score_steps(counts, by).groupBy(*by).agg(
        F.coalesce(F.sum(size), zero).alias("n"),
        F.coalesce(F.sum("pos"), zero).alias("positives"),
        F.coalesce(F.sum("neg"), zero).alias("negatives"),
        F.coalesce(F.sum(F.when(F.col("score").isNull(), size)), zero).alias("unscored"),
        F.sum(F.when(defined, strip)).alias("area"),
        F.sum(F.when(defined, step)).alias("gain"),
    )
    one_class = (F.col("positives") == 0) | (F.col("negatives") == 0)
    usable = ~one_class & (F.col("unscored") == 0)
    reason = F.when(one_class, "one class only").otherwise("missing probabilities")
    roc, ap = F.when(usable, clamp(F.col("area"), 0, 1)), F.when(usable, clamp(F.col("gain"), 0, 1))
    return to_long(
        facts,
        [measure("roc_auc", roc, reason, F.col("n")), measure("average_precision", ap, reason, F.col("n"))],
        by,
    )


def roc_auc(ev: DataFrame, positive: str = "1", by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(ev, positive, by).filter(F.col("metric") == "roc_auc")


def average_precision(ev: DataFrame, positive: str = "1", by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(ev, positive, by).filter(F.col("metric") == "average_precision")


def classification_metrics(ev: DataFrame, positive: str = "1", by: Sequence[str] = ()) -> DataFrame:
    """The full metric set: rates, balanced and minority measures, and both ranking areas."""
    return metric_rows(confusion(ev, positive, by), by).unionByName(ranking_metrics(ev, positive, by))


def accuracy_paradox(counts: DataFrame, minimum_gap: float = 10.0) -> DataFrame:
    """Does accuracy exceed both balanced accuracy and minority recall by ``minimum_gap`` points?"""
    if not 0 < minimum_gap <= 100:
        raise ValueError("minimum_gap must be in (0, 100]")
    rates = rate_columns()
    accuracy, balanced, minority = (rates[k][0] for k in ("accuracy", "balanced_accuracy", "minority_recall"))
    gaps = counts.select(
        *counts.columns,
        accuracy.alias("accuracy"),
        balanced.alias("balanced_accuracy"),
        minority.alias("minority_recall"),
        ((accuracy - balanced) * 100).alias("balanced_gap"),
        ((accuracy - minority) * 100).alias("minority_gap"),
    )
    defined = F.col("balanced_gap").isNotNull() & F.col("minority_gap").isNotNull()
    gap = F.when(defined, F.least("balanced_gap", "minority_gap"))
    outcome = (
        F.when(~defined, "inconclusive")
        .when(gap >= minimum_gap, "supports")
        .when(F.greatest("balanced_gap", "minority_gap") >= minimum_gap, "weakens")
        .otherwise("rejects")
    )
    return gaps.select("*", gap.alias("paradox_gap"), outcome.alias("outcome"))
