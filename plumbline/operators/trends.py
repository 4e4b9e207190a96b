"""Epoch histories, trend heuristics and gap findings over metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import previous

CURVES = ("Training loss", "Validation loss", "Training accuracy", "Validation accuracy")
TAIL = 5
GAP = 0.1


def last_valid(metrics: DataFrame) -> DataFrame:
    """Last valid value per source and metric, in source order."""
    return metrics.groupBy("source", "metric").agg(F.max_by("value", F.struct("line_no", "position")).alias("value"))


def epoch_history(metrics: DataFrame) -> DataFrame:
    """Curve values per source and epoch: source, epoch, metric, value.

    Complementary lines of one epoch merge. A source that repeats a metric for an epoch, or whose
    epochs run backwards, loses its whole history: merged runs must not look like one.
    """
    curve = metrics.filter(F.col("epoch").isNotNull() & F.col("metric").isin(*CURVES))
    points = curve.groupBy("source", "line_no", "epoch", "metric").agg(F.max_by("value", "position").alias("value"))
    lines = points.select("source", "line_no", "epoch").distinct()
    ordered = previous(lines, "line_no", ["epoch"], ("source",))
    backwards = ordered.filter(F.col("epoch") < F.col("prev.epoch")).select("source")
    merged = points.groupBy("source", "epoch", "metric").agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))
    repeated = merged.filter(F.col("n") > 1).select("source")
    ambiguous = backwards.union(repeated).distinct()
    return merged.join(ambiguous, "source", "left_anti").select("source", "epoch", "metric", "value")


def history_tail(history: DataFrame, n: int = 1000) -> DataFrame:
    """The last ``n`` epochs of each source; earlier epochs are dropped inside the map tasks already."""
    rank = F.dense_rank().over(Window.partitionBy("source").orderBy(F.col("epoch").desc()))
    return history.select("*", rank.alias("__rank")).filter(F.col("__rank") <= n).drop("__rank")


def _tails(history: DataFrame) -> DataFrame:
    """Per source, the curve points of its last five epochs where at least four are consecutive."""
    wide = history_tail(history, TAIL).groupBy("source", "epoch").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in CURVES[:2]]
    )
    # At most five points per source.
    points = wide.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("epoch", *CURVES[:2]))).alias("points"))
    size = F.size("points")
    span = F.element_at("points", -1)["epoch"] - F.get("points", F.lit(0))["epoch"]
    consecutive = points.filter((size >= 4) & (span == size - 1))
    series = {name: F.col("points").getField(name) for name in CURVES[:2]}
    whole = lambda s: F.when(~F.exists(s, lambda v: v.isNull()), s)
    return consecutive.select(
        "source",
        F.get("points", F.lit(0))["epoch"].alias("first_epoch"),
        F.element_at("points", -1)["epoch"].alias("last_epoch"),
        whole(series[CURVES[0]]).alias("train"),
        whole(series[CURVES[1]]).alias("val"),
    )


def _first(s: str) -> Column:
    return F.get(s, F.lit(0))


def _last(s: str) -> Column:
    return F.element_at(s, -1)


def _overfit() -> Column:
    """Training loss down and validation loss up by at least 10 % over the tail."""
    return (
        (_first("train") > 0)
        & (_first("val") > 0)
        & (_last("train") <= _first("train") * 0.9)
        & (_last("val") >= _first("val") * 1.1)
    )


def _flat(s: str) -> Column:
    """A positive loss that varies by at most 1 % of its maximum over the tail."""
    high, low = F.array_max(s), F.array_min(s)
    return (high > 0) & (low > 0) & ((high - low) / high <= 0.01)


def _swinging(s: str) -> Column:
    """At least two direction changes with both steps 10 % of the maximum or more."""
    scale = F.array_max(s)
    step = lambda i: F.get(s, i + 1) - F.get(s, i)
    turn = lambda i: (
        (step(i) * step(i + 1) < 0) & (F.abs(step(i)) >= scale * 0.1) & (F.abs(step(i + 1)) >= scale * 0.1)
    )
    turns = F.size(F.filter(F.sequence(F.lit(0), F.size(s) - 3), turn))
    return (scale > 0) & (turns >= 2)


def _first_curve(condition) -> Column:
    """The first of the two loss curves that meets ``condition``."""
    return F.when(condition("train"), CURVES[0]).when(condition("val"), CURVES[1])


def trends(history: DataFrame) -> DataFrame:
    """All trend findings from one pass: source, first_epoch, last_epoch, title, curve."""
    entry = lambda title, curve: F.when(
        curve.isNotNull(), F.struct(F.lit(title).alias("title"), curve.alias("curve"))
    )
    found = F.array_compact(
        F.array(
            entry("Possible overfitting", F.when(_overfit(), CURVES[1])),
            entry("Possible stalled learning", _first_curve(_flat)),
            entry("Possible unstable training", _first_curve(_swinging)),
        )
    )
    return _tails(history).select("source", "first_epoch", "last_epoch", F.inline(found))


def trend_overfit(history: DataFrame) -> DataFrame:
    return trends(history).filter(F.col("title") == "Possible overfitting").drop("curve")


def trend_stalled(history: DataFrame) -> DataFrame:
    return trends(history).filter(F.col("title") == "Possible stalled learning")


def trend_unstable(history: DataFrame) -> DataFrame:
    return trends(history).filter(F.col("title") == "Possible unstable training")


def _finding(title: str, evidence: Column, strength: str, category: str) -> Column:
    return F.struct(
        F.lit(title).alias("title"),
        evidence.alias("evidence"),
        F.lit(strength).alias("strength"),
        F.lit(category).alias("category"),
    )


def gap_findings(latest: DataFrame, overfit_sources: DataFrame | None = None) -> DataFrame:
    """Metric gaps of ten points, and a majority share of 70 %, per source.

    ``overfit_sources`` already have an overfitting trend; the accuracy gap then adds nothing.
    """
    pick = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    wide = latest.groupBy("source").agg(
        pick("Validation accuracy").alias("val"),
        pick("Production accuracy").alias("prod"),
        pick("Training accuracy").alias("train"),
        pick("Majority share").alias("majority"),
    )
    if overfit_sources is not None:
        known = overfit_sources.select("source").distinct().withColumn("known", F.lit(True))
        wide = wide.join(known, "source", "left")
    else:
        wide = wide.withColumn("known", F.lit(None).cast("boolean"))
    points = lambda a, b: F.format_string("%.1f points", (F.col(a) - F.col(b)) * 100)
    shift = F.when(
        F.col("val") - F.col("prod") >= GAP,
        _finding("Possible distribution shift", points("val", "prod"), "Suggested", "data"),
    )
    fit = F.when(
        F.col("known").isNull() & (F.col("train") - F.col("val") >= GAP),
        _finding("Possible overfitting", points("train", "val"), "Suggested", "training"),
    )
    skew = F.when(
        F.col("majority") >= 0.7,
        _finding("Possible class imbalance", F.format_string("%.1f %%", F.col("majority") * 100), "Supported", "data"),
    )
    return wide.select("source", F.inline(F.array_compact(F.array(shift, fit, skew))))


def combine_sources(findings: DataFrame, order: Sequence[str] = ("source",)) -> DataFrame:
    """Findings of many sources merged by title: the first source speaks for the title, all are counted.

    ``bundled_evidence`` keeps what the others say.
    """
    first = F.struct(*order)
    return findings.groupBy("title").agg(
        F.count(F.lit(1)).alias("sources"),
        F.min_by("source", first).alias("source"),
        F.min_by("evidence", first).alias("evidence"),
        F.min_by("strength", first).alias("strength"),
        F.min_by("category", first).alias("category"),
    )


def bundled_evidence(findings: DataFrame) -> DataFrame:
    """What every source says for a title, one row each: title, source, excerpt."""
    return findings.select("title", "source", F.concat_ws(": ", "source", "evidence").alias("excerpt")).distinct()


def labelled_metrics(metrics: DataFrame) -> DataFrame:
    """Metrics of many sources side by side, each under a label that names its source."""
    return metrics.select("source", "metric", F.concat_ws(" / ", "source", "metric").alias("label"), "value")


def primary_history(history: DataFrame) -> DataFrame:
    """History of the first source that has one; others are never merged in."""
    return history.filter(F.col("source") == history.agg(F.min("source")).scalar())
