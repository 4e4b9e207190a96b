"""Comparing a dataset with its training set, and the review of findings that follows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import decimal_value, is_missing
from .quality import cell_counts, label_counts, profile_counts

POINTS = 0.1
RANGE_SHARE = 0.2


def _columns_of(df: DataFrame, side: str) -> DataFrame:
    """Column names of a frame with the number of non-missing cells behind each."""
    filled = [F.count_if(~is_missing(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(df.columns)]
    names = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("cells")) for i, c in enumerate(df.columns)]
    return df.agg(*filled).select(F.inline(F.array(*names))).select("column", F.lit(side).alias("side"), "cells")


def column_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of ``a`` that ``b`` lacks, with the cells they hold."""
    only = [c for c in a.columns if c not in set(b.columns)]
    if not only:
        return a.sparkSession.createDataFrame([], "column string, cells long")
    return _columns_of(a.select(*only), "").select("column", "cells")


def schema_diff(train: DataFrame, other: DataFrame) -> DataFrame:
    missing = column_except(train, other).select("column", F.lit("missing").alias("side"), "cells")
    extra = column_except(other, train).select("column", F.lit("additional").alias("side"), "cells")
    return missing.unionByName(extra)


def feature_overlap(train: DataFrame, other: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of ``other`` whose whole feature tuple occurs in training.

    Both sides shrink to distinct tuples with counts before the join, so frequent tuples cost nothing.
    """
    if not features or any(c not in other.columns for c in features):
        raise ValueError("feature schemas differ: overlap cannot be checked")
    known = train.select(*features).distinct()
    seen = other.groupBy(*features).agg(F.count(F.lit(1)).alias("n"))
    same = [seen[c].eqNullSafe(known[c]) for c in features]
    overlap = seen.join(known, same, "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("overlap"))
    return seen.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")).select(overlap.scalar().alias("overlap"), "n")


def unseen_values(train: DataFrame, other: DataFrame, columns: Sequence[str], most: int | None = None) -> DataFrame:
    """Cells whose value never occurs in training, for wordy columns (with ``most`` known values or fewer, if given)."""
    known = cell_counts(train, columns).filter(~is_missing(F.col("cell")))
    eligible = known.groupBy("column").agg(
        F.count(F.lit(1)).alias("values"), F.count_if(decimal_value(F.col("cell")).isNull()).alias("words")
    )
    few = F.lit(True) if most is None else F.col("values") <= most
    eligible = eligible.filter(few & (F.col("words") > 0)).select("column")
    seen = cell_counts(other, columns).filter(~is_missing(F.col("cell"))).join(F.broadcast(eligible), "column", "left_semi")
    fresh = seen.join(known.select("column", "cell"), ["column", "cell"], "left_anti")
    marked = seen.groupBy("column").agg(F.sum("n").alias("observed")).join(
        fresh.groupBy("column").agg(F.sum("n").alias("unseen")), "column"
    )
    return marked.select("column", "unseen", "observed")


def class_share(train: DataFrame, other: DataFrame, target: str) -> DataFrame:
    """Class shares that moved by at least ten points, largest first."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = label_counts(df, target)
        return counts.select("label", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias(name))

    joined = shares(train, "a").join(shares(other, "b"), "label", "full_outer")
    delta = F.coalesce("b", F.lit(0.0)) - F.coalesce("a", F.lit(0.0))
    moved = joined.select("label", delta.alias("delta")).filter(F.abs("delta") >= POINTS)
    return moved.orderBy(F.abs("delta").desc(), "label")


def profile_compare(train: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Both column profiles side by side, from one pass over each frame."""
    def side(df: DataFrame, s: str) -> DataFrame:
        p = profile_counts(cell_counts(df, columns))
        return p.select("column", *[F.col(c).alias(f"{c}_{s}") for c in p.columns if c != "column"])

    return side(train, "train").join(side(other, "other"), "column")


def missing_shift(compared: DataFrame) -> DataFrame:
    rate = lambda s: F.col(f"missing_{s}") / (F.col(f"missing_{s}") + F.col(f"observed_{s}"))
    moved = compared.select("column", (rate("other") - rate("train")).alias("share"))
    return moved.filter(F.abs("share") >= POINTS).select("column", (F.col("share") * 100).alias("delta_pp"))


def mean_shift(compared: DataFrame) -> DataFrame:
    """Numeric columns; ``flagged`` where the mean moved by more than 20 % of the training range."""
    both = compared.filter(F.col("mean_train").isNotNull() & F.col("mean_other").isNotNull())
    span = F.col("max_train") - F.col("min_train")
    moved = F.abs(F.col("mean_other") - F.col("mean_train")) > F.greatest(span * RANGE_SHARE, F.lit(1e-12))
    return both.select("column", "mean_train", "mean_other", moved.alias("flagged"))


# --- findings -------------------------------------------------------------------------------

STRENGTHS = ("Observed", "Supported", "Suggested")
FINDING_SCHEMA = "source string, title string, evidence string, strength string, category string"
LENSES = {
    "Data quality & distribution": "data",
    "Training & optimization": "training",
    "Evaluation & leakage": "evaluation",
}


def lens_filter(findings: DataFrame, lens: str) -> DataFrame:
    category = LENSES.get(lens)
    return findings.filter(F.col("category") == category) if category else findings


def strength_rank(strength: str = "strength"):
    return F.array_position(F.array(*[F.lit(s) for s in STRENGTHS]), F.col(strength))


def rank_findings(findings: DataFrame) -> DataFrame:
    return findings.orderBy(strength_rank(), "title", "source", "evidence")


def hypothesis_key(title):
    """Findings that speak to the same explanation share a key."""
    lower = F.lower(title)
    return (
        F.when(lower.contains("imbalance"), "imbalance")
        .when(lower.contains("shift"), "shift")
        .when(lower.contains("leakage") | title.contains("Repeated") | lower.contains("repeated"), "leakage")
        .when(lower.contains("missing"), "missing")
        .otherwise(F.regexp_replace(lower, r"\s+", "-"))
    )


def dataset_findings(
    train: DataFrame, target: str, validation: DataFrame | None = None, production: DataFrame | None = None
) -> DataFrame:
    """Hypothesis-keyed support and conflict rows of a training set and its comparisons.

    Columns: hypothesis, kind (support | conflict), detail, score.
    """
    counts = cell_counts(train)
    profile = profile_counts(counts)
    row = lambda h, kind, detail, score: [
        F.lit(h).alias("hypothesis"), F.lit(kind).alias("kind"), detail.alias("detail"), F.lit(score).alias("score")
    ]
    total = profile.agg(F.sum("missing").alias("missing"))
    parts = [
        total.filter(F.col("missing") > 0).select(*row("missing", "support", F.concat(F.col("missing").cast("string"), F.lit(" missing cells")), 3))
    ]
    labels = counts.filter((F.col("column") == target) & ~is_missing(F.col("cell")))
    share = labels.agg(F.max("n").alias("top"), F.sum("n").alias("all")).select((F.col("top") / F.col("all")).alias("share"))
    parts.append(share.filter(F.col("share") >= 0.7).select(*row("imbalance", "support", F.lit("dominant target class"), 3)))
    parts.append(share.filter(F.col("share") < 0.7).select(*row("imbalance", "conflict", F.lit("target classes are balanced"), 0)))
    from .quality import target_copies

    copies = target_copies(train, target).filter(F.col("copies") & (F.col("rows") >= 3))
    parts.append(copies.select(*row("leakage", "support", F.concat(F.lit("target copy "), F.col("column")), 3)))
    if validation is not None:
        features = [c for c in train.columns if c != target]
    if validation is not None and features and set(features) <= set(validation.columns):
        overlap = feature_overlap(train, validation, features)
        text = F.concat(F.col("overlap").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" validation rows overlap"))
        parts.append(overlap.filter(F.col("overlap") > 0).select(*row("leakage", "support", text, 3)))
        parts.append(overlap.filter(F.col("overlap") == 0).select(*row("leakage", "conflict", F.lit("no feature-row overlap"), 0)))
    if production is not None:
        shared = [c for c in train.columns if c in production.columns]
        compared = profile_compare(train, production, shared)
        shifts = [
            missing_shift(compared).select(F.concat(F.lit("missing share of "), "column").alias("d")),
            mean_shift(compared).filter("flagged").select(F.concat(F.lit("mean of "), "column").alias("d")),
            unseen_values(train, production, shared).select(F.concat(F.lit("unseen values in "), "column").alias("d")),
            class_share(train, production, target).select(F.concat(F.lit("share of class "), "label").alias("d")),
        ]
        parts.append(reduce(DataFrame.union, shifts).select(*row("shift", "support", F.col("d"), 2)))
    return reduce(DataFrame.unionByName, parts)


def log_support(findings: DataFrame) -> DataFrame:
    """Findings of a log audit in the same shape: strength Observed 3, Supported 2, else 1."""
    score = F.when(F.col("strength") == "Observed", 3).when(F.col("strength") == "Supported", 2).otherwise(1)
    return findings.select(
        hypothesis_key(F.col("title")).alias("hypothesis"), F.lit("support").alias("kind"), F.col("evidence").alias("detail"), score.alias("score")
    )


def combined_diagnosis(
    rows: DataFrame,
    same_run: str | None = None,
    feature_available: str | None = None,
    comparable: str | None = None,
    sources: Sequence[str] = ("datasets",),
) -> DataFrame:
    """Hypotheses by review priority: strongest signal, minus one when anything conflicts.

    Answers of the user only count for hypotheses that have support. ``same_run="no"`` conflicts where ``sources`` holds
    both logs and datasets. Leakage gains a conflict if the suspect feature was available and a support if it was not;
    all others gain a conflict if the metrics are not comparable.
    """
    supported = rows.groupBy("hypothesis").agg(
        F.max(F.when(F.col("kind") == "support", F.col("score"))).alias("strongest"),
        F.count_distinct(F.when(F.col("kind") == "support", F.col("detail"))).alias("support"),
        F.count_if(F.col("kind") == "conflict").alias("recorded"),
    )
    supported = supported.filter(F.col("strongest").isNotNull())
    leakage = F.col("hypothesis") == "leakage"
    mixed = int(same_run == "no" and {"logs", "datasets"} <= set(sources))
    answered = F.when(leakage, int(feature_available == "yes")).otherwise(int(comparable == "no")) + mixed
    reported = F.when(leakage, int(feature_available == "no")).otherwise(0)
    conflicts = F.col("recorded") + answered
    score = F.greatest(F.lit(0), F.col("strongest") - F.when(conflicts > 0, 1).otherwise(0))
    table = supported.select("hypothesis", score.alias("score"), (F.col("support") + reported).alias("support"), conflicts.alias("conflicts"))
    return rank_hypotheses(table)


def rank_hypotheses(diagnosis: DataFrame) -> DataFrame:
    return diagnosis.orderBy(F.col("score").desc(), "hypothesis")
