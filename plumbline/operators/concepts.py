"""Discovery sets, held-out rows and concept verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .inference import bh_adjust, cohen_kappa, effect_counts, stratified_effect, two_proportion

KAPPA_FLOOR = 0.60
ALPHA = 0.05


def confusion_flags(preds: DataFrame) -> DataFrame:
    return preds.select(
        "*", (F.col("y_true") != F.col("y_pred")).alias("is_error"), (F.col("y_true") == 1).alias("is_minority")
    )


def high_confidence_error(preds: DataFrame) -> DataFrame:
    p = F.col("y_probability")
    return preds.filter((F.col("y_true") != F.col("y_pred")) & ((p > 0.85) | (p < 0.15)))


POOLS = {"train_val": ("train", "val"), "all": None}


def discovery_pool(preds: DataFrame, pool: str = "train_val") -> DataFrame:
    """The rows that concepts may be discovered from: train and validation, or all of them on request."""
    splits = POOLS[pool]
    return preds if splits is None else preds.filter(F.col("split").isin(*splits))


def topk_discovery(preds: DataFrame, k: int = 10, pool: str = "train_val") -> DataFrame:
    """The rows handed to concept discovery: id, category.

    k worst false negatives and false positives, k confident errors and k/2 controls of each kind.
    Picks without a natural order go by id. Each category keeps k rows per task before any shuffle.
    """
    t, y, p = F.col("y_true"), F.col("y_pred"), F.col("y_probability")
    missed, alarm = (t == 1) & (y == 0), (t == 0) & (y == 1)
    entry = lambda name, cond, rank: F.when(
        cond, F.struct(F.lit(name).alias("category"), rank.cast("double").alias("badness"))
    )
    confident = (t != y) & ((p > 0.85) | (p < 0.15))
    roles = F.array_compact(
        F.array(
            entry("false_negative", missed, p),
            entry("false_positive", alarm, -p),
            entry("confident_error", confident, F.lit(0.0)),
            entry("true_positive", (t == 1) & (y == 1), F.lit(0.0)),
            entry("true_negative", (t == 0) & (y == 0), F.lit(0.0)),
        )
    )
    rows = discovery_pool(preds, pool).select("id", F.inline(roles))
    rank = F.row_number().over(Window.partitionBy("category").orderBy("badness", "id"))
    limit = F.when(F.col("category").isin("true_positive", "true_negative"), k // 2).otherwise(k)
    return rows.select("id", "category", rank.alias("rank")).filter(F.col("rank") <= k).filter(F.col("rank") <= limit)


def discovery_union(picks: DataFrame) -> DataFrame:
    return picks.select("id").distinct()


def held_out(preds: DataFrame, discovery: DataFrame, mode: str = "non_discovery") -> DataFrame:
    """Rows the concepts are tested on: everything not discovered from, or its evaluation splits only."""
    rest = preds.join(F.broadcast(discovery.select("id")), "id", "left_anti")
    if mode == "eval_splits":
        return rest.filter(F.col("split").isin("val", "production", "test"))
    if mode != "non_discovery":
        raise ValueError("mode is non_discovery or eval_splits")
    return rest


def labelled_rows(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Held-out predictions with a usable concept label (``uncertain`` and unlabelled rows drop out)."""
    usable = labels.filter(F.col("label").isin("0", "1")).select("id", "concept_id", F.col("label").cast("int").alias("label"))
    joined = rows.join(usable, "id")
    return joined.select("id", "concept_id", "label", "site", "split", (F.col("y_true") != F.col("y_pred")).alias("is_error"))


def verdict(n1: Column, n2: Column, diff: Column, p_adjusted: Column, kappa: Column, survives: Column) -> Column:
    strong = (p_adjusted < ALPHA) & (diff > 0)
    return (
        F.when(kappa < KAPPA_FLOOR, "unreliable_labelling")
        .when((n1 < 25) | (n2 < 25), "underpowered")
        .when(strong & survives, "supported")
        .when(strong, "weakened")
        .when(diff <= 0, "rejected")
        .otherwise("weakened")
    )


def concept_verdict(labelled: DataFrame, audit: DataFrame, investigation: str = "all", stratum: str = "site") -> DataFrame:
    """Verdict and statistics per concept.

    ``audit`` holds repeated ratings (concept_id, r1, r2); a concept without any counts as consistent.
    P-values are adjusted over the concepts of one investigation.
    """
    # One row per concept, read many times by the correction: cut here instead of replanning the joins.
    tested = cut(two_proportion(effect_counts(labelled, ("concept_id",))), "concept-tests")
    adjusted = bh_adjust(tested.withColumn("investigation", F.lit(investigation)), ("investigation",))
    kappas = cohen_kappa(audit, by=("concept_id",)).select("concept_id", "kappa")
    strata = stratified_effect(labelled, stratum).select("concept_id", "survives")
    joined = adjusted.join(kappas, "concept_id", "left").join(strata, "concept_id", "left")
    k, s = F.coalesce("kappa", F.lit(1.0)), F.coalesce("survives", F.lit(False))
    call = verdict(F.col("n1"), F.col("n2"), F.col("diff"), F.col("p_adjusted"), k, s)
    return joined.select(
        "concept_id",
        call.alias("verdict"),
        "n1",
        "n2",
        "p1",
        "p2",
        (F.col("diff") * 100).alias("difference_pp"),
        (F.col("diff_low") * 100).alias("low_pp"),
        (F.col("diff_high") * 100).alias("high_pp"),
        "risk_ratio",
        "p",
        "p_adjusted",
        k.alias("kappa"),
        s.alias("survives"),
    )
