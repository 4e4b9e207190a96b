"""Error slices of predictions over metadata and over quantiles of profile features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import bin_label
from ..functions.stats import wilson
from . import sketches
from .running import count_below, order_statistics

SUPPORT = 10
DIMENSIONS = ("site", "device", "split", "annotator")
# Binned profile features and their number of quantile bins.
FEATURE_BINS = {"sharpness": 5, "mean_luminance": 5, "rms_contrast": 5, "colorfulness": 5, "noise": 5, "jpeg_quality": 4}


def _flags() -> tuple[Column, Column]:
    return F.col("y_true") != F.col("y_pred"), F.col("y_true") == 1


def _counts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_error").alias("errors"),
        F.count_if("is_minority").alias("minority"),
        F.count_if(F.col("is_minority") & ~F.col("is_error")).alias("minority_hits"),
    )


def _scored(counts: DataFrame, preds: DataFrame, minimum: int) -> DataFrame:
    wrong, _ = _flags()
    overall = preds.agg(F.avg(wrong.cast("double"))).scalar()
    rate = F.col("errors") / F.col("n")
    low, high = wilson(F.col("errors"), F.col("n"))
    based = counts.filter(F.col("n") >= minimum).select("*", overall.alias("overall"))
    excess = rate - F.col("overall")
    return based.select(
        "dimension",
        "value",
        "n",
        "errors",
        rate.alias("error_rate"),
        low.alias("low"),
        high.alias("high"),
        excess.alias("excess"),
        (F.greatest(F.lit(0.0), excess) * F.col("n")).alias("impact"),
        F.when(F.col("minority") > 0, F.col("minority_hits") / F.col("minority")).alias("minority_recall"),
    )


def vision_slices(preds: DataFrame, minimum: int = SUPPORT) -> DataFrame:
    """Slices over site, device, split, annotator and every metadata key, above the support floor."""
    wrong, minority = _flags()
    fixed = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in DIMENSIONS if c in preds.columns]
    cells = F.array(*fixed)
    if "metadata" in preds.columns:
        extra = F.transform(
            F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))),
            lambda e: F.struct(F.concat(F.lit("meta:"), e.key).alias("dimension"), e.value.cast("string").alias("value")),
        )
        cells = F.concat(cells, extra)
    rows = preds.select(wrong.alias("is_error"), minority.alias("is_minority"), F.inline(cells))
    used = rows.filter(F.col("value").isNotNull() & (F.col("value") != ""))
    return _scored(_counts(used, ("dimension", "value")), preds, minimum)


def profile_join(preds: DataFrame, profiles: DataFrame) -> DataFrame:
    """Predictions with the profile of their image, where there is one."""
    return preds.join(profiles, "id", "left")


def quantile_cuts(profiles: DataFrame, bins: Mapping[str, int], minimum: int = SUPPORT) -> dict[str, list[float]]:
    """Exact values at positions floor(i n / k) per feature; features with too few values are left out.

    One job for all features. The driver receives at most the sum of the bin counts.
    """
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in bins])
    values = profiles.select(F.inline(pairs)).filter(F.abs(F.col("value")) < float("inf"))
    counts = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    size = F.col("all_upto")
    every = None
    for feature, k in bins.items():
        ranks = F.array(*[F.floor(size * i / k) + 1 for i in range(1, k)])
        every = F.when(F.col("feature") == feature, ranks) if every is None else every.when(F.col("feature") == feature, ranks)
    found = order_statistics(counts, "value", F.array_distinct(every), ("feature",)).collect()
    cuts: dict[str, list[float]] = {}
    for feature, k in bins.items():
        mine = {r["rank"]: r["value"] for r in found if r["feature"] == feature}
        total = next((r["size"] for r in found if r["feature"] == feature), 0)
        if total >= 2 * minimum:
            cuts[feature] = [mine[i * total // k + 1] for i in range(1, k)]
    return cuts


def sketched_cuts(profiles: DataFrame, bins: Mapping[str, int], minimum: int = SUPPORT) -> dict[str, list[float]]:
    """``quantile_cuts`` read off one mergeable sketch per feature, within ``sketches.rank_error`` of their ranks."""
    found = {r.feature: r for r in sketches.quantile_levels(sketches.number_sketches(profiles, list(bins)), bins).collect()}
    return {f: list(found[f].cuts) for f in bins if f in found and found[f].n >= 2 * minimum}


def quantile_slices(
    preds: DataFrame, profiles: DataFrame, bins: Mapping[str, int] | None = None, minimum: int = SUPPORT, approx: bool = False
) -> DataFrame:
    """Slices over quantile bins of profile features, grouped by bin index and labelled after; ``approx`` takes the cuts of sketches."""
    present = {f: k for f, k in (bins or FEATURE_BINS).items() if f in profiles.columns}
    cuts = (sketched_cuts if approx else quantile_cuts)(profiles, present, minimum)
    if not cuts:
        raise ValueError(f"no feature has {2 * minimum} finite values")
    wrong, minority = _flags()
    cells, names = [], None
    for feature, edges in cuts.items():
        array = F.array(*[F.lit(e) for e in edges])
        value = F.when(F.abs(F.col(feature)) < float("inf"), F.col(feature).cast("double"))
        place = F.when(value.isNotNull(), count_below(array, len(edges), value, strict=True))
        cells.append(F.struct(F.lit(feature).alias("feature"), place.alias("bin")))
        label = bin_label(feature, F.get(array, F.col("bin") - 1), F.get(array, F.col("bin")))
        names = F.when(F.col("feature") == feature, label) if names is None else names.when(F.col("feature") == feature, label)
    joined = preds.join(profiles.select("id", *cuts), "id")
    rows = joined.select(wrong.alias("is_error"), minority.alias("is_minority"), F.inline(F.array(*cells)))
    counts = _counts(rows.filter(F.col("bin").isNotNull()), ("feature", "bin"))
    labelled = counts.select("*", F.concat(F.lit("feature:"), "feature").alias("dimension"), names.alias("value"))
    return _scored(labelled, preds, minimum)


def union_dimensions(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def rank_slices(slices: DataFrame, k: int = 5) -> DataFrame:
    return slices.orderBy(F.col("impact").desc(), "dimension", "value").limit(k)


def mean_profile(profiles: DataFrame) -> DataFrame:
    return profiles.agg(
        F.avg("sharpness").alias("sharpness"),
        F.avg("colorfulness").alias("colorfulness"),
        F.avg("rms_contrast").alias("rms_contrast"),
        F.round(F.avg("jpeg_quality")).alias("jpeg_quality"),
    )


def severity_rollup(leakage: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Report severity from the leakage row and the presence of a supported concept."""
    supported = verdicts.agg(F.coalesce(F.bool_or(F.col("verdict") == "supported"), F.lit(False))).scalar()
    row = leakage.select("severity", "gap", supported.alias("supported"))
    level = (
        F.when((F.col("severity") == "critical") | (F.col("supported") & (F.col("gap") > 0.15)), "critical")
        .when(F.col("supported") | (F.col("severity") == "moderate"), "high")
        .otherwise("moderate")
    )
    return row.select(level.alias("severity"), F.col("severity").alias("leak_severity"), "supported")
