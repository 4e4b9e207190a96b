"""The eight named diagnostics behind one call: ``run_tool(name, frame, **arguments)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import drift as dr
from ..operators import leakage as lk
from ..operators import metrics as m
from ..operators import quality as q
from ..operators import slices as sl
from ..operators import thresholds as th


def profile_dataset(df: DataFrame, target: str = "y_true") -> dict[str, DataFrame]:
    return {"columns": q.column_roles(df, target), "profile": q.column_profile(df), "classes": q.class_prevalence(df, target)}


def compute_classification_metrics(df: DataFrame, positive: str = "1") -> dict[str, DataFrame]:
    return {"confusion": m.confusion(df, positive), "metrics": m.classification_metrics(df, positive)}


def threshold_sweep(df: DataFrame, thresholds=th.GRID, costs: tuple[float, float] | None = None, positive: str = "1") -> dict[str, DataFrame]:
    sweep = th.threshold_sweep(df, thresholds, positive)
    if costs is None:
        return {"points": sweep}
    costed = th.with_cost(sweep, *costs)
    return {"points": costed, "selected": th.cost_select(costed)}


def check_calibration(df: DataFrame, bins: int = 10, strategy: str = "equal_width", positive: str = "1") -> dict[str, DataFrame]:
    builders = {"equal_width": cal.calibration_equal_width, "equal_frequency": cal.calibration_equal_frequency}
    if strategy not in builders:
        raise ValueError(f"strategy is one of {sorted(builders)}")
    table = builders[strategy](df, bins, positive)
    return {"metrics": cal.brier(df, positive).unionByName(cal.expected_calibration_error(table)), "bins": table}


def scan_feature_leakage(
    df: DataFrame, features: list[str], predicted_at: str | None = None, outcome_at: str | None = None, positive: str = "1"
) -> dict[str, DataFrame]:
    if (predicted_at is None) != (outcome_at is None) or (predicted_at is not None and predicted_at == outcome_at):
        raise ValueError("give both time columns, and different ones, or neither")
    barred = {"y_true", "y_pred", "y_probability"} & set(features)
    if barred:
        raise ValueError(f"not features: {sorted(barred)}")
    out = {"observations": lk.scan(df, features, positive)}
    if predicted_at is not None:
        out["temporal"] = lk.temporal_order(df, predicted_at, outcome_at)
    return out


def slice_evaluation(df: DataFrame, columns: list[str], minimum: int = 30, positive: str = "1") -> dict[str, DataFrame]:
    slices = sl.slice_metrics(df, columns, minimum, positive)
    overall = m.classification_metrics(df, positive)
    return {"overall": overall, "slices": slices, "deltas": sl.slice_vs_overall(slices, overall), "coverage": sl.slice_coverage(df, columns)}


def run_drift_tests(df: DataFrame, comparison: DataFrame, columns: list[str], method: str, bins: int | None = None) -> dict[str, DataFrame]:
    if method == "psi":
        if bins is None:
            raise ValueError("PSI requires an explicit bin count")
        return {"comparisons": dr.psi(df, comparison, columns, bins), "configuration": dr.psi_config(df, comparison, columns, bins)}
    runs = {"ks": dr.ks_stat, "wasserstein": dr.wasserstein1}
    if method not in runs:
        raise ValueError("method is ks, wasserstein or psi")
    return {"comparisons": runs[method](df, comparison, columns)}


def run_counterfactual_test(df: DataFrame, minimum_gap: float = 10.0, positive: str = "1") -> dict[str, DataFrame]:
    return {"outcome": m.accuracy_paradox(m.confusion(df, positive), minimum_gap)}


TOOLS: dict[str, Callable[..., dict[str, DataFrame]]] = {
    f.__name__: f
    for f in (
        profile_dataset,
        compute_classification_metrics,
        threshold_sweep,
        check_calibration,
        scan_feature_leakage,
        slice_evaluation,
        run_drift_tests,
        run_counterfactual_test,
    )
}


def run_tool(name: str, df: DataFrame, **arguments) -> dict[str, DataFrame]:
    """Report tables of one named diagnostic; unknown names are refused."""
    if name not in TOOLS:
        raise ValueError(f"unknown tool {name}; known: {sorted(TOOLS)}")
    return TOOLS[name](df, **arguments)


def tool_names(spark) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(TOOLS)], "tool string").orderBy(F.col("tool"))
