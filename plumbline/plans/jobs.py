"""Composite jobs: the end-to-end diagnostics, each returning its report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration as cal
from ..operators import compare as cp
from ..operators import concepts as co
from ..operators import drift as dr
from ..operators import impact as im
from ..operators import metrics as m
from ..operators import neardup as nd
from ..operators import quality as q
from ..operators import slices as sl
from ..operators import thresholds as th
from ..operators import trends as tr
from ..session import cut
from ..sources import logs as lg

Report = dict[str, DataFrame]


def threshold_repair(
    ev: DataFrame, fn_cost: float = 10.0, fp_cost: float = 1.0, baseline: float = 0.5, target: float = float("inf")
) -> Report:
    """Metrics, paradox gap, costed 101-point sweep, cheapest policy, re-evaluation and gate.

    The chosen threshold is one number read from the sweep; everything else stays lazy.
    """
    counts = m.confusion(ev)
    sweep = th.with_cost(th.threshold_sweep(ev, sorted({*th.GRID, baseline})), fn_cost, fp_cost)
    chosen = th.criterion_select(sweep, "total_cost", "at_most", target)
    policy = chosen.first()
    report = {"metrics": m.metric_rows(counts), "paradox": m.accuracy_paradox(counts), "sweep": sweep, "selection": chosen}
    if policy.threshold is not None:
        compared = th.repair_reevaluate(ev, baseline, policy.threshold, "total_cost", target, (fn_cost, fp_cost))
        report["comparison"] = compared
        report["gate"] = compared.filter(F.col("status").isNotNull()).agg(
            F.bool_and(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") != "passed").alias("failed")
        )
    return report


def calibration_case(ev: DataFrame, bins: int = 10) -> Report:
    table = cal.calibration_equal_width(ev, bins)
    summary = cal.brier(ev).unionByName(cal.expected_calibration_error(table))
    return {"metrics": m.metric_rows(m.confusion(ev)).unionByName(summary), "bins": table}


def site_case(ev: DataFrame, minimum: int = 5) -> Report:
    return {"metrics": m.metric_rows(m.confusion(ev)), "slices": sl.slice_metrics(ev, ["site"], minimum)}


def dataset_audit(train: DataFrame, validation: DataFrame, production: DataFrame, target: str) -> Report:
    """Profile, compare and diagnose three splits."""
    rows = cp.dataset_findings(train, target, validation, production)
    return {"profile": q.column_profile(train), "warnings": q.column_warnings(train, target), "findings": rows, "diagnosis": cp.combined_diagnosis(rows)}


def log_audit(lines: DataFrame) -> Report:
    """Extract, history, trends and gaps.

    The metric rows and the histories are written once: the log text is parsed a single time.
    """
    metrics = cut(lg.extract_metrics(lg.join_headers(lines)), "log-metrics")
    history = cut(tr.epoch_history(metrics), "log-history")
    found = tr.trends(history)
    overfit = found.filter(F.col("title") == "Possible overfitting")
    gaps = tr.gap_findings(tr.last_valid(metrics), overfit).select("source", "title")
    return {"metrics": tr.last_valid(metrics), "history": tr.history_tail(history), "findings": found.select("source", "title").unionByName(gaps)}


def vision_audit(preds: DataFrame, hashes: DataFrame, profiles: DataFrame, labels: DataFrame, audit: DataFrame, bins: Mapping[str, int]) -> Report:
    """Duplicates, leakage, slices, discovery split, concept tests and the overall severity."""
    pairs = nd.near_dup_pairs(hashes)
    leakage = nd.leak_accuracy_gap(preds, nd.leaked_ids(hashes))
    slices = im.union_dimensions(im.vision_slices(preds), im.quantile_slices(preds, profiles, bins))
    discovery = co.topk_discovery(preds)
    labelled = co.labelled_rows(co.held_out(preds, co.discovery_union(discovery)), labels)
    verdicts = co.concept_verdict(labelled, audit)
    return {
        "pairs": nd.order_pairs(pairs),
        "leakage": leakage,
        "slices": im.rank_slices(slices, 6),
        "discovery": discovery,
        "concepts": verdicts,
        "severity": im.severity_rollup(leakage, verdicts),
    }


def multi_dataset_challenge(datasets: Mapping[str, DataFrame], done: Sequence[tuple[str, str]], columns: Sequence[str]) -> Report:
    """The next untested dataset pair, and the review of all pairs."""
    names = list(datasets)
    tested = {frozenset(p) for p in done}
    pending = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if frozenset((a, b)) not in tested]
    spark = next(iter(datasets.values())).sparkSession
    return {
        "next": spark.createDataFrame(pending[:1], "ref string, comp string"),
        "review": dr.dataset_pair_review(datasets, columns),
    }
