"""Provenance records: references, lineage, verification status, gates and reports.

Record tables have an ``id`` column; nested lists are bridge tables, one row per link.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .running import running

# Confidence levels in order, gated metrics, and the weights of the reliability score.
LEVELS = ("unassessed", "limited", "moderate", "strong")
GATE_METRICS = ("recall", "precision", "balanced_accuracy", "total_cost")
WEIGHTS = {"performance": 0.10, "minority": 0.35, "calibration": 0.10, "drift": 0.10, "leakage": 0.10, "cost": 0.25}
MINORITY_CAP, MINORITY_FLOOR = 38, 35


def lineage_neighbors(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Records linked directly to each of ``ids``, in either direction.

    Edges outside the range of the ids, which for ids of one prefix are those of other kinds, leave before anything moves;
    the rest is written once, since Spark would push a join into every branch that ``edges`` unites.
    """
    ends = ids.agg(F.min("id").alias("first"), F.max("id").alias("last")).first()
    between = lambda c: F.col(c).between(F.lit(ends["first"]), F.lit(ends["last"]))
    near = cut(edges.where(between("from") | between("to")), "near-edges")
    out = near.where(between("from")).select(F.col("from").alias("id"), F.col("to").alias("neighbor"), "relationship", F.lit("out").alias("direction"))
    into = near.where(between("to")).select(F.col("to").alias("id"), F.col("from").alias("neighbor"), "relationship", F.lit("in").alias("direction"))
    return out.unionByName(into).join(ids.select("id").hint("merge"), "id", "left_semi")


def sequence_violations(events: DataFrame, by: Sequence[str], sequence: str = "sequence", at: str = "at", order: str = "position") -> DataFrame:
    """Events whose sequence does not increase or whose time runs backwards, in recorded order."""
    ordered = running(events, order, {"prev": ("prev", F.struct(sequence, at))}, by)
    stuck = F.col(sequence) <= F.col("prev")[sequence]
    back = F.col(at) < F.col("prev")[at]
    rules = F.array_compact(F.array(F.when(stuck, "sequence"), F.when(back, "time")))
    return ordered.select(*by, order, F.explode(rules).alias("rule"))


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def capped_level(level: Column, cap: Column) -> Column:
    """The lower of two confidence levels."""
    return F.when(level_rank(level) <= level_rank(cap), level).otherwise(cap)


def hypothesis_status(experiments: DataFrame) -> DataFrame:
    """Exactly one distinct completed outcome decides a hypothesis; otherwise it stays proposed."""
    done = F.col("status") == "completed"
    outcome = F.when(done, F.coalesce("outcome", F.lit("none")))
    seen = experiments.groupBy("hypothesis_id").agg(F.min(outcome).alias("low"), F.max(outcome).alias("high"))
    named = (
        F.when(F.col("low") == "supports", "supported").when(F.col("low") == "weakens", "weakened").when(F.col("low") == "rejects", "rejected")
    )
    status = F.coalesce(F.when(F.col("low") == F.col("high"), named), F.lit("proposed"))
    return seen.select("hypothesis_id", status.alias("status"))


def challenge(hypotheses: DataFrame, experiments: DataFrame) -> DataFrame:
    """Per hypothesis: the facts a second reading needs and the confidence it leaves."""
    done = F.col("status") == "completed"
    tests = experiments.groupBy(F.col("hypothesis_id").alias("id")).agg(
        F.count_if(done & F.col("outcome").isin("weakens", "rejects")).alias("counter_tests"),
        F.count_if(done & (F.col("outcome") == "supports")).alias("supporting"),
        F.count(F.lit(1)).alias("experiments"),
    )
    facts = hypotheses.join(tests, "id", "left").na.fill(0, ["counter_tests", "supporting", "experiments"])
    live = F.col("status") != "rejected"
    against = F.col("counter_tests") > 0
    untested = (F.col("supporting") == 0) & live
    open_ends = (F.col("open_questions") > 0) & live
    cap = F.when(against | untested, "limited").when(open_ends, "moderate").otherwise("strong")
    return facts.select(
        "*", against.alias("against"), untested.alias("untested"), open_ends.alias("open_ends"), capped_level(F.col("level"), cap).alias("reviewed_level")
    )


def challenge_findings(hypotheses: DataFrame, experiments: DataFrame, evidence: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Contradictions, missing verification, open alternatives and assumptions: category, id, related, next_step."""
    reviewed = challenge(hypotheses, experiments)
    entry = lambda flag, category, related, step: F.when(
        flag,
        F.struct(F.lit(category).alias("category"), related.cast("long").alias("related"), F.lit(step).alias("next_step")),
    )
    rows = F.array_compact(
        F.array(
            entry(F.col("against"), "contradiction", F.col("counter_tests"), "reconcile evidence"),
            entry(F.col("untested"), "verification", F.col("experiments"), "run a declared test"),
            entry(F.col("open_ends"), "alternative", F.col("open_questions"), "answer open questions"),
        )
    )
    found = reviewed.select("id", F.inline(rows))
    flat = lambda df, category, step: df.select(
        "id", F.lit(category).alias("category"), F.lit(0).cast("long").alias("related"), F.lit(step).alias("next_step")
    )
    assumed = flat(evidence.filter(F.col("kind") == "assumption"), "assumption", "validate with stakeholders")
    repeated = flat(comparisons, "verification", "repeat on independent data")
    return found.unionByName(assumed).unionByName(repeated)


# --- gates -------------------------------------------------------------------------------------

def policy_checks(checks: DataFrame, measurements: DataFrame) -> DataFrame:
    """Declared checks against measurements by stage, metric and unit; unmeasured is inconclusive."""
    seen = measurements.select("stage", "metric", "unit", F.col("value").alias("measured"))
    joined = checks.join(seen, ["stage", "metric", "unit"], "left")
    meets = F.when(F.col("operator") == "at_least", F.col("measured") >= F.col("value")).otherwise(F.col("measured") <= F.col("value"))
    status = F.when(F.col("measured").isNull(), "inconclusive").when(meets, "passed").otherwise("failed")
    return joined.select("stage", "metric", "operator", "value", "unit", "measured", status.alias("status"))


def evaluate_gate(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.coalesce(F.bool_and(F.col("status") == "passed"), F.lit(True)).alias("passed"),
        F.count_if(F.col("status") != "passed").alias("not_passed"),
    )


def derive_gate(comparisons: DataFrame) -> DataFrame:
    """No-regression checks at the measured values, the first passing comparison per metric and unit.

    Input rows: position, status, metric, unit, value, accepted_metric, accepted_operator.
    """
    accepted = F.col("metric") == F.col("accepted_metric")
    usable = comparisons.filter(
        (F.col("status") == "passed") & F.col("value").isNotNull() & (accepted | F.col("metric").isin(*GATE_METRICS))
    )
    operator = F.when(accepted, F.col("accepted_operator")).when(F.col("unit").isin("cost", "loss"), "at_most").otherwise("at_least")
    picked = usable.groupBy("metric", "unit").agg(
        F.min_by(F.struct(operator.alias("operator"), F.col("value")), "position").alias("first")
    )
    return picked.select(F.lit("after").alias("stage"), "metric", "first.operator", "first.value", "unit")


def falsify(measurements: DataFrame, criteria: DataFrame) -> DataFrame:
    """Outcome of each hypothesis over its declared criteria (one, or two to four that must all hold).

    A criterion whose metric is absent, ambiguous or undefined leaves the whole prediction inconclusive.
    """
    scope = measurements.groupBy("scope", "metric", "unit").agg(F.count(F.lit(1)).alias("matches"), F.max("value").alias("measured"))
    joined = criteria.join(scope, ["scope", "metric", "unit"], "left")
    value = F.when(F.col("matches") == 1, F.col("measured"))
    met = F.when(F.col("operator") == "at_least", value >= F.col("value")).otherwise(value <= F.col("value"))
    judged = joined.select("hypothesis_id", met.alias("met"))
    counts = judged.groupBy("hypothesis_id").agg(
        F.count(F.lit(1)).alias("criteria"), F.count_if(F.col("met").isNull()).alias("unknown"), F.count_if("met").alias("met")
    )
    outcome = (
        F.when(F.col("unknown") > 0, "inconclusive")
        .when(F.col("met") == F.col("criteria"), "supports")
        .when(F.col("met") > 0, "weakens")
        .otherwise("rejects")
    )
    return counts.select("hypothesis_id", outcome.alias("outcome"), "met", "criteria")


EPSILON = 2.0**-52


def experiment_outcome(runs: DataFrame) -> DataFrame:
    """consistent / contradicts / inconclusive from before, after, minimum, expectation and controlled."""
    before, after, minimum = (F.col(c) for c in ("before", "after", "minimum"))
    delta = after - before
    slack = F.lit(EPSILON * 4) * F.greatest(F.lit(1.0), F.abs(before), F.abs(after), minimum)
    usable = (before >= 0) & (after >= 0) & (minimum > 0)
    signed = F.when(F.col("expectation") == "increase", delta).otherwise(-delta)
    outcome = (
        F.when(~F.coalesce(usable, F.lit(False)), "invalid")
        .when(~F.col("controlled"), "inconclusive")
        .when(F.abs(delta) + slack < minimum, "inconclusive")
        .when(signed > 0, "consistent")
        .otherwise("contradicts")
    )
    return runs.select("*", delta.alias("delta"), outcome.alias("outcome"))


# --- reports --------------------------------------------------------------------------------------

def reliability_profile(facts: DataFrame) -> DataFrame:
    """Six dimension scores and their weighted total, over the measured dimensions only.

    One-row input: accuracy, balanced_accuracy, minority_recall, ece, psi, suspicions, cost_before,
    cost_after (NULL where unmeasured). Weights are renormalised over what was measured; a failing
    minority class caps the total.
    """
    c = F.col
    bounded = lambda low, value: F.greatest(F.lit(float(low)), F.least(F.lit(100.0), F.round(value)))
    overall = F.when(c("balanced_accuracy").isNotNull(), c("accuracy") * 0.7 + c("balanced_accuracy") * 0.3).otherwise(c("accuracy"))
    share = F.try_divide(c("cost_before") - c("cost_after"), c("cost_before"))
    saved = F.when(share.isNotNull(), F.greatest(F.lit(0.0), share))
    scores = {
        "performance": F.round(overall * 100),
        "minority": F.when(c("minority_recall").isNotNull(), bounded(1, c("minority_recall") * 100)),
        "calibration": F.when(c("ece").isNotNull(), bounded(10, (1 - c("ece") * 2.5) * 100)),
        "drift": F.when(c("psi").isNotNull(), bounded(10, F.greatest(F.lit(0.0), 1 - c("psi") * 2) * 100)),
        "leakage": F.when(c("suspicions").isNotNull(), F.greatest(F.lit(20.0), F.lit(95.0) - c("suspicions") * 25)),
        "cost": F.when(saved.isNotNull(), bounded(0, saved * 82 + 18)),
    }
    wide = facts.select(*[v.cast("double").alias(k) for k, v in scores.items()])
    known = sum((F.when(c(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    mass = sum((F.coalesce(c(k) * w, F.lit(0.0)) for k, w in WEIGHTS.items()), F.lit(0.0))
    total = F.round(F.when(known > 0, mass / F.when(known > 0, known)))
    capped = F.when(c("minority") < MINORITY_FLOOR, F.least(F.lit(float(MINORITY_CAP)), total)).otherwise(total)
    row = lambda name, score, weight: F.struct(
        F.lit(name).alias("dimension"),
        score.alias("score"),
        weight.alias("weight"),
        F.when(score.isNull(), "not measured").otherwise("measured").alias("availability"),
    )
    rows = [row(k, c(k), F.lit(w)) for k, w in WEIGHTS.items()] + [row("total", capped, F.round(known, 10))]
    return wide.select(F.inline(F.array(*rows)))


def risk_band(score: Column) -> Column:
    return F.when(score < 60, "high").when(score < 80, "moderate").when(score.isNotNull(), "low")


def incident_record(tables: Mapping[str, DataFrame], comparisons: DataFrame, checks: DataFrame) -> DataFrame:
    """One summary row: record counts, hypotheses by fate, comparison and check results."""
    n = lambda df, cond=None: (df.filter(cond) if cond is not None else df).agg(F.count(F.lit(1))).scalar()
    h = tables["hypotheses"]
    spark = h.sparkSession
    return spark.range(1).select(
        n(tables["evidence"]).alias("evidence"),
        n(tables["results"], F.col("status") == "completed").alias("completed_results"),
        n(h, F.col("status") == "rejected").alias("rejected_hypotheses"),
        n(h, ~F.col("status").isin("confirmed", "rejected")).alias("unresolved_hypotheses"),
        n(comparisons, F.col("status") == "passed").alias("passed_comparisons"),
        n(checks).alias("checks"),
        n(checks, F.col("status") == "passed").alias("passed_checks"),
    )


def incident_hypotheses(hypotheses: DataFrame) -> DataFrame:
    """The hypotheses that an incident leaves rejected or unresolved: id, fate, level."""
    fate = F.when(F.col("status") == "rejected", "rejected").when(F.col("status") != "confirmed", "unresolved")
    return hypotheses.select("id", fate.alias("fate"), "level").filter(F.col("fate").isNotNull())


def audit_columns(profile: DataFrame) -> DataFrame:
    """The audit's section on every column with missing cells: column, missing, missing_share, type; largest share first."""
    share = F.col("missing") / (F.col("missing") + F.col("observed"))
    rows = profile.filter(F.col("missing") > 0).select("column", "missing", share.alias("missing_share"), "type")
    return rows.orderBy(F.col("missing_share").desc(), "column")


def decision_audit(
    missing: DataFrame, repeated: DataFrame, dominant: DataFrame, gaps: DataFrame | None = None
) -> DataFrame:
    """Rule, formula, evaluated value, limit and outcome of every triggered-or-not decision.

    ``missing`` has one ``missing`` total, ``repeated`` one ``repeated`` count, ``dominant`` one
    ``share``; ``gaps`` may add (rule, formula, value, limit) rows.
    """
    line = lambda df, rule, formula, value, limit: df.select(
        F.lit(rule).alias("rule"), F.lit(formula).alias("formula"), value.cast("double").alias("value"), F.lit(float(limit)).alias("limit")
    )
    rows = [
        line(missing, "Missing feature values", "missing cells > 0", F.col("missing"), 0).withColumn("hit", F.col("value") > 0),
        line(repeated, "Repeated observations", "repeated rows > 0", F.col("repeated"), 0).withColumn("hit", F.col("value") > 0),
        line(dominant, "Possible class imbalance", "dominant share >= 0.70", F.col("share"), 0.7).withColumn("hit", F.col("value") >= 0.7),
    ]
    if gaps is not None:
        rows.append(gaps.select("rule", "formula", "value", "limit").withColumn("hit", F.col("value") >= F.col("limit")))
    table = reduce(DataFrame.unionByName, rows)
    return table.select("rule", "formula", "value", "limit", F.when(F.col("hit"), "triggered").otherwise("not triggered").alias("outcome"))
