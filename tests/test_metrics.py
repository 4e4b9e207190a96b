import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import calibration as cal
from plumbline.operators import metrics as m
from plumbline.operators import slices as sl
from plumbline.operators import thresholds as th

SWEEP = [(1, 0.9), (0, 0.8), (1, 0.4), (0, 0.1)]


def test_undefined_is_null_with_reason(frame):
    rows = {r.metric: r for r in m.metric_rows(m.confusion(frame([(1, 0.1), (1, 0.2)]))).collect()}
    assert rows["precision"].value is None and rows["precision"].reason == "no predicted positives"
    assert rows["specificity"].status == "undefined"
    assert rows["recall"].value == 0.0
    equal = {r.metric: r for r in m.metric_rows(m.confusion(frame([(1, 0.9), (0, 0.1)]))).collect()}
    assert equal["minority_recall"].reason == "no unique minority class"


def test_auc_equals_pair_counting_over_all_small_cases(spark):
    cases = list(itertools.product((0.1, 0.5, 0.9), repeat=4))
    truths = ("1", "0", "1", "0")
    rows = [(c, truths[i], "0", p) for c, scores in enumerate(cases) for i, p in enumerate(scores)]
    ev = spark.createDataFrame(rows, "case int, y_true string, y_pred string, y_probability double")
    got = {r.case: r.value for r in m.roc_auc(ev, by=("case",)).collect()}
    for c, scores in enumerate(cases):
        pairs = [(scores[i], scores[j]) for i in (0, 2) for j in (1, 3)]
        want = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / 4
        assert got[c] == pytest.approx(want)


def test_average_precision_and_missing_scores(frame, values):
    ranked = frame([(0, 0.9), (0, 0.8), (1, 0.7)])
    assert values(m.ranking_metrics(ranked))["average_precision"] == pytest.approx(1 / 3)
    gap = m.roc_auc(frame([(1, 0.9), (0, None)])).first()
    assert gap.value is None and gap.reason == "missing probabilities"
    single = m.roc_auc(frame([(1, 0.9), (1, 0.2)])).first()
    assert single.reason == "one class only"


def test_accuracy_paradox(frame):
    paradox = frame([(0, 0.1)] * 90 + [(1, 0.1)] * 8 + [(1, 0.8)] * 2)
    row = m.accuracy_paradox(m.confusion(paradox)).first()
    assert row.outcome == "supports" and row.accuracy == pytest.approx(0.92)
    assert m.accuracy_paradox(m.confusion(frame([(1, 0.9), (0, 0.1)]))).first().outcome == "inconclusive"


def test_brier_and_ece(frame, values):
    ev = frame([(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)])
    assert values(cal.brier(ev))["brier_score"] == pytest.approx(0.085)
    bins = cal.calibration_equal_width(ev, 2)
    assert [(r.lower, r.upper, r.n) for r in bins.orderBy("bin").collect()] == [(0.0, 0.5, 2), (0.5, 1.0, 2)]
    assert values(cal.expected_calibration_error(bins))["expected_calibration_error"] == pytest.approx(0.25)
    assert cal.calibration_equal_width(frame([(0, 0.1), (1, None)]), 2).count() == 0


def test_equal_frequency_never_splits_ties(frame):
    spread = cal.calibration_equal_frequency(frame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)]), 2)
    assert sorted(r.n for r in spread.collect()) == [2, 2]
    tied = cal.calibration_equal_frequency(frame([(0, 0.5), (1, 0.5), (1, 0.5)]), 2)
    assert [r.n for r in tied.collect()] == [3]


def test_sweep_costs_and_ties(frame):
    costed = th.with_cost(th.threshold_sweep(frame(SWEEP), [0.5, 0.4, 0.9]), 10, 1)
    assert [r.total_cost for r in costed.orderBy("position").collect()] == [11.0, 1.0, 10.0]
    assert th.cost_select(costed).first().threshold == 0.4
    flat = th.with_cost(th.threshold_sweep(frame(SWEEP), [0.5, 0.6, 0.7]), 1, 1)
    assert th.cost_select(flat).first().threshold == 0.7


def test_sweep_equals_independent_confusion(frame):
    random.seed(3)
    ev = frame([(random.randint(0, 1), random.choice([0.0, 0.29, 0.3, 0.5, 1.0])) for _ in range(60)])
    grid = [0.0, 0.29, 0.3, 0.31, 1.0]
    for row in th.threshold_sweep(ev, grid).collect():
        one = m.confusion(th.apply_policy(ev, row.threshold)).first()
        assert (row.tp, row.fp, row.tn, row.fn) == (one.tp, one.fp, one.tn, one.fn)


def test_criterion_outcomes(frame):
    sweep = th.threshold_sweep(frame(SWEEP), [0.5, 0.4, 0.9])
    assert th.criterion_select(sweep, "recall", "at_least", 0.9).first().threshold == 0.4
    assert th.criterion_select(sweep, "accuracy", "at_least", 1.0).first().status == "no_eligible_candidate"
    empty = th.threshold_sweep(frame([(1, 0.2), (1, 0.4)]), [0.5])
    assert th.criterion_select(empty, "specificity", "at_least", 0.5).first().status == "insufficient_evidence"
    with pytest.raises(ValueError):
        th.criterion_select(sweep, "recall", "at_most", 0.5)


def test_reevaluation_and_baseline(frame):
    ev = frame(SWEEP)
    rows = {r.metric: r for r in th.repair_reevaluate(ev, 0.5, 0.4, "recall", 0.9, (10, 1)).collect()}
    assert rows["recall"].status == "passed" and rows["recall"].improvement == "improved"
    assert rows["total_cost"].direction == "decreased" and rows["accuracy"].status is None
    assert th.baseline_check(ev, 0.5).first().reproduces
    assert th.baseline_check(ev, 0.95).first().mismatches == 2


def test_slices_of_many_groups_and_bad_days(frame):
    pairs = [(1, 0.9), (0, 0.1), (1, 0.1), (0, 0.9)]
    days = ["2026-01-02T00:00:00Z", "2026-02-30T00:00:00Z", "", "2026-01-02T23:59:59.5Z"]
    ev = frame(pairs, group=["a", "a", "b", "b"], timestamp=days)
    acc = {r.slice_value: r.value for r in sl.slice_metrics(ev, ["group"]).filter("metric = 'accuracy'").collect()}
    assert acc == {"a": 1.0, "b": 0.0}
    day = sl.slice_coverage(ev, ["timestamp"]).first()
    assert (day.grouped, day.missing, day.invalid) == (2, 1, 1)
    many = frame([(1, 0.9)] * 101, group=[f"g{i}" for i in range(101)])
    assert sl.slice_coverage(many, ["group"]).first().groups == 101
    assert sl.slice_metrics(many, ["group"]).filter("metric = 'accuracy' AND n = 1").count() == 101


def test_row_order_does_not_matter(frame, values):
    random.seed(1)
    pairs = [(random.randint(0, 1), random.randint(0, 9) / 10) for _ in range(80)]
    a = frame(pairs)
    b = frame(random.sample(pairs, len(pairs))).orderBy(F.rand(7)).repartition(7)
    assert values(m.ranking_metrics(a)) == pytest.approx(values(m.ranking_metrics(b)))
