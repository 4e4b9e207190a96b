"""Classifier metrics, calibration, operating points and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.cells import predict
from ...operators import calibration as cal
from ...operators import metrics as m
from ...operators import running as rn
from ...operators import slices as sl
from ...operators import thresholds as th
from .. import frames as fr
from ..registry import query, sql
from ..tools import run_tool

EO, ED = fr.EVAL_ORDERS_SQL, fr.EVAL_DOCS_SQL

CONF = """
conf AS (SELECT count(*) FILTER (y_true = '1' AND y_pred = '1') AS tp,
                count(*) FILTER (y_true <> '1' AND y_pred = '1') AS fp,
                count(*) FILTER (y_true <> '1' AND y_pred <> '1') AS tn,
                count(*) FILTER (y_true = '1' AND y_pred <> '1') AS fn FROM {src})"""

METRICS_FROM = """
SELECT {keys} metric, CASE WHEN value IS NULL THEN 'undefined' ELSE 'measured' END AS status, value,
       CASE WHEN value IS NULL THEN why END AS reason, 'ratio' AS unit, n AS sample_size
FROM (
  SELECT {keys} tp + fp + tn + fn AS n,
    unnest([
     {{'m': 'accuracy', 'v': (tp + tn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 'w': 'no rows'}},
     {{'m': 'precision', 'v': tp::DOUBLE / nullif(tp + fp, 0), 'w': 'no predicted positives'}},
     {{'m': 'recall', 'v': tp::DOUBLE / nullif(tp + fn, 0), 'w': 'no actual positives'}},
     {{'m': 'specificity', 'v': tn::DOUBLE / nullif(tn + fp, 0), 'w': 'no actual negatives'}},
     {{'m': 'f1', 'v': (2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 'w': 'no actual or predicted positives'}},
     {{'m': 'positive_prevalence', 'v': (tp + fn)::DOUBLE / nullif(tp + fp + tn + fn, 0), 'w': 'no rows'}},
     {{'m': 'negative_prevalence', 'v': (tn + fp)::DOUBLE / nullif(tp + fp + tn + fn, 0), 'w': 'no rows'}},
     {{'m': 'balanced_accuracy', 'v': (tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2, 'w': 'one class only'}},
     {{'m': 'minority_recall', 'v': CASE WHEN tp + fn = 0 OR tn + fp = 0 THEN NULL
          WHEN tp + fn < tn + fp THEN tp::DOUBLE / (tp + fn) WHEN tp + fn > tn + fp THEN tn::DOUBLE / (tn + fp) END, 'w': 'no unique minority class'}}
    ]) AS s
  FROM {conf}) AS x, LATERAL (SELECT s.m AS metric, s.v AS value, s.w AS why) AS y
"""

RANKING = """
steps AS (SELECT {pk} y_probability AS score, count(*) FILTER (y_true = '1') AS pos, count(*) FILTER (y_true <> '1') AS neg
          FROM {src} GROUP BY ALL),
cums AS (SELECT *, sum(pos) OVER (PARTITION BY {pw} ORDER BY score DESC) AS cum_pos,
                   sum(neg) OVER (PARTITION BY {pw} ORDER BY score DESC) AS cum_neg FROM steps),
areas AS (SELECT {pk} sum(pos) AS positives, sum(neg) AS negatives, sum(pos + neg)::BIGINT AS n,
                 sum(neg * (2 * cum_pos - pos) / 2.0::DOUBLE) AS area,
                 sum(pos * cum_pos::DOUBLE / (cum_pos + cum_neg)) AS gain FROM cums {pg}),
ranking AS (SELECT {pk} unnest(['roc_auc', 'average_precision']) AS metric,
                   unnest([area / nullif(positives::DOUBLE * negatives, 0), gain / nullif(CASE WHEN negatives > 0 THEN positives END, 0)]) AS value,
                   n FROM areas)"""


def ranking(src: str, keys: str = "") -> str:
    return RANKING.format(src=src, pk=f"{keys}, " if keys else "", pw=keys or "1", pg="GROUP BY ALL" if keys else "")


RANK_ROWS = """SELECT {keys} metric, CASE WHEN value IS NULL THEN 'undefined' ELSE 'measured' END AS status, value,
 CASE WHEN value IS NULL THEN 'one class only' END AS reason, 'ratio' AS unit, n AS sample_size FROM ranking"""

ALL_METRICS = METRICS_FROM.format(keys="", conf="conf") + " UNION ALL " + RANK_ROWS.format(keys="")


@query("confusion", sql(EO + "," + CONF.format(src="eval_orders"), "SELECT * FROM conf"))
def _(spark, d):
    return m.confusion(fr.eval_orders(spark, d))


@query(
    "rate_metrics",
    sql(
        EO + "," + CONF.format(src="eval_orders"),
        f"SELECT * FROM ({METRICS_FROM.format(keys='', conf='conf')}) WHERE metric NOT IN ('balanced_accuracy', 'minority_recall')",
        ["value"],
    ),
)
def _(spark, d):
    return m.rate_metrics(m.confusion(fr.eval_orders(spark, d)))


@query(
    "balanced_minority",
    sql(
        ED + "," + CONF.format(src="eval_docs"),
        f"SELECT * FROM ({METRICS_FROM.format(keys='', conf='conf')}) WHERE metric IN ('balanced_accuracy', 'minority_recall')",
        ["value"],
    ),
)
def _(spark, d):
    return m.balanced_minority(m.confusion(fr.eval_docs(spark, d)))


@query("roc_auc", sql(EO + "," + ranking("eval_orders"), RANK_ROWS.format(keys="") + " WHERE metric = 'roc_auc'", ["value"]))
def _(spark, d):
    return m.roc_auc(fr.eval_orders(spark, d))


@query(
    "average_precision",
    sql(EO + "," + ranking("eval_orders"), RANK_ROWS.format(keys="") + " WHERE metric = 'average_precision'", ["value"]),
)
def _(spark, d):
    return m.average_precision(fr.eval_orders(spark, d))


@query(
    "compute_classification_metrics",
    sql(EO + "," + CONF.format(src="eval_orders") + "," + ranking("eval_orders"), ALL_METRICS, ["value"]),
)
def _(spark, d):
    return m.classification_metrics(fr.eval_orders(spark, d))


@query(
    "cum_counts",
    sql(EO + "," + ranking("eval_orders"), "SELECT * FROM cums", ["score"], ["cum_pos", "cum_neg"]),
)
def _(spark, d):
    return m.cum_counts(fr.eval_orders(spark, d))


@query(
    "accuracy_paradox",
    sql(
        ED + "," + CONF.format(src="eval_docs"),
        """SELECT *, CASE WHEN paradox_gap IS NULL THEN 'inconclusive' WHEN paradox_gap >= 10 THEN 'supports'
             WHEN greatest(balanced_gap, minority_gap) >= 10 THEN 'weakens' ELSE 'rejects' END AS outcome
           FROM (SELECT *, (accuracy - balanced_accuracy) * 100 AS balanced_gap, (accuracy - minority_recall) * 100 AS minority_gap,
                        least((accuracy - balanced_accuracy) * 100, (accuracy - minority_recall) * 100) AS paradox_gap
             FROM (SELECT *, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS accuracy,
                          (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2 AS balanced_accuracy,
                          CASE WHEN tp + fn < tn + fp THEN tp::DOUBLE / (tp + fn) ELSE tn::DOUBLE / (tn + fp) END AS minority_recall
                   FROM conf))""",
        ["accuracy", "balanced_accuracy", "minority_recall", "balanced_gap", "minority_gap", "paradox_gap"],
    ),
)
def _(spark, d):
    return m.accuracy_paradox(m.confusion(fr.eval_docs(spark, d)), 10.0)


BRIER = """SELECT 'brier_score' AS metric, 'measured' AS status,
 avg(power(y_probability - CASE WHEN y_true = '1' THEN 1.0 ELSE 0.0 END, 2)) AS value, NULL::VARCHAR AS reason,
 'ratio' AS unit, count(*) AS sample_size FROM eval_orders"""


@query("brier", sql(EO, BRIER, ["value"]))
def _(spark, d):
    return cal.brier(fr.eval_orders(spark, d))


def bins_sql(edges_cte: str, src: str = "eval_orders") -> str:
    """Rows of [edge, next edge) bins over an ``edges(i, lower, upper, is_last)`` CTE."""
    return f"""{edges_cte},
bins AS (
  SELECT e.i AS bin, e.lower, e.upper, count(v.row_id) AS n,
         greatest(e.lower, least(e.upper, avg(v.y_probability))) AS mean_probability,
         avg(CASE WHEN v.y_true = '1' THEN 1.0::DOUBLE WHEN v.y_true IS NOT NULL THEN 0.0::DOUBLE END) AS observed_rate
  FROM edges e LEFT JOIN {src} v ON v.y_probability >= e.lower AND (v.y_probability < e.upper OR e.is_last)
  GROUP BY e.i, e.lower, e.upper)"""


WIDTH_EDGES = """edges AS (SELECT i::BIGINT AS i, i / 10.0::DOUBLE AS lower, (i + 1) / 10.0::DOUBLE AS upper, i = 9 AS is_last
 FROM range(10) t(i))"""
FREQ_EDGES = """sorted AS (SELECT y_probability AS p, row_number() OVER (ORDER BY y_probability) AS r, count(*) OVER () AS n FROM eval_docs),
cuts AS (SELECT DISTINCT l.p + (r.p - l.p) / 2 AS cut
         FROM range(1, 8) t(i), sorted l, sorted r
         WHERE l.r = ceil(l.n * i / 8.0::DOUBLE) AND r.r = l.r + 1 AND l.p + (r.p - l.p) / 2 > l.p AND l.p + (r.p - l.p) / 2 < r.p),
edges AS (SELECT row_number() OVER (ORDER BY e) - 1 AS i, e AS lower, lead(e) OVER (ORDER BY e) AS upper, lead(e, 2) OVER (ORDER BY e) IS NULL AS is_last
          FROM (SELECT cut AS e FROM cuts WHERE cut > 0 UNION ALL SELECT 0.0 UNION ALL SELECT 1.0) QUALIFY lead(e) OVER (ORDER BY e) IS NOT NULL)"""
BIN_DOUBLES = ["lower", "upper", "mean_probability", "observed_rate"]


@query("calibration_equal_width", sql(EO + "," + bins_sql(WIDTH_EDGES), "SELECT * FROM bins", BIN_DOUBLES))
def _(spark, d):
    return cal.calibration_equal_width(fr.eval_orders(spark, d), 10)


@query(
    "calibration_equal_frequency",
    sql(ED + "," + bins_sql(FREQ_EDGES, "eval_docs"), "SELECT * FROM bins", BIN_DOUBLES),
)
def _(spark, d):
    return cal.calibration_equal_frequency(fr.eval_docs(spark, d), 8)


ECE = """SELECT 'expected_calibration_error' AS metric, 'measured' AS status,
 sum(n * abs(mean_probability - observed_rate)) / sum(n) AS value, NULL::VARCHAR AS reason, 'ratio' AS unit,
 sum(n)::BIGINT AS sample_size FROM bins"""


@query("check_calibration", sql(EO + "," + bins_sql(WIDTH_EDGES), f"{BRIER} UNION ALL {ECE}", ["value"]))
def _(spark, d):
    ev = fr.eval_orders(spark, d)
    return cal.brier(ev).unionByName(cal.expected_calibration_error(cal.calibration_equal_width(ev, 10)))


SWEEP = """
grid AS (SELECT i::BIGINT AS position, i / 100.0::DOUBLE AS threshold FROM range(101) t(i)),
scores AS (SELECT y_probability AS p, count(*) FILTER (y_true = '1') AS pos, count(*) FILTER (y_true <> '1') AS neg FROM eval_orders GROUP BY 1),
sweep AS (SELECT position, threshold, coalesce(sum(pos) FILTER (p >= threshold), 0)::BIGINT AS tp,
                 coalesce(sum(neg) FILTER (p >= threshold), 0)::BIGINT AS fp,
                 coalesce(sum(neg) FILTER (p < threshold), 0)::BIGINT AS tn,
                 coalesce(sum(pos) FILTER (p < threshold), 0)::BIGINT AS fn
          FROM grid CROSS JOIN scores GROUP BY 1, 2),
costed AS (SELECT *, fn * 10.0::DOUBLE + fp * 1.0::DOUBLE AS total_cost FROM sweep)"""


@query("threshold_sweep", sql(EO + "," + SWEEP, "SELECT * FROM costed", ["threshold", "total_cost"]))
def _(spark, d):
    return th.with_cost(th.threshold_sweep(fr.eval_orders(spark, d)), 10, 1)


@query(
    "sweep_metrics",
    sql(
        EO + "," + SWEEP,
        METRICS_FROM.format(keys="position, threshold,", conf="sweep"),
        ["threshold", "value"],
    ),
)
def _(spark, d):
    return th.sweep_metrics(th.threshold_sweep(fr.eval_orders(spark, d)))


@query(
    "cost_select",
    sql(EO + "," + SWEEP, "SELECT threshold, total_cost FROM costed ORDER BY total_cost, threshold DESC LIMIT 1", ["threshold", "total_cost"]),
)
def _(spark, d):
    return th.cost_select(th.with_cost(th.threshold_sweep(fr.eval_orders(spark, d)), 10, 1))


@query(
    "criterion_select",
    sql(
        EO + "," + SWEEP,
        """SELECT coalesce(max(status), 'no_eligible_candidate') AS status, max(threshold) AS threshold, max(score) AS score FROM (
             SELECT 'candidate' AS status, threshold, 2.0 * tp / (2 * tp + fp + fn) AS score FROM sweep
             WHERE 2.0 * tp / (2 * tp + fp + fn) >= 0.5 ORDER BY score DESC, threshold DESC LIMIT 1)""",
        ["threshold", "score"],
    ),
)
def _(spark, d):
    return th.criterion_select(th.threshold_sweep(fr.eval_orders(spark, d)), "f1", "at_least", 0.5)


PAIRS = """
policy AS (SELECT stage, t, count(*) FILTER (y_true = '1' AND y_probability >= t) AS tp, count(*) FILTER (y_true <> '1' AND y_probability >= t) AS fp,
                  count(*) FILTER (y_true <> '1' AND y_probability < t) AS tn, count(*) FILTER (y_true = '1' AND y_probability < t) AS fn
           FROM eval_orders, (VALUES ('baseline', 0.5), ('after', 0.35)) v(stage, t) GROUP BY 1, 2),
longm AS (SELECT stage, metric, value FROM (""" + METRICS_FROM.format(keys="stage,", conf="policy") + """)
          UNION ALL SELECT stage, 'total_cost', fn * 10.0::DOUBLE + fp FROM policy),
pairs AS (SELECT b.metric, b.value AS before, a.value AS after,
            CASE WHEN b.value IS NULL OR a.value IS NULL THEN 'undefined' WHEN a.value > b.value THEN 'increased'
                 WHEN a.value < b.value THEN 'decreased' ELSE 'unchanged' END AS direction
          FROM longm b JOIN longm a ON a.metric = b.metric AND b.stage = 'baseline' AND a.stage = 'after')"""


@query(
    "repair_reevaluate",
    sql(
        EO + "," + PAIRS,
        """SELECT *, CASE WHEN metric = 'recall' THEN CASE WHEN after >= 0.9 THEN 'passed' ELSE 'failed' END END AS status,
             CASE WHEN metric = 'recall' THEN CASE WHEN after = before THEN 'unchanged' WHEN after > before THEN 'improved' ELSE 'worsened' END END AS improvement
           FROM pairs""",
        ["before", "after"],
    ),
)
def _(spark, d):
    return th.repair_reevaluate(fr.eval_orders(spark, d), 0.5, 0.35, "recall", 0.9, (10, 1))


def _stages(spark, d):
    rows = th.policy_measurements(fr.eval_orders(spark, d), 0.5, 0.35, (10, 1))
    return rows.filter(F.col("stage") == "baseline"), rows.filter(F.col("stage") == "after")


@query("j_before_after", sql(EO + "," + PAIRS, "SELECT * FROM pairs", ["before", "after"]))
def _(spark, d):
    return th.before_after(*_stages(spark, d))


@query("metric_tradeoffs", sql(EO + "," + PAIRS, "SELECT metric, direction FROM pairs"))
def _(spark, d):
    return th.before_after(*_stages(spark, d)).select("metric", "direction")


@query(
    "union_thresholds",
    sql(
        EO,
        """SELECT g.threshold, count(v.row_id) AS n_at_or_above
           FROM (SELECT i / 100.0::DOUBLE AS threshold FROM range(101) t(i) UNION SELECT 0.505) g
           LEFT JOIN eval_orders v ON v.y_probability >= g.threshold GROUP BY 1""",
        ["threshold"],
    ),
)
def _(spark, d):
    points = sorted(r.threshold for r in th.union_thresholds(spark, th.GRID, 0.505).collect())
    sweep = th.threshold_sweep(fr.eval_orders(spark, d), points)
    return sweep.select("threshold", (F.col("tp") + F.col("fp")).alias("n_at_or_above"))


@query(
    "p_threshold_predict",
    sql(EO, "SELECT row_id, y_probability, CASE WHEN y_probability >= 0.35 THEN '1' ELSE '0' END AS y_pred FROM eval_orders", ["y_probability"]),
)
def _(spark, d):
    ev = fr.eval_orders(spark, d)
    return ev.select("row_id", "y_probability", predict(F.col("y_probability"), 0.35).alias("y_pred"))


@query(
    "p_baseline_reproduces",
    sql(
        EO,
        """SELECT count(*) FILTER (y_pred <> CASE WHEN y_probability >= 0.4 THEN '1' ELSE '0' END) = 0 AS reproduces,
             count(*) FILTER (y_pred <> CASE WHEN y_probability >= 0.4 THEN '1' ELSE '0' END) AS mismatches, count(*) AS n FROM eval_orders""",
    ),
)
def _(spark, d):
    return th.baseline_check(fr.eval_orders(spark, d), 0.4)


SLICES = """
cells AS (
  SELECT y_true, y_pred, y_probability, 'site' AS "column", site AS raw, site AS v FROM eval_orders UNION ALL
  SELECT y_true, y_pred, y_probability, 'environment', environment, CASE WHEN environment <> 'n/a' THEN environment END FROM eval_orders UNION ALL
  SELECT y_true, y_pred, y_probability, 'device', device, device FROM eval_orders UNION ALL
  SELECT y_true, y_pred, y_probability, 'timestamp', "timestamp", CASE WHEN "timestamp" NOT LIKE '2026-02-30%' THEN left("timestamp", 10) END FROM eval_orders),
coverage AS (SELECT "column", count(v) AS grouped, count(*) FILTER (raw = 'n/a') AS missing,
                    count(*) FILTER (v IS NULL AND raw <> 'n/a') AS invalid, count(DISTINCT v) AS groups
             FROM cells GROUP BY 1),
sliced AS (SELECT "column", v AS slice_value, y_true, y_pred, y_probability FROM cells
           WHERE v IS NOT NULL),
sconf AS (SELECT "column", slice_value, count(*) FILTER (y_true = '1' AND y_pred = '1') AS tp, count(*) FILTER (y_true <> '1' AND y_pred = '1') AS fp,
                count(*) FILTER (y_true <> '1' AND y_pred <> '1') AS tn, count(*) FILTER (y_true = '1' AND y_pred <> '1') AS fn FROM sliced GROUP BY ALL),
""" + ranking("sliced", '"column", slice_value') + """,
smetrics AS (SELECT "column", slice_value, metric, status, value, reason, sample_size AS n, sample_size < 30 AS small
  FROM (""" + METRICS_FROM.format(keys='"column", slice_value,', conf="sconf") + " UNION ALL " + RANK_ROWS.format(keys='"column", slice_value,') + "))"

SLICE_COLS = ["site", "environment", "device", "timestamp"]


@query("slice_coverage", sql(EO + "," + SLICES, "SELECT * FROM coverage"))
def _(spark, d):
    return sl.slice_coverage(fr.eval_orders(spark, d), SLICE_COLS)


@query("slice_metrics", sql(EO + "," + SLICES, "SELECT * FROM smetrics", ["value"]))
def _(spark, d):
    return sl.slice_metrics(fr.eval_orders(spark, d), SLICE_COLS)


OVERALL = """
conf AS (SELECT count(*) FILTER (y_true = '1' AND y_pred = '1') AS tp, count(*) FILTER (y_true <> '1' AND y_pred = '1') AS fp,
 count(*) FILTER (y_true <> '1' AND y_pred <> '1') AS tn, count(*) FILTER (y_true = '1' AND y_pred <> '1') AS fn FROM eval_orders),
overall AS (""" + METRICS_FROM.format(keys="", conf="conf") + ")"


@query(
    "j_slice_vs_overall",
    sql(
        EO + "," + SLICES + "," + OVERALL,
        """SELECT s."column", s.slice_value, s.metric, s.value, o.value AS overall,
             CASE WHEN s.metric <> 'minority_recall' THEN (s.value - o.value) * 100 END AS delta_pp
           FROM smetrics s JOIN overall o ON s.metric = o.metric""",
        ["value", "overall", "delta_pp"],
    ),
)
def _(spark, d):
    ev = fr.eval_orders(spark, d)
    overall = m.metric_rows(m.confusion(ev))
    return sl.slice_vs_overall(sl.slice_metrics(ev, SLICE_COLS), overall)


STATS = """
ranked AS (SELECT y_probability AS value, row_number() OVER (ORDER BY y_probability) AS rank, count(*) OVER () AS size FROM eval_orders)"""


@query(
    "order_stat",
    sql(EO + "," + STATS, "SELECT rank, value, size FROM ranked WHERE rank IN (1, ceil(size / 4.0)::BIGINT, ceil(size / 2.0)::BIGINT, size)", ["value"]),
)
def _(spark, d):
    counts = rn.value_counts(fr.eval_orders(spark, d), "y_probability")
    n = F.col("all_upto")
    ranks = F.array(F.lit(1).cast("long"), F.ceil(n / 4).cast("long"), F.ceil(n / 2).cast("long"), n)
    return rn.order_statistics(counts, "y_probability", ranks)


@query(
    "slice_evaluation",
    sql(
        EO + "," + SLICES + "," + OVERALL,
        """SELECT s."column", s.slice_value, s.metric, s.value, CASE WHEN s.metric <> 'minority_recall' THEN (s.value - o.value) * 100 END AS delta_pp, c.grouped
           FROM smetrics s JOIN (SELECT metric, value FROM overall UNION ALL SELECT metric, value FROM (
             WITH """ + ranking("eval_orders").strip() + """ SELECT metric, value FROM ranking)) o ON s.metric = o.metric JOIN coverage c ON c."column" = s."column" WHERE s."column" = 'site'""",
        ["value", "delta_pp"],
    ),
)
def _(spark, d):
    report = run_tool("slice_evaluation", fr.eval_orders(spark, d), columns=["site"])
    grouped = report["coverage"].select("column", "grouped")
    return report["deltas"].drop("overall").join(F.broadcast(grouped), "column")


@query(
    "run_counterfactual_test",
    sql(
        EO + "," + CONF.format(src="eval_orders"),
        """SELECT tp, fp, tn, fn, CASE WHEN ba_gap >= 5 AND mr_gap >= 5 THEN 'supports' WHEN ba_gap >= 5 OR mr_gap >= 5 THEN 'weakens' ELSE 'rejects' END AS outcome
           FROM (SELECT *, 100 * ((tp + tn)::DOUBLE / (tp + fp + tn + fn) - (tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2) AS ba_gap,
                        100 * ((tp + tn)::DOUBLE / (tp + fp + tn + fn) - CASE WHEN tp + fn < tn + fp THEN tp::DOUBLE / (tp + fn) ELSE tn::DOUBLE / (tn + fp) END) AS mr_gap FROM conf)""",
    ),
)
def _(spark, d):
    report = run_tool("run_counterfactual_test", fr.eval_orders(spark, d), minimum_gap=5.0)
    return report["outcome"].select("tp", "fp", "tn", "fn", "outcome")
