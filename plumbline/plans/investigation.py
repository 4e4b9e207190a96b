"""The record tables of one large investigation over the driver tables: every kind of record, their link tables, and planted faults.

Each table is one query that Spark and DuckDB both read. ``o`` has a row per order (k: order, c: customer, good: its tool
call succeeded, done: its experiment is complete), ``ln`` one per order line (i: line number).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import cut
from .frames import table

BASE = {
    "o": """SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS status, o_orderdate AS day, o_totalprice AS price, o_orderpriority <> '5-LOW' AS good,
              o_orderstatus = 'F' AND (o_orderpriority <> '5-LOW' OR o_orderkey % 35 = 7) AS done FROM {orders}""",
    "ln": """SELECT k, c, good, done, i, l_quantity FROM {o} JOIN
               (SELECT l_orderkey, l_linenumber AS i, min(l_quantity) AS l_quantity FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS l ON l_orderkey = k""",
}
TOOL = "CASE status WHEN 'F' THEN 'threshold_sweep' WHEN 'O' THEN 'run_drift_tests' ELSE 'run_counterfactual_test' END"
ROUTE = "CASE WHEN i = 4 AND (done OR k % 36 = 5) THEN 'experiment' WHEN i IN (1, 2, 5, 6) AND (good OR k % 34 = 5) THEN 'tool_result' ELSE 'source' END"
SHOWN = "CASE c % 5 WHEN 1 THEN 'supports' WHEN 2 THEN 'weakens' WHEN 3 THEN 'rejects' WHEN 4 THEN 'supports' ELSE 'context' END"
TABLES = {
    "sources": """SELECT 'source_' || c_custkey AS id, 'uploaded_file' AS kind FROM {customer}
        UNION ALL SELECT 'assumption_' || c_custkey, 'user_assumption' FROM {customer}""",
    "datasets": """SELECT 'dataset_' || k AS id, CASE WHEN k % 1000 = 7 THEN 'source_x' ELSE 'source_' END || c AS source_id, 10 + k % 90 AS row_count,
        CASE WHEN k % 4 <> 0 THEN '1' END AS positive_label FROM {o}""",
    "dataset_columns": """SELECT 'dataset_' || k AS dataset_id, 'y_true' AS name FROM {o} UNION ALL SELECT 'dataset_' || k, 'y_pred' FROM {o}
        UNION ALL SELECT 'dataset_' || k, 'site' FROM {o} WHERE k % 250 <> 8""",
    "calls": f"""SELECT 'call_' || k AS id, CASE WHEN k % 600 = 9 THEN 'investigation_2' ELSE 'investigation_1' END AS investigation_id, {TOOL} AS tool, 1 AS version, day AS requested_at,
        CASE WHEN k % 680 = 2 THEN 'dataset_x' ELSE 'dataset_' END || k AS dataset_id,
        CASE WHEN status = 'O' THEN CASE WHEN k % 690 = 4 THEN 'dataset_x' ELSE 'dataset_' END || k END AS comparison_dataset_id, CASE WHEN k % 2 = 0 THEN 'site' ELSE 'y_pred' END AS name,
        CASE WHEN k % 520 = 1 THEN '0' WHEN status = 'F' THEN '1' END AS positive_label, CASE WHEN status = 'P' THEN CASE WHEN k % 52 = 3 THEN 'hypothesis_x' ELSE 'hypothesis_' END || c END AS hypothesis_id,
        CASE WHEN status = 'F' AND k % 6 = 0 THEN 'evidence_' || k || CASE WHEN k % 540 = 6 THEN '_1' ELSE '_7' END END AS cost_evidence_id, CASE WHEN status = 'O' THEN 'ks' END AS method FROM {{o}}""",
    "call_thresholds": """SELECT 'call_' || k AS call_id, 0.25 AS threshold FROM {o} WHERE status = 'F' UNION ALL SELECT 'call_' || k, 0.5 FROM {o} WHERE status = 'F'""",
    "results": f"""SELECT 'result_' || k AS id, CASE WHEN k % 950 = 7 THEN 'call_x' ELSE 'call_' END || CASE WHEN k % 500 = 3 THEN k + 1 ELSE k END AS call_id, CASE WHEN k % 700 = 5 THEN 'check_calibration' ELSE {TOOL} END AS tool,
        CASE WHEN k % 710 = 6 THEN 2 ELSE 1 END AS version, CASE WHEN good THEN 'completed' ELSE 'failed' END AS status, day + INTERVAL 1 DAY * CASE WHEN k % 900 = 11 THEN -1 ELSE 1 END AS completed_at,
        CASE WHEN status = 'P' THEN 'hypothesis_' || CASE WHEN k % 110 = 8 THEN c + 1 ELSE c END END AS hypothesis_id, CASE WHEN status = 'O' THEN CASE WHEN k % 560 = 9 THEN 'psi' ELSE 'ks' END END AS method FROM {{o}}""",
    "result_datasets": """SELECT 'result_' || k AS result_id, 'dataset_' || CASE WHEN k % 650 = 4 THEN k + 1 ELSE k END AS dataset_id FROM {o}
        UNION ALL SELECT 'result_' || k, 'dataset_' || k FROM {o} WHERE status = 'O' AND k % 660 <> 5""",
    "result_thresholds": """SELECT 'result_' || k AS result_id, 0.25 AS threshold FROM {o} WHERE status = 'F' UNION ALL SELECT 'result_' || k, CASE WHEN k % 570 = 3 THEN 0.75 ELSE 0.5 END FROM {o}
        WHERE status = 'F' AND k % 580 <> 4""",
    "evidence": f"""SELECT 'evidence_' || k || '_' || i AS id, CASE WHEN i = 7 OR k % 410 = 3 THEN 'assumption' ELSE 'measurement' END AS kind, {ROUTE} AS route,
        CASE WHEN {ROUTE} = 'source' THEN CASE WHEN i = 7 OR k % 420 = 9 THEN 'assumption_' WHEN k % 430 = 6 THEN 'source_x' ELSE 'source_' END || c END AS source_id,
        CASE WHEN {ROUTE} = 'source' AND i <> 7 AND k % 350 <> 6 THEN CASE WHEN k % 440 = 8 THEN 'dataset_x' ELSE 'dataset_' END || k END AS dataset_id,
        CASE WHEN {ROUTE} = 'tool_result' THEN CASE WHEN k % 450 = 7 THEN 'result_x' ELSE 'result_' END || k END AS result_id,
        CASE WHEN {ROUTE} = 'experiment' THEN CASE WHEN k % 46 = 9 THEN 'experiment_x' ELSE 'experiment_' END || k END AS experiment_id,
        CASE WHEN {ROUTE} = 'source' AND i % 3 = 0 THEN 'site' END AS name, CASE WHEN {ROUTE} = 'source' AND i = 3 THEN i END AS first_row,
        CASE WHEN {ROUTE} = 'source' AND i = 3 THEN CASE WHEN k % 333 = 1 THEN 2 WHEN k % 444 = 2 THEN 1000 ELSE 3 + k % 5 END END AS last_row,
        CASE WHEN k % 400 = 2 THEN 0 ELSE 1 END AS measurements, CASE WHEN k % 390 = 9 OR i = 5 THEN 'precision' ELSE 'recall' END AS metric, 'ratio' AS unit FROM {{ln}}""",
    "result_evidence": f"""SELECT 'result_' || k AS result_id, 'evidence_' || k || '_' || i AS evidence_id FROM {{ln}} WHERE {ROUTE} = 'tool_result' AND k % 310 <> 4
        UNION ALL SELECT 'result_' || k, 'evidence_' || k || '_' || i FROM {{ln}} WHERE i = 3 AND k % 320 = 5
        UNION ALL SELECT 'result_' || k, 'evidence_x' || k FROM {{o}} WHERE k % 470 = 1
        UNION ALL SELECT 'result_' || k, 'evidence_' || k || '_' || i FROM {{ln}} WHERE NOT good AND i = 1 AND k % 30 = 5""",
    "hypotheses": """SELECT 'hypothesis_' || c_custkey AS id, CASE c_custkey % 5 WHEN 1 THEN 'supported' WHEN 2 THEN 'weakened' WHEN 3 THEN 'rejected' WHEN 4 THEN 'confirmed' ELSE 'proposed' END AS status FROM {customer}""",
    "hypothesis_evidence": f"""SELECT 'hypothesis_' || c AS hypothesis_id, 'evidence_' || k || '_' || i AS evidence_id, CASE WHEN c % 37 = 1 THEN 'context' ELSE {SHOWN} END AS relationship
        FROM {{ln}} WHERE i IN (1, 4) AND c % 43 <> 3
        UNION ALL SELECT 'hypothesis_' || c, 'evidence_' || k || '_' || i, 'context' FROM {{ln}} WHERE i = 1 AND c % 41 = 2
        UNION ALL SELECT 'hypothesis_' || c, 'evidence_x' || k, 'context' FROM {{o}} WHERE k % 480 = 4""",
    "experiments": f"""SELECT 'experiment_' || k AS id, CASE WHEN k % 770 = 3 THEN 'hypothesis_x' ELSE 'hypothesis_' END || c AS hypothesis_id, CASE WHEN done THEN 'completed' ELSE 'planned' END AS status,
        CASE WHEN done AND k % 80 <> 1 OR NOT done AND k % 810 = 2 THEN CASE WHEN c % 5 = 0 THEN 'inconclusive' ELSE {SHOWN} END END AS outcome FROM {{o}}""",
    "experiment_calls": """SELECT 'experiment_' || k AS experiment_id, CASE WHEN k % 340 = 6 THEN 'call_x' ELSE 'call_' END || k AS call_id FROM {o} WHERE k % 33 <> 5""",
    "experiment_evidence": """SELECT 'experiment_' || k AS experiment_id, 'evidence_' || k || '_' || i AS evidence_id FROM {ln} WHERE i = 4 AND done AND k % 31 <> 6
        UNION ALL SELECT 'experiment_' || k, 'evidence_' || k || '_' || i FROM {ln} WHERE i = 1 AND k % 490 = 7
        UNION ALL SELECT 'experiment_' || k, 'evidence_x' || k FROM {o} WHERE k % 510 = 8""",
    "repairs": """SELECT 'repair_' || k AS id, CASE WHEN k % 720 = 3 THEN 'hypothesis_x' ELSE 'hypothesis_' END || c AS hypothesis_id, CASE WHEN k % 730 = 9 THEN 'data_change' ELSE 'operating_policy' END AS kind,
        CASE WHEN k % 740 = 6 THEN 'dataset_x' ELSE 'dataset_' END || k AS dataset_id, 'recall >= 0.9 ratio' AS criterion, 'threshold 0.35' AS policy,
        CASE WHEN k % 9 = 0 THEN 'evidence_' || k || CASE WHEN k % 540 = 9 THEN '_1' ELSE '_7' END END AS cost_evidence_id FROM {o} WHERE k % 3 = 0""",
    "repair_evidence": """SELECT 'repair_' || k AS repair_id, 'evidence_' || k || '_' || i AS evidence_id FROM {ln} WHERE k % 3 = 0 AND i = 1 AND k % 530 <> 6
        UNION ALL SELECT 'repair_' || k, 'evidence_x' || k FROM {o} WHERE k % 3 = 0 AND k % 550 = 3""",
    "comparisons": """SELECT 'comparison_' || k AS id, CASE WHEN k % 750 = 6 THEN 'repair_x' ELSE 'repair_' END || k AS repair_id, CASE WHEN k % 760 = 9 THEN 'dataset_x' ELSE 'dataset_' END || k AS dataset_id,
        'recall' AS metric, 'ratio' AS unit, CASE WHEN k % 780 = 3 THEN 'recall >= 0.8 ratio' ELSE 'recall >= 0.9 ratio' END AS criterion, CASE WHEN k % 790 = 6 THEN 'threshold 0.4' ELSE 'threshold 0.35' END AS after_policy,
        '1' AS baseline_label, CASE WHEN k % 820 = 9 THEN '0' ELSE '1' END AS after_label, CASE WHEN k % 9 = 0 THEN '10/1' END AS baseline_costs,
        CASE WHEN k % 9 = 0 THEN CASE WHEN k % 90 = 9 THEN '5/1' ELSE '10/1' END END AS after_costs, CASE WHEN k % 9 = 0 THEN 'evidence_' || k || CASE WHEN k % 630 = 9 THEN '_2' ELSE '_7' END END AS cost_evidence_id
        FROM {o} WHERE k % 3 = 0""",
    "comparison_evidence": """SELECT 'comparison_' || k AS comparison_id, CASE i WHEN 1 THEN 'baseline' ELSE 'after' END AS side, 'evidence_' || k || '_' || i AS evidence_id FROM {ln} WHERE k % 3 = 0 AND i IN (1, 2)
        UNION ALL SELECT 'comparison_' || k, 'after', 'evidence_' || k || '_' || i FROM {ln} WHERE k % 3 = 0 AND (i = 1 AND k % 360 = 9 OR i = 5 AND k % 380 = 3 OR i = 4 AND k % 60 = 6)
        UNION ALL SELECT 'comparison_' || k, 'baseline', 'evidence_x' || k FROM {o} WHERE k % 3 = 0 AND k % 590 = 6""",
    "diagnoses": """SELECT 'diagnosis_' || c_custkey AS id, CASE WHEN c_custkey % 300 = 0 THEN 'investigation_2' ELSE 'investigation_1' END AS investigation_id, 'hypothesis_' || c_custkey AS primary_hypothesis_id
        FROM {customer} WHERE c_custkey % 50 = 0""",
    "diagnosis_links": """SELECT 'diagnosis_' || c_custkey AS diagnosis_id, CASE WHEN c_custkey % 350 = 0 THEN 'hypothesis_x' ELSE 'hypothesis_' END || c_custkey AS entity_id FROM {customer} WHERE c_custkey % 50 = 0
        UNION ALL SELECT 'diagnosis_' || c, CASE WHEN k % 44 = 1 THEN 'experiment_x' ELSE 'experiment_' END || k FROM {o} WHERE c % 50 = 0
        UNION ALL SELECT 'diagnosis_' || c, 'evidence_' || k || '_' || i FROM {ln} WHERE c % 50 = 0 AND i = 1""",
    "record_events": """SELECT 'event_' || CASE WHEN event_id % 500 = 1 THEN event_id - 1 ELSE event_id END AS id, CASE event_id % 4 WHEN 0 THEN 'dataset_registered' WHEN 1 THEN 'hypothesis_updated' WHEN 2 THEN 'tool_requested' ELSE 'experiment_completed' END AS kind,
        CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 100 = 8 THEN 'source_' ELSE 'dataset_' END WHEN 1 THEN 'hypothesis_' WHEN 2 THEN 'call_' ELSE CASE WHEN event_id % 100 = 7 THEN 'nothing_' ELSE 'experiment_' END END || user_id AS entity_id,
        ts AS moment FROM {events}""",
}
NAMES = {name: name for name in (*BASE, "orders", "customer", "lineitem", "events")}
INVESTIGATION_SQL = ",\n".join(f"{name} AS ({text.format(**NAMES)})" for name, text in (BASE | TABLES).items())
RECORDS = ("sources", "datasets", "calls", "results", "evidence", "hypotheses", "experiments", "repairs", "comparisons", "diagnoses", "record_events")


def investigation(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """All record and link tables."""
    given = {name: table(spark, d, name) for name in ("orders", "customer", "lineitem", "events")}
    given["o"] = spark.sql(BASE["o"], **given)
    given["ln"] = cut(spark.sql(BASE["ln"], **given), "lines")
    return {name: spark.sql(text, **given) for name, text in TABLES.items()}
