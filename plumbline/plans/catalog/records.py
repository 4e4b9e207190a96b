"""Ingestion, sinks, provenance records, gates and reports."""

from __future__ import annotations



from pyspark.sql import functions as F

from ...operators import integrity as integ
from ...operators import metrics as m
from ...operators import quality as q
from ...operators import records as rec
from ...operators import thresholds as th
from ...session import shared_dir
from ...sources import evaluation as ev
from ...sources import predictions as pr
from ...sources import sinks
from .. import frames as fr
from .. import investigation as inv
from ..registry import query, sql
from .metrics import CONF, METRICS_FROM, PAIRS
from .quality import NUM, gone

EO, EN, RE, RP, ED = fr.EVAL_ORDERS_SQL, fr.ENTITIES_SQL, fr.RAW_EVAL_SQL, fr.RAW_PREDS_SQL, fr.EVAL_DOCS_SQL

# --- ingestion --------------------------------------------------------------------------------

ISSUES = f"""
issues AS (
  SELECT row_no AS "row", 'y_true' AS "column", CASE WHEN {gone('y_true')} THEN 'missing_value' ELSE 'label' END AS code FROM raw_eval WHERE {gone('y_true')} OR trim(y_true) NOT IN ('0', '1')
  UNION ALL SELECT row_no, 'y_probability', CASE WHEN {gone('y_probability')} THEN 'missing_value' ELSE 'probability' END FROM raw_eval
  WHERE {gone('y_probability')} OR NOT coalesce({NUM.format('trim(y_probability)')} BETWEEN 0 AND 1, false))"""


MESSAGE_CASES = " ".join(f"WHEN \"column\" = '{c}' AND code = '{k}' THEN '{text}'" for (c, k), text in ev.MESSAGES.items())


@query("ingest_eval", sql(EO + "," + RE + "," + ISSUES, f"""SELECT "row", "column", code, CASE {MESSAGE_CASES} END AS message, 0::BIGINT AS accepted FROM issues"""))
def _(spark, d):
    rows, issues = ev.ingest(fr.raw_eval(spark, d), "row_no")
    return issues.select("*", rows.agg(F.count(F.lit(1))).scalar().alias("accepted"))


@query("ingest_eval_clean", sql(EO, "SELECT row_id, y_true, y_pred, y_probability, site FROM eval_orders", ["y_probability"]))
def _(spark, d):
    rows, _ = ev.ingest(fr.raw_eval(spark, d, clean=True), "row_no")
    return rows.select("row_id", "y_true", "y_pred", "y_probability", F.col("attributes")["site"].alias("site"))


@query(
    "ingest_encoding_check",
    sql(
        "",
        """SELECT doc_id, true AS valid_utf8, doc_id % 5 = 1 AS has_nul, doc_id % 5 = 2 OR contains(text, chr(65533)) AS has_replacement, doc_id % 5 = 3 AS has_bom,
             doc_id % 5 <> 1 AND NOT (doc_id % 5 = 2 OR contains(text, chr(65533))) AS readable FROM documents""",
    ),
)
def _(spark, d):
    k = F.col("doc_id") % 5
    text = F.when(k == 1, F.concat(F.lit("a\u0000"), "text")).when(k == 2, F.concat("text", F.lit("�"))).when(k == 3, F.concat(F.lit("﻿"), "text")).otherwise(F.col("text"))
    docs = fr.table(spark, d, "documents").select("doc_id", text.alias("text"))
    return ev.encoding_check(docs, "doc_id", "text").drop("text")


@query(
    "ingest_csv_shape",
    sql(
        "",
        """SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 7 IN (1, 2) THEN 'ragged' ELSE 'ok' END AS state,
             CASE WHEN o_orderkey % 7 NOT IN (1, 2) THEN o_orderpriority || ', "x"' END AS note FROM orders WHERE o_orderkey % 7 <> 3""",
    ),
)
def _(spark, d):
    k = F.col("o_orderkey") % 7
    quoted = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', ""x"""'))
    base = F.concat(F.col("o_custkey").cast("string"), F.lit(", "), F.col("o_orderstatus"), F.lit(","), quoted)
    line = F.when(k == 1, F.concat(base, F.lit(",extra"))).when(k == 2, F.lit("only,two")).when(k == 3, F.lit("   ")).otherwise(base)
    lines = fr.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_no"), line.alias("line"))
    rows, bad = ev.parse_csv_lines(lines, "line", ["cust", "status", "note"], ["row_no"])
    ok = rows.select("row_no", F.lit("ok").alias("state"), "note")
    return ok.unionByName(bad.select("row_no", F.lit("ragged").alias("state"), F.lit(None).cast("string").alias("note")))


PREDS = """
pp AS (SELECT row_no, trim(filename) AS id, CASE WHEN lower(label) IN ('1', 'true', 'positive') THEN 1 ELSE 0 END::BIGINT AS y_true, CASE WHEN lower(pred) IN ('1', 'true', 'positive') THEN 1 ELSE 0 END::BIGINT AS y_pred,
         TRY_CAST(nullif(regexp_extract(score, '^([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1), '') AS DOUBLE) AS num,
         CASE WHEN lower(subset) LIKE '%train%' THEN 'train' WHEN lower(subset) LIKE '%val%' THEN 'val' WHEN lower(subset) LIKE '%prod%' THEN 'production' WHEN lower(subset) LIKE '%test%' THEN 'test' ELSE 'unassigned' END AS split,
         hospital AS site, nullif(trim(has_ruler), '') AS has_ruler FROM raw_preds WHERE trim(filename) <> ''),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no) AS k FROM pp) WHERE k = 1),
prows AS (SELECT row_no AS "row", id, y_true, y_pred, least(1, greatest(0, coalesce(num, 0.5))) AS y_probability, split, site, has_ruler FROM firsts),
pissues AS (SELECT row_no AS "row", id, 'probability' AS code FROM firsts WHERE num IS NULL OR num < 0 OR num > 1
            UNION ALL SELECT row_no, id, 'duplicate_id' FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no) AS k FROM pp) WHERE k > 1)"""


@query("ingest_predictions", sql(RP + "," + PREDS, "SELECT * FROM prows", ["y_probability"]))
def _(spark, d):
    rows, _ = pr.ingest_predictions(fr.raw_preds(spark, d), "row_no")
    return rows.select("row", "id", "y_true", "y_pred", "y_probability", "split", "site", F.col("metadata")["has_ruler"].alias("has_ruler"))


@query(
    "ingest_predictions_audit",
    sql(
        RP + "," + PREDS,
        """SELECT (SELECT count(*) FROM raw_preds) AS total_rows, count(*) AS valid_rows, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val,
             count(*) FILTER (split = 'production') AS production, count(*) FILTER (split = 'test') AS test, count(*) FILTER (split = 'unassigned') AS unassigned,
             (SELECT count(*) FROM pissues WHERE code = 'probability') AS bad_probabilities, (SELECT count(*) FROM pissues WHERE code = 'duplicate_id') AS duplicate_ids FROM prows""",
    ),
)
def _(spark, d):
    raw = fr.raw_preds(spark, d)
    return pr.ingestion_audit(raw, *pr.ingest_predictions(raw, "row_no"))


FILES = """
files AS (SELECT l_orderkey * 10 + l_linenumber AS position, CASE WHEN l_linenumber = 7 THEN 'notes/img_' || l_orderkey || '.txt' WHEN l_linenumber = 6 THEN 'other_' || l_orderkey || '.jpg'
            ELSE 'scans/IMG_' || l_orderkey || '.' || CASE WHEN l_linenumber % 2 = 0 THEN 'PNG' ELSE 'jpg' END END AS name FROM lineitem),
stems AS (SELECT lower(regexp_extract(name, '([^/]*)\\.[^.]*$', 1)) AS stem, arg_max(name, position) AS name FROM (SELECT name, max(position) AS position FROM files WHERE name NOT LIKE '%.txt' GROUP BY 1) GROUP BY 1)"""


@query(
    "match_files",
    sql(
        RP + "," + PREDS + "," + FILES,
        """SELECT 'matched' AS kind, p.id, s.name AS file FROM prows p JOIN stems s ON lower(regexp_replace(p.id, '\\.[^.]*$', '')) = s.stem
           UNION ALL SELECT 'missing', p.id, NULL FROM prows p WHERE lower(regexp_replace(p.id, '\\.[^.]*$', '')) NOT IN (SELECT stem FROM stems)
           UNION ALL SELECT 'unmatched', NULL, name FROM stems WHERE stem NOT IN (SELECT lower(id) FROM prows)""",
    ),
)
def _(spark, d):
    rows, _ = pr.ingest_predictions(fr.raw_preds(spark, d), "row_no")
    n, o = F.col("l_linenumber"), F.col("l_orderkey").cast("string")
    name = (
        F.when(n == 7, F.concat(F.lit("notes/img_"), o, F.lit(".txt")))
        .when(n == 6, F.concat(F.lit("other_"), o, F.lit(".jpg")))
        .otherwise(F.concat(F.lit("scans/IMG_"), o, F.lit("."), F.when(n % 2 == 0, "PNG").otherwise("jpg")))
    )
    files = fr.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + n).alias("position"), name.alias("name")).distinct()
    matched, missing, unmatched = pr.match_files(rows, files)
    none = F.lit(None).cast("string")
    return (
        matched.select(F.lit("matched").alias("kind"), "id", "file")
        .unionByName(missing.select(F.lit("missing").alias("kind"), "id", none.alias("file")))
        .unionByName(unmatched.select(F.lit("unmatched").alias("kind"), none.alias("id"), F.col("name").alias("file")))
    )


# --- sinks --------------------------------------------------------------------------------------

RECORDS = ("sources", "datasets", "calls", "results", "evidence", "hypotheses", "experiments", "comparisons", "record_events")


@query(
    "write_records",
    sql(EN, " UNION ALL ".join(f"""SELECT '{t}' AS entity, count(*) AS "rows", 0::BIGINT AS changed, 1::BIGINT AS versions FROM {t}""" for t in RECORDS)),
)
def _(spark, d):
    tables = fr.entities(spark, d)
    return sinks.round_trip({k: tables[k] for k in RECORDS}, shared_dir(spark, "records"))


@query("export_normalized", sql(ED, "SELECT y_true, y_pred, count(*) AS n, sum(y_probability) AS p FROM eval_docs GROUP BY 1, 2", ["p"]))
def _(spark, d):
    folder = shared_dir(spark, "normalized")
    sinks.export_normalized(fr.eval_docs(spark, d), folder)
    back = sinks.read_normalized(spark, folder)
    return back.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"), F.sum("y_probability").alias("p"))


AUDIT_SQL = f"""
SELECT 'Missing feature values' AS rule, 'missing cells > 0' AS formula, count(*) FILTER ({gone('amount')})::DOUBLE AS value, 0.0::DOUBLE AS "limit", CASE WHEN count(*) FILTER ({gone('amount')}) > 0 THEN 'triggered' ELSE 'not triggered' END AS outcome FROM raw_cells
UNION ALL SELECT 'Repeated observations', 'repeated rows > 0', (count(*) - count(DISTINCT text || '|' || lang))::DOUBLE, 0, CASE WHEN count(*) > count(DISTINCT text || '|' || lang) THEN 'triggered' ELSE 'not triggered' END FROM documents
UNION ALL SELECT 'Possible class imbalance', 'dominant share >= 0.70', s, 0.7, CASE WHEN s >= 0.7 THEN 'triggered' ELSE 'not triggered' END FROM (SELECT max(n) / sum(n)::DOUBLE AS s FROM (SELECT count(*) AS n FROM labels GROUP BY quality))"""


@query("export_audit", sql(fr.CELLS_SQL, AUDIT_SQL, ["value", '"limit"']))
def _(spark, d):
    cells = q.profile_counts(q.cell_counts(fr.raw_cells(spark, d), ["amount", "code", "status"]))
    missing = cells.agg(F.sum("missing").alias("missing"))
    repeated = q.repeated_rows(fr.table(spark, d, "documents"), ["text", "lang"])
    dominant = q.class_balance(fr.table(spark, d, "labels"), "quality").agg(F.max("share").alias("share"))
    audit = rec.decision_audit(missing, repeated, dominant)
    folder = shared_dir(spark, "audit")
    sinks.export_audit(audit, folder)
    return spark.read.schema(audit.schema).json(folder)


# --- records --------------------------------------------------------------------------------------

KINDS = " ".join(f"WHEN '{kind}' THEN '{prefix}'" for kind, prefix in integ.EVENT_PREFIXES.items())
EVERY = " UNION ALL ".join(f"SELECT id FROM {name}" for name in inv.RECORDS)
INTEGRITY = f"""
WITH every AS ({EVERY}), known AS (SELECT DISTINCT id FROM every),
scope AS (
  SELECT DISTINCT id AS evidence_id, dataset_id FROM evidence WHERE route = 'source' AND dataset_id IS NOT NULL
  UNION SELECT e.id, d.dataset_id FROM evidence e JOIN result_datasets d ON e.result_id = d.result_id WHERE e.route = 'tool_result'
  UNION SELECT e.id, d.dataset_id FROM evidence e JOIN experiment_calls x ON e.experiment_id = x.experiment_id JOIN results r ON r.call_id = x.call_id JOIN result_datasets d ON d.result_id = r.id WHERE e.route = 'experiment'
),
asked AS (SELECT id AS call_id, dataset_id FROM calls UNION ALL SELECT id, comparison_dataset_id FROM calls WHERE comparison_dataset_id IS NOT NULL),
held AS (
  SELECT l.comparison_id, e.kind = 'measurement' AND e.measurements > 0 AND e.metric = c.metric AND e.unit = c.unit AND EXISTS (SELECT 1 FROM scope s WHERE s.evidence_id = e.id)
         AND NOT EXISTS (SELECT 1 FROM scope s WHERE s.evidence_id = e.id AND s.dataset_id <> c.dataset_id) AS fits
  FROM comparison_evidence l JOIN comparisons c ON c.id = l.comparison_id JOIN evidence e ON e.id = l.evidence_id
)
SELECT 'any' AS entity, id, 'duplicate id' AS rule FROM every GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'datasets', id, 'unknown source' FROM datasets WHERE source_id NOT IN (SELECT id FROM sources)
UNION ALL SELECT 'evidence', id, 'measurement without value' FROM evidence WHERE kind = 'measurement' AND measurements = 0
UNION ALL SELECT 'evidence', id, 'assumption without assumption source' FROM evidence WHERE kind = 'assumption' AND (route <> 'source' OR source_id NOT IN (SELECT id FROM sources WHERE kind = 'user_assumption'))
UNION ALL SELECT 'evidence', id, 'assumption source with measurement' FROM evidence WHERE kind <> 'assumption' AND route = 'source' AND source_id IN (SELECT id FROM sources WHERE kind = 'user_assumption')
UNION ALL SELECT 'evidence', id, 'unknown source' FROM evidence WHERE route = 'source' AND source_id NOT IN (SELECT id FROM sources)
UNION ALL SELECT 'evidence', id, 'unknown dataset' FROM evidence WHERE dataset_id IS NOT NULL AND dataset_id NOT IN (SELECT id FROM datasets)
UNION ALL SELECT 'evidence', e.id, 'dataset of another source' FROM evidence e JOIN datasets d ON d.id = e.dataset_id WHERE d.source_id <> e.source_id
UNION ALL SELECT 'evidence', e.id, 'unknown provenance column' FROM evidence e JOIN datasets d ON d.id = e.dataset_id WHERE e.name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dataset_columns c WHERE c.dataset_id = d.id AND c.name = e.name)
UNION ALL SELECT 'evidence', e.id, 'rows outside dataset' FROM evidence e LEFT JOIN datasets d ON d.id = e.dataset_id WHERE first_row < 1 OR first_row > last_row OR last_row > row_count
UNION ALL SELECT 'evidence', id, 'rows without dataset' FROM evidence WHERE dataset_id IS NULL AND (first_row IS NOT NULL OR name IS NOT NULL)
UNION ALL SELECT 'evidence', id, 'unknown result' FROM evidence WHERE route = 'tool_result' AND result_id NOT IN (SELECT id FROM results)
UNION ALL SELECT 'evidence', id, 'result not completed' FROM evidence WHERE result_id IN (SELECT id FROM results WHERE status <> 'completed')
UNION ALL SELECT 'evidence', id, 'unknown experiment' FROM evidence WHERE route = 'experiment' AND experiment_id NOT IN (SELECT id FROM experiments)
UNION ALL SELECT 'evidence', id, 'experiment not completed' FROM evidence WHERE experiment_id IN (SELECT id FROM experiments WHERE status <> 'completed')
UNION ALL SELECT 'evidence', id, 'result does not list it' FROM evidence e WHERE route = 'tool_result' AND NOT EXISTS (SELECT 1 FROM result_evidence l WHERE l.evidence_id = e.id AND l.result_id = e.result_id)
UNION ALL SELECT 'evidence', id, 'experiment does not list it' FROM evidence e WHERE route = 'experiment' AND NOT EXISTS (SELECT 1 FROM experiment_evidence l WHERE l.evidence_id = e.id AND l.experiment_id = e.experiment_id)
UNION ALL SELECT DISTINCT 'results', result_id, 'lists evidence of another record' FROM result_evidence l WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.id = l.evidence_id AND e.route = 'tool_result' AND e.result_id = l.result_id)
UNION ALL SELECT DISTINCT 'experiments', experiment_id, 'lists evidence of another record' FROM experiment_evidence l WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.id = l.evidence_id AND e.route = 'experiment' AND e.experiment_id = l.experiment_id)
UNION ALL SELECT 'calls', id, 'wrong investigation' FROM calls WHERE investigation_id <> 'investigation_1'
UNION ALL SELECT 'calls', id, 'unknown dataset' FROM calls WHERE dataset_id NOT IN (SELECT id FROM datasets)
UNION ALL SELECT 'calls', id, 'unknown comparison dataset' FROM calls WHERE comparison_dataset_id IS NOT NULL AND comparison_dataset_id NOT IN (SELECT id FROM datasets)
UNION ALL SELECT 'calls', c.id, 'absent dataset column' FROM calls c JOIN datasets d ON d.id = c.dataset_id WHERE NOT EXISTS (SELECT 1 FROM dataset_columns x WHERE x.dataset_id = d.id AND x.name = c.name)
UNION ALL SELECT 'calls', c.id, 'absent comparison column' FROM calls c JOIN datasets d ON d.id = c.comparison_dataset_id WHERE NOT EXISTS (SELECT 1 FROM dataset_columns x WHERE x.dataset_id = d.id AND x.name = c.name)
UNION ALL SELECT 'calls', c.id, 'positive label differs' FROM calls c JOIN datasets d ON d.id = c.dataset_id WHERE d.positive_label <> c.positive_label
UNION ALL SELECT 'calls', id, 'unknown hypothesis' FROM calls WHERE hypothesis_id IS NOT NULL AND hypothesis_id NOT IN (SELECT id FROM hypotheses)
UNION ALL SELECT 'calls', id, 'costs without assumption' FROM calls WHERE cost_evidence_id IS NOT NULL AND cost_evidence_id NOT IN (SELECT id FROM evidence WHERE kind = 'assumption')
UNION ALL SELECT 'results', id, 'unknown call' FROM results WHERE call_id NOT IN (SELECT id FROM calls)
UNION ALL SELECT 'results', max(id), 'call answered twice' FROM results GROUP BY call_id HAVING count(*) > 1
UNION ALL SELECT 'results', r.id, 'result does not match call' FROM results r JOIN calls c ON r.call_id = c.id WHERE r.tool <> c.tool OR r.version <> c.version OR r.completed_at < c.requested_at
UNION ALL SELECT 'results', id, 'evidence of an unfinished result' FROM results WHERE status <> 'completed' AND id IN (SELECT result_id FROM result_evidence)
UNION ALL SELECT 'results', r.id, 'hypothesis differs from call' FROM results r JOIN calls c ON r.call_id = c.id WHERE r.status = 'completed' AND r.tool = 'run_counterfactual_test' AND c.tool = r.tool AND r.hypothesis_id IS DISTINCT FROM c.hypothesis_id
UNION ALL SELECT 'results', r.id, 'method differs from call' FROM results r JOIN calls c ON r.call_id = c.id WHERE r.status = 'completed' AND r.tool = 'run_drift_tests' AND c.tool = r.tool AND r.method IS DISTINCT FROM c.method
UNION ALL SELECT 'results', r.id, 'scope differs from call' FROM results r JOIN calls c ON r.call_id = c.id
  WHERE (SELECT list_sort(list(a.dataset_id)) FROM asked a WHERE a.call_id = c.id) IS DISTINCT FROM (SELECT list_sort(list(d.dataset_id)) FROM result_datasets d WHERE d.result_id = r.id)
UNION ALL SELECT 'results', r.id, 'thresholds differ from call' FROM results r JOIN calls c ON r.call_id = c.id WHERE r.status = 'completed' AND r.tool = 'threshold_sweep' AND c.tool = r.tool
  AND (SELECT list_sort(list(a.threshold)) FROM call_thresholds a WHERE a.call_id = c.id) IS DISTINCT FROM (SELECT list_sort(list(d.threshold)) FROM result_thresholds d WHERE d.result_id = r.id)
UNION ALL SELECT 'hypotheses', id, 'assessed without evidence' FROM hypotheses WHERE status <> 'proposed' AND id NOT IN (SELECT hypothesis_id FROM hypothesis_evidence)
UNION ALL SELECT 'hypotheses', id, 'status without its evidence' FROM hypotheses h WHERE status <> 'proposed' AND NOT EXISTS (SELECT 1 FROM hypothesis_evidence l WHERE l.hypothesis_id = h.id
  AND l.relationship = CASE h.status WHEN 'weakened' THEN 'weakens' WHEN 'rejected' THEN 'rejects' ELSE 'supports' END)
UNION ALL SELECT 'hypotheses', id, 'confirmed without verification' FROM hypotheses WHERE status = 'confirmed' AND id NOT IN (SELECT hypothesis_id FROM experiments WHERE status = 'completed' AND outcome = 'supports')
UNION ALL SELECT DISTINCT 'hypotheses', hypothesis_id, 'evidence linked twice' FROM (SELECT hypothesis_id FROM hypothesis_evidence GROUP BY hypothesis_id, evidence_id HAVING count(*) > 1) AS x
UNION ALL SELECT DISTINCT 'hypotheses', hypothesis_id, 'unknown evidence' FROM hypothesis_evidence WHERE evidence_id NOT IN (SELECT id FROM evidence)
UNION ALL SELECT 'experiments', id, 'unknown hypothesis' FROM experiments WHERE hypothesis_id NOT IN (SELECT id FROM hypotheses)
UNION ALL SELECT 'experiments', id, 'completed without outcome' FROM experiments WHERE status = 'completed' AND outcome IS NULL
UNION ALL SELECT 'experiments', id, 'completed without evidence' FROM experiments WHERE status = 'completed' AND id NOT IN (SELECT experiment_id FROM experiment_evidence)
UNION ALL SELECT 'experiments', id, 'completed without finished calls' FROM experiments e WHERE status = 'completed' AND (id NOT IN (SELECT experiment_id FROM experiment_calls)
  OR EXISTS (SELECT 1 FROM experiment_calls l WHERE l.experiment_id = e.id AND l.call_id NOT IN (SELECT call_id FROM results WHERE status = 'completed')))
UNION ALL SELECT 'experiments', id, 'results without completion' FROM experiments WHERE status <> 'completed' AND (outcome IS NOT NULL OR id IN (SELECT experiment_id FROM experiment_evidence))
UNION ALL SELECT DISTINCT 'experiments', experiment_id, 'unknown call' FROM experiment_calls WHERE call_id NOT IN (SELECT id FROM calls)
UNION ALL SELECT DISTINCT 'experiments', experiment_id, 'unknown evidence' FROM experiment_evidence WHERE evidence_id NOT IN (SELECT id FROM evidence)
UNION ALL SELECT 'repairs', id, 'unknown hypothesis' FROM repairs WHERE hypothesis_id NOT IN (SELECT id FROM hypotheses)
UNION ALL SELECT 'repairs', id, 'repair without evidence' FROM repairs WHERE id NOT IN (SELECT repair_id FROM repair_evidence)
UNION ALL SELECT 'repairs', id, 'unknown dataset' FROM repairs WHERE kind = 'operating_policy' AND dataset_id NOT IN (SELECT id FROM datasets)
UNION ALL SELECT 'repairs', id, 'costs without assumption' FROM repairs WHERE kind = 'operating_policy' AND cost_evidence_id IS NOT NULL AND cost_evidence_id NOT IN (SELECT id FROM evidence WHERE kind = 'assumption')
UNION ALL SELECT DISTINCT 'repairs', repair_id, 'unknown evidence' FROM repair_evidence WHERE evidence_id NOT IN (SELECT id FROM evidence)
UNION ALL SELECT 'comparisons', id, 'unknown repair' FROM comparisons WHERE repair_id NOT IN (SELECT id FROM repairs)
UNION ALL SELECT 'comparisons', id, 'unknown dataset' FROM comparisons WHERE dataset_id NOT IN (SELECT id FROM datasets)
UNION ALL SELECT 'comparisons', c.id, 'not the repair''s dataset, policy and criterion' FROM comparisons c JOIN repairs r ON r.id = c.repair_id
  WHERE r.kind <> 'operating_policy' OR r.dataset_id <> c.dataset_id OR r.criterion <> c.criterion OR r.policy <> c.after_policy
UNION ALL SELECT 'comparisons', id, 'class or cost definitions differ' FROM comparisons WHERE baseline_label IS DISTINCT FROM after_label OR baseline_costs IS DISTINCT FROM after_costs
UNION ALL SELECT 'comparisons', id, 'costs without assumption' FROM comparisons WHERE cost_evidence_id IS NOT NULL AND cost_evidence_id NOT IN (SELECT id FROM evidence WHERE kind = 'assumption')
UNION ALL SELECT DISTINCT 'comparisons', comparison_id, 'evidence measures something else' FROM held WHERE NOT fits
UNION ALL SELECT DISTINCT 'comparisons', a.comparison_id, 'evidence on both sides' FROM comparison_evidence a JOIN comparison_evidence b ON a.comparison_id = b.comparison_id AND a.evidence_id = b.evidence_id AND a.side < b.side
UNION ALL SELECT DISTINCT 'comparisons', comparison_id, 'unknown evidence' FROM comparison_evidence WHERE evidence_id NOT IN (SELECT id FROM evidence)
UNION ALL SELECT 'record_events', id, 'unknown entity' FROM record_events WHERE entity_id NOT IN (SELECT id FROM known)
UNION ALL SELECT 'record_events', id, 'kind and entity differ' FROM record_events WHERE NOT starts_with(entity_id, CASE kind {KINDS} END)
UNION ALL SELECT 'record_events', id, 'outside the period' FROM record_events WHERE moment NOT BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-29 00:00:00'
UNION ALL SELECT 'diagnoses', id, 'wrong investigation' FROM diagnoses WHERE investigation_id <> 'investigation_1'
UNION ALL SELECT 'diagnoses', id, 'primary hypothesis not listed' FROM diagnoses d WHERE NOT EXISTS (SELECT 1 FROM diagnosis_links l WHERE l.diagnosis_id = d.id AND l.entity_id = d.primary_hypothesis_id)
UNION ALL SELECT DISTINCT 'diagnoses', diagnosis_id, 'unknown entity' FROM diagnosis_links WHERE entity_id NOT IN (SELECT id FROM known)"""


@query("j_integrity", sql(inv.INVESTIGATION_SQL, INTEGRITY))
def _(spark, d):
    return integ.integrity(inv.investigation(spark, d), "investigation_1", ("2024-01-02 00:00:00", "2024-01-29 00:00:00"))


EDGES = """
edges AS (SELECT source_id AS "from", id AS "to", 'provides dataset' AS relationship FROM datasets
  UNION SELECT dataset_id, id, 'dataset of call' FROM calls UNION SELECT comparison_dataset_id, id, 'comparison dataset of call' FROM calls WHERE comparison_dataset_id IS NOT NULL
  UNION SELECT cost_evidence_id, id, 'supplies cost assumption' FROM calls WHERE cost_evidence_id IS NOT NULL UNION SELECT call_id, id, 'produced result' FROM results
  UNION SELECT dataset_id, result_id, 'measured dataset' FROM result_datasets UNION SELECT source_id, id, 'source of evidence' FROM evidence WHERE source_id IS NOT NULL
  UNION SELECT dataset_id, id, 'scopes evidence' FROM evidence WHERE dataset_id IS NOT NULL UNION SELECT coalesce(result_id, experiment_id), id, 'generated evidence' FROM evidence WHERE route <> 'source'
  UNION SELECT evidence_id, hypothesis_id, relationship FROM hypothesis_evidence UNION SELECT hypothesis_id, id, 'tested by' FROM experiments
  UNION SELECT experiment_id, call_id, 'executes test' FROM experiment_calls UNION SELECT x.experiment_id, r.id, 'test result' FROM experiment_calls x JOIN results r USING (call_id)
  UNION SELECT hypothesis_id, id, 'motivates repair' FROM repairs UNION SELECT evidence_id, repair_id, 'informs repair' FROM repair_evidence UNION SELECT dataset_id, id, 'repair dataset' FROM repairs
  UNION SELECT cost_evidence_id, id, 'supplies cost assumption' FROM repairs WHERE cost_evidence_id IS NOT NULL UNION SELECT repair_id, id, 're-evaluated by' FROM comparisons
  UNION SELECT dataset_id, id, 'comparison dataset' FROM comparisons UNION SELECT evidence_id, comparison_id, side || ' evidence' FROM comparison_evidence
  UNION SELECT entity_id, diagnosis_id, CASE WHEN entity_id = primary_hypothesis_id THEN 'primary hypothesis' WHEN starts_with(entity_id, 'hypothesis_') THEN 'considered hypothesis' ELSE 'included in diagnosis' END
    FROM diagnosis_links JOIN diagnoses ON diagnoses.id = diagnosis_id)"""


@query("j_lineage_edges", sql(inv.INVESTIGATION_SQL + "," + EDGES, "SELECT * FROM edges"))
def _(spark, d):
    return integ.lineage_edges(inv.investigation(spark, d))


@query(
    "j_lineage_neighbors",
    sql(
        inv.INVESTIGATION_SQL + "," + EDGES,
        """SELECT "from" AS id, "to" AS neighbor, relationship, 'out' AS direction FROM edges WHERE "from" IN (SELECT id FROM calls)
           UNION ALL SELECT "to", "from", relationship, 'in' FROM edges WHERE "to" IN (SELECT id FROM calls)""",
    ),
)
def _(spark, d):
    tables = inv.investigation(spark, d)
    return rec.lineage_neighbors(integ.lineage_edges(tables), tables["calls"].select("id"))


# what each start reaches, by its shortest walk; a start itself counts as reached when a walk comes back to it
CLOSURE = """
steps AS (SELECT DISTINCT 'out' AS direction, "from" AS place, "to" AS next FROM edges UNION SELECT 'in', "to", "from" FROM edges),
starts AS (SELECT id FROM hypotheses UNION ALL SELECT id FROM sources),
walks(id, direction, reached, started, hops) USING KEY (id, direction, reached, started) AS (
  SELECT s.id, d.direction, s.id, true, 0 FROM starts s, (VALUES ('out'), ('in')) AS d(direction)
  UNION SELECT w.id, w.direction, t.next, false, min(w.hops + 1) FROM walks w JOIN steps t ON t.direction = w.direction AND t.place = w.reached
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walks k WHERE k.id = w.id AND k.direction = w.direction AND k.reached IS NOT DISTINCT FROM t.next AND NOT k.started)
  GROUP BY w.id, w.direction, t.next)"""


@query(
    "j_lineage_closure",
    sql(
        "RECURSIVE " + inv.INVESTIGATION_SQL + "," + EDGES + "," + CLOSURE,
        "SELECT id, direction, reached, hops, reached = id AS cyclic FROM walks WHERE NOT started",
    ),
)
def _(spark, d):
    tables = inv.investigation(spark, d)
    starts = tables["hypotheses"].select("id").unionByName(tables["sources"].select("id"))
    return integ.lineage_closure(integ.lineage_links(tables), starts)


EV_SEQ = """
seq AS (SELECT user_id, event_id AS position, event_id - CASE WHEN event_id % 97 = 0 THEN 100000 ELSE 0 END AS num, ts - CASE WHEN event_id % 89 = 0 THEN INTERVAL 40 DAY ELSE INTERVAL 0 DAY END AS moment FROM events),
pairs AS (SELECT *, lag(num) OVER w AS before_num, lag(moment) OVER w AS before_moment FROM seq WINDOW w AS (PARTITION BY user_id ORDER BY position))"""


def _sequence(spark, d):
    return fr.table(spark, d, "events").select(
        "user_id",
        F.col("event_id").alias("position"),
        (F.col("event_id") - F.when(F.col("event_id") % 97 == 0, 100000).otherwise(0)).alias("sequence"),
        (F.col("ts").cast("timestamp_ntz") - F.expr("make_dt_interval(case when event_id % 89 = 0 then 40 else 0 end)")).alias("at"),
    )


@query(
    "event_sequence_check",
    sql(
        EV_SEQ,
        """SELECT user_id, position, 'sequence' AS rule FROM pairs WHERE num <= before_num
           UNION ALL SELECT user_id, position, 'time' FROM pairs WHERE moment < before_moment""",
    ),
)
def _(spark, d):
    return rec.sequence_violations(_sequence(spark, d), ("user_id",))


RANK = "CASE {0} WHEN 'unassessed' THEN 1 WHEN 'limited' THEN 2 WHEN 'moderate' THEN 3 ELSE 4 END"


@query(
    "p_confidence_cap",
    sql(EN, f"SELECT id, level, CASE WHEN {RANK.format('level')} <= 2 THEN level ELSE 'limited' END AS capped FROM hypotheses"),
)
def _(spark, d):
    h = fr.entities(spark, d)["hypotheses"]
    return h.select("id", "level", rec.capped_level(F.col("level"), F.lit("limited")).alias("capped"))


@query(
    "hypothesis_status",
    sql(
        EN,
        """SELECT hypothesis_id, CASE WHEN count(DISTINCT outcome) FILTER (status = 'completed') = 1 THEN CASE max(outcome) FILTER (status = 'completed') WHEN 'supports' THEN 'supported' WHEN 'weakens' THEN 'weakened' WHEN 'rejects' THEN 'rejected' ELSE 'proposed' END ELSE 'proposed' END AS status
           FROM experiments GROUP BY 1""",
    ),
)
def _(spark, d):
    return rec.hypothesis_status(fr.entities(spark, d)["experiments"])


CHALLENGE = """
tests AS (SELECT hypothesis_id AS id, count(*) FILTER (status = 'completed' AND outcome IN ('weakens', 'rejects')) AS ct, count(*) FILTER (status = 'completed' AND outcome = 'supports') AS sup, count(*) AS ex FROM experiments GROUP BY 1),
hf AS (SELECT h.*, coalesce(ct, 0) AS ct, coalesce(sup, 0) AS sup, coalesce(ex, 0) AS ex FROM hypotheses h LEFT JOIN tests USING (id)),
cf AS (SELECT id, 'contradiction' AS category, ct AS related, 'reconcile evidence' AS next_step FROM hf WHERE ct > 0
  UNION ALL SELECT id, 'verification', ex, 'run a declared test' FROM hf WHERE sup = 0 AND status <> 'rejected'
  UNION ALL SELECT id, 'alternative', open_questions, 'answer open questions' FROM hf WHERE open_questions > 0 AND status <> 'rejected'
  UNION ALL SELECT id, 'assumption', 0, 'validate with stakeholders' FROM evidence WHERE kind = 'assumption'
  UNION ALL SELECT id, 'verification', 0, 'repeat on independent data' FROM comparisons)"""


@query("challenge_findings", sql(EN + "," + CHALLENGE, "SELECT * FROM cf"))
def _(spark, d):
    t = fr.entities(spark, d)
    return rec.challenge_findings(t["hypotheses"], t["experiments"], t["evidence"], t["comparisons"])


# --- gates ------------------------------------------------------------------------------------------

CHECKS = [
    ("baseline", "accuracy", "at_least", 0.75, "ratio"),
    ("after", "recall", "at_least", 0.9, "ratio"),
    ("after", "precision", "at_least", 0.9, "ratio"),
    ("after", "total_cost", "at_most", 30000.0, "cost"),
    ("after", "unheard_of", "at_least", 0.1, "ratio"),
]
CHECK_SQL = "checks AS (SELECT * FROM (VALUES " + ", ".join(str(c) for c in CHECKS) + ") v(stage, metric, operator, value, unit))"
CHECKED = """
checked AS (SELECT c.stage, c.metric, c.operator, c.value::DOUBLE AS value, c.unit, l.value AS measured, CASE WHEN l.value IS NULL THEN 'inconclusive'
   WHEN c.operator = 'at_least' AND l.value >= c.value OR c.operator = 'at_most' AND l.value <= c.value THEN 'passed' ELSE 'failed' END AS status
   FROM checks c LEFT JOIN longm l ON l.stage = c.stage AND l.metric = c.metric)"""


def _checked(spark, d):
    checks = spark.createDataFrame(CHECKS, "stage string, metric string, operator string, value double, unit string")
    rows = th.policy_measurements(fr.eval_orders(spark, d), 0.5, 0.35, (10, 1))
    return rec.policy_checks(checks, rows)


@query("j_policy_checks", sql(EO + "," + PAIRS + "," + CHECK_SQL + "," + CHECKED, "SELECT * FROM checked", ["value", "measured"]))
def _(spark, d):
    return _checked(spark, d)


@query(
    "evaluate_gate",
    sql(EO + "," + PAIRS + "," + CHECK_SQL + "," + CHECKED, "SELECT bool_and(status = 'passed') AS passed, count(*) FILTER (status <> 'passed') AS not_passed FROM checked"),
)
def _(spark, d):
    return rec.evaluate_gate(_checked(spark, d))


GATE_SOURCE = """
cmp AS (SELECT 1 AS position, 'passed' AS status, metric, value FROM longm WHERE stage = 'after' UNION ALL SELECT 2, 'passed', metric, value FROM longm WHERE stage = 'baseline'),
picked AS (SELECT metric, CASE WHEN metric = 'total_cost' THEN 'cost' ELSE 'ratio' END AS unit, arg_min(value, position) AS value FROM cmp
           WHERE value IS NOT NULL AND metric IN ('recall', 'precision', 'balanced_accuracy', 'total_cost', 'f1') GROUP BY 1, 2)"""


@query(
    "derive_gate",
    sql(
        EO + "," + PAIRS + "," + GATE_SOURCE,
        "SELECT 'after' AS stage, metric, CASE WHEN unit = 'cost' THEN 'at_most' ELSE 'at_least' END AS operator, value, unit FROM picked",
        ["value"],
    ),
)
def _(spark, d):
    rows = th.policy_measurements(fr.eval_orders(spark, d), 0.5, 0.35, (10, 1))
    position = F.when(F.col("stage") == "after", 1).otherwise(2)
    comparisons = rows.select(
        position.alias("position"),
        F.lit("passed").alias("status"),
        "metric",
        "unit",
        "value",
        F.lit("f1").alias("accepted_metric"),
        F.lit("at_least").alias("accepted_operator"),
    )
    return rec.derive_gate(comparisons)


# One hypothesis per customer over the metrics of its own orders.
BY_CUSTOMER = """
cconf AS (SELECT o_custkey AS scope, count(*) FILTER (e.y_true = '1' AND y_pred = '1') AS tp, count(*) FILTER (e.y_true <> '1' AND y_pred = '1') AS fp,
   count(*) FILTER (e.y_true <> '1' AND y_pred <> '1') AS tn, count(*) FILTER (e.y_true = '1' AND y_pred <> '1') AS fn FROM eval_orders e JOIN orders ON o_orderkey = row_id GROUP BY 1),
judge AS (SELECT scope, tp::DOUBLE / nullif(tp + fn, 0) AS rc, (tp + tn)::DOUBLE / (tp + fp + tn + fn) AS ac FROM cconf)"""


@query(
    "falsify_criterion",
    sql(
        EO + "," + BY_CUSTOMER,
        """SELECT 'h_' || scope AS hypothesis_id, CASE WHEN rc IS NULL THEN 'inconclusive' WHEN rc >= 0.7 AND ac <= 0.8 THEN 'supports' WHEN rc >= 0.7 OR ac <= 0.8 THEN 'weakens' ELSE 'rejects' END AS outcome,
             (CASE WHEN rc >= 0.7 THEN 1 ELSE 0 END + CASE WHEN ac <= 0.8 THEN 1 ELSE 0 END)::BIGINT AS met, 2::BIGINT AS criteria FROM judge""",
    ),
)
def _(spark, d):
    orders = fr.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("scope"))
    measured = m.metric_rows(m.confusion(fr.eval_orders(spark, d).join(orders, "row_id"), by=("scope",)), ("scope",), ("recall", "accuracy"))
    rules = F.array(
        F.struct(F.lit("recall").alias("metric"), F.lit("at_least").alias("operator"), F.lit(0.7).alias("value")),
        F.struct(F.lit("accuracy").alias("metric"), F.lit("at_most").alias("operator"), F.lit(0.8).alias("value")),
    )
    scopes = orders.select("scope").distinct()
    criteria = scopes.select(
        "scope", F.concat(F.lit("h_"), F.col("scope").cast("string")).alias("hypothesis_id"), F.lit("ratio").alias("unit"), F.inline(rules)
    )
    return rec.falsify(measured, criteria)


@query(
    "experiment_outcome",
    sql(
        "",
        """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'inconclusive' WHEN abs(after - before) < 0.05 THEN 'inconclusive'
             WHEN (after > before) = (o_orderstatus = 'F') THEN 'consistent' ELSE 'contradicts' END AS outcome
           FROM (SELECT o_orderkey, o_orderstatus, (o_custkey % 100) / 100.0::DOUBLE AS before, (o_orderkey % 97) / 100.0::DOUBLE + 0.003 AS after FROM orders)""",
    ),
)
def _(spark, d):
    runs = fr.table(spark, d, "orders").select(
        "o_orderkey",
        ((F.col("o_custkey") % 100) / F.lit(100.0)).alias("before"),
        ((F.col("o_orderkey") % 97) / F.lit(100.0) + 0.003).alias("after"),
        F.lit(0.05).alias("minimum"),
        F.when(F.col("o_orderstatus") == "F", "increase").otherwise("decrease").alias("expectation"),
        (F.col("o_orderkey") % 4 != 0).alias("controlled"),
    )
    return rec.experiment_outcome(runs).select("o_orderkey", "outcome")


PROFILE_FACTS = (
    ED + "," + CONF.format(src="eval_docs") + ", mt AS (" + METRICS_FROM.format(keys="", conf="conf") + """),
pf AS (SELECT (SELECT value FROM mt WHERE metric = 'accuracy') AS acc, (SELECT value FROM mt WHERE metric = 'balanced_accuracy') AS ba, (SELECT value FROM mt WHERE metric = 'minority_recall') AS mr),
sc AS (SELECT round((acc * 0.7 + ba * 0.3) * 100) AS perf, greatest(1, least(100, round(mr * 100))) AS mino FROM pf)"""
)


@query(
    "reliability_profile",
    sql(
        PROFILE_FACTS,
        """SELECT 'performance' AS dimension, perf AS score, 0.1::DOUBLE AS weight, 'measured' AS availability FROM sc UNION ALL SELECT 'minority', mino, 0.35, 'measured' FROM sc
           UNION ALL SELECT unnest(['calibration', 'drift', 'leakage', 'cost']), NULL, unnest([0.1, 0.1, 0.1, 0.25]), 'not measured'
           UNION ALL SELECT 'total', CASE WHEN mino < 35 THEN least(38, round((perf * 0.1 + mino * 0.35) / 0.45)) ELSE round((perf * 0.1 + mino * 0.35) / 0.45) END, 0.45, 'measured' FROM sc""",
        ["score", "weight"],
    ),
)
def _(spark, d):
    counts = m.confusion(fr.eval_docs(spark, d))
    rates = m.rate_columns()
    unknown = F.lit(None).cast("double")
    facts = counts.select(
        *[rates[k][0].alias(k) for k in ("accuracy", "balanced_accuracy", "minority_recall")],
        *[unknown.alias(k) for k in ("ece", "psi", "suspicions", "cost_before", "cost_after")],
    )
    return rec.reliability_profile(facts)


@query(
    "incident_record",
    sql(
        EO + "," + PAIRS + "," + CHECK_SQL + "," + CHECKED + "," + EN,
        """SELECT (SELECT count(*) FROM evidence) AS evidence, (SELECT count(*) FROM results WHERE status = 'completed') AS completed_results,
             (SELECT count(*) FROM hypotheses WHERE status = 'rejected') AS rejected_hypotheses, (SELECT count(*) FROM hypotheses WHERE status NOT IN ('confirmed', 'rejected')) AS unresolved_hypotheses,
             (SELECT count(*) FROM comparisons WHERE status = 'passed') AS passed_comparisons, (SELECT count(*) FROM checked) AS checks, (SELECT count(*) FROM checked WHERE status = 'passed') AS passed_checks""",
    ),
)
def _(spark, d):
    t = fr.entities(spark, d)
    return rec.incident_record(t, t["comparisons"], _checked(spark, d))




@query(
    "incident_hypotheses",
    sql(EN, "SELECT id, CASE status WHEN 'rejected' THEN 'rejected' ELSE 'unresolved' END AS fate, level FROM hypotheses WHERE status <> 'confirmed'"),
)
def _(spark, d):
    return rec.incident_hypotheses(fr.entities(spark, d)["hypotheses"])


@query(
    "audit_columns",
    sql(
        fr.CELLS_SQL,
        f"""SELECT * FROM (SELECT 'amount' AS "column", count(*) FILTER ({gone('amount')}) AS missing, count(*) FILTER ({gone('amount')})::DOUBLE / count(*) AS missing_share,
                             CASE WHEN count(*) FILTER (NOT {gone('amount')} AND TRY_CAST(trim(amount) AS DOUBLE) IS NULL) > 0 THEN 'categorical' ELSE 'numeric' END AS type FROM raw_cells) WHERE missing > 0""",
        ["missing_share"],
    ),
)
def _(spark, d):
    return rec.audit_columns(q.profile_counts(q.cell_counts(fr.raw_cells(spark, d), ["amount", "code", "status"])))
