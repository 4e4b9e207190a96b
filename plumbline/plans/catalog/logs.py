"""Training logs, JSON metrics, histories and findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...operators import compare as cp
from ...operators import trends as tr
from ...session import cut
from ...sources import logs as lg
from .. import frames as fr
from ..registry import query, sql

LL, RU, JS, IT = fr.LOG_LINES_SQL, fr.RUNS_SQL, fr.JSON_SQL, fr.SPLITS_SQL

NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(line,
  '\[(validation|production|train|training|test)\]\s*(accuracy|loss|mae|mse|rmse|r2|precision|recall|f1|auc)', '\1_\2', 'gi'),
  '\b(train|training|val|validation|test|production)[/.](accuracy|acc|loss|mae|mse|rmse|r2|precision|recall|f1|auc)\b', '\1_\2', 'gi'),
  '\b(loss|accuracy|acc):', 'train_\1:', 'gi')"""
EPOCH = r"""TRY_CAST(nullif(regexp_extract(line, '(?i)\bepoch(?:\s*[:=]\s*|\s+)(\d+)(?:\s|/|\]|$)', 1), '') AS BIGINT)"""
TOKEN = r"""(?i)\b([a-z_][a-z_0-9]*)\s*[:=]\s*([+-]?(?:\d*\.)?\d+(?:e[+-]?\d+)?|nan|inf(?:inity)?)\s*(%?)"""
TOKENS = f"""
norm AS (SELECT source, line_no, {EPOCH} AS epoch, {NORMAL} AS clean FROM log_lines),
toks AS (SELECT source, line_no, epoch, unnest(range(len(k))) AS position, unnest(k) AS key, unnest(v) AS txt, unnest(p) AS sign
         FROM (SELECT *, regexp_extract_all(clean, '{TOKEN}', 1) AS k, regexp_extract_all(clean, '{TOKEN}', 2) AS v, regexp_extract_all(clean, '{TOKEN}', 3) AS p FROM norm)),
named AS (SELECT *, CASE lower(key) WHEN 'train_loss' THEN 'Training loss' WHEN 'val_accuracy' THEN 'Validation accuracy' WHEN 'validation_loss' THEN 'Validation loss'
   WHEN 'train_acc' THEN 'Training accuracy' WHEN 'production_accuracy' THEN 'Production accuracy' WHEN 'test_r2' THEN 'Test R2' WHEN 'majority' THEN 'Majority share'
   WHEN 'val_mae' THEN 'Validation MAE' WHEN 'prod_recall' THEN 'Production RECALL' END AS metric FROM toks),
vals AS (SELECT source, line_no, position, epoch, metric, sign = '%' AS pct, regexp_matches(metric, '(?i)accuracy|share|recall') AS bounded,
   CASE WHEN sign = '%' AND regexp_matches(metric, '(?i)accuracy|share|recall') THEN TRY_CAST(txt AS DOUBLE) / 100 ELSE TRY_CAST(txt AS DOUBLE) END AS raw FROM named WHERE metric IS NOT NULL),
judged AS (SELECT *, CASE WHEN raw IS NULL OR NOT isfinite(raw) THEN 'not finite' WHEN raw < 0 AND metric NOT LIKE '%R2' THEN 'negative' WHEN metric LIKE '%R2' AND raw > 1 THEN 'above one'
   WHEN bounded AND raw > 1 THEN 'rate above one' WHEN NOT bounded AND pct THEN 'percent of an unbounded metric' END AS reason FROM vals),
metrics AS (SELECT source, line_no, position, epoch, metric, raw AS value FROM judged WHERE reason IS NULL),
latest AS (SELECT source, metric, arg_max(value, line_no * 100 + position) AS value FROM metrics GROUP BY 1, 2)"""


@query("f_normalise_log", sql(LL, f"SELECT source, line_no, {NORMAL} AS line FROM log_lines"))
def _(spark, d):
    return fr.log_lines(spark, d).select("source", "line_no", lg.normalise(F.col("line")).alias("line"))


@query("f_epoch", sql(LL, f"SELECT line_no, {EPOCH} AS epoch FROM log_lines"))
def _(spark, d):
    return fr.log_lines(spark, d).select("line_no", lg.epoch_of(F.col("line")).alias("epoch"))


@query("extract_log_metrics", sql(LL + "," + TOKENS, "SELECT * FROM metrics", ["value"]))
def _(spark, d):
    return lg.extract_metrics(fr.log_lines(spark, d))


@query(
    "p_metric_valid",
    sql(LL + "," + TOKENS, "SELECT source, line_no, position, metric, CASE WHEN reason IS NULL THEN raw END AS value, reason FROM judged", ["value"]),
)
def _(spark, d):
    return lg.metric_tokens(fr.log_lines(spark, d)).drop("epoch")


@query("last_valid_metric", sql(LL + "," + TOKENS, "SELECT * FROM latest", ["value"]))
def _(spark, d):
    return tr.last_valid(lg.extract_metrics(fr.log_lines(spark, d)))


GAPS = """
wide AS (SELECT source, max(value) FILTER (metric = 'Validation accuracy') AS val, max(value) FILTER (metric = 'Production accuracy') AS prod,
                max(value) FILTER (metric = 'Training accuracy') AS train, max(value) FILTER (metric = 'Majority share') AS majority FROM latest GROUP BY 1),
gaps AS (SELECT source, 'Possible distribution shift' AS title, format('{:.1f} points', (val - prod) * 100) AS evidence, 'Suggested' AS strength, 'data' AS category FROM wide WHERE val - prod >= 0.1
  UNION ALL SELECT source, 'Possible overfitting', format('{:.1f} points', (train - val) * 100), 'Suggested', 'training' FROM wide WHERE train - val >= 0.1
  UNION ALL SELECT source, 'Possible class imbalance', format('{:.1f} %', majority * 100), 'Supported', 'data' FROM wide WHERE majority >= 0.7)"""


def _gaps(spark, d):
    return tr.gap_findings(tr.last_valid(lg.extract_metrics(fr.log_lines(spark, d))))


@query("gap_findings", sql(LL + "," + TOKENS + "," + GAPS, "SELECT * FROM gaps"))
def _(spark, d):
    return _gaps(spark, d)


@query("p_lens_filter", sql(LL + "," + TOKENS + "," + GAPS, "SELECT * FROM gaps WHERE category = 'training'"))
def _(spark, d):
    return cp.lens_filter(_gaps(spark, d), "Training & optimization")


@query(
    "rank_findings",
    sql(LL + "," + TOKENS + "," + GAPS, "SELECT source, title, CASE strength WHEN 'Observed' THEN 1 WHEN 'Supported' THEN 2 ELSE 3 END AS rank FROM gaps", longs=["rank"]),
)
def _(spark, d):
    return cp.rank_findings(_gaps(spark, d)).select("source", "title", cp.strength_rank().alias("rank"))


@query(
    "combine_sources",
    sql(
        LL + "," + TOKENS + "," + GAPS,
        "SELECT title, count(*) AS sources, min(source) AS source, arg_min(evidence, source) AS evidence, arg_min(strength, source) AS strength, arg_min(category, source) AS category FROM gaps GROUP BY 1",
    ),
)
def _(spark, d):
    return tr.combine_sources(_gaps(spark, d))


@query(
    "map_metric_columns",
    sql("", "SELECT o_orderkey AS epoch, o_totalprice AS train_loss, o_custkey FROM orders", ["train_loss"]),
)
def _(spark, d):
    orders = fr.table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return lg.map_metric_columns(orders, {"o_orderkey": "epoch", "o_totalprice": "train_loss"})


# --- JSON -----------------------------------------------------------------------------------------

LEAVES = """
leaves AS (
  SELECT event_id, 0::BIGINT AS record, 'val_accuracy' AS path, CAST(('0.' || (10 + event_id % 80))::DOUBLE AS VARCHAR) AS value FROM events WHERE event_id % 3 = 0 UNION ALL
  SELECT event_id, 1, 'loss', CAST(value AS VARCHAR) FROM events WHERE event_id % 3 = 0 UNION ALL
  SELECT event_id, 0, 'epoch', '1' FROM events WHERE event_id % 3 = 1 UNION ALL
  SELECT event_id, 0, 'val_acc', (event_id % 100) || '%' FROM events WHERE event_id % 3 = 1 UNION ALL
  SELECT event_id, 0, 'props_k', props::JSON ->> '$.k' FROM events WHERE event_id % 3 = 2 UNION ALL
  SELECT event_id, 0, 'run_tags_0', 'a' FROM events WHERE event_id % 3 = 2 UNION ALL
  SELECT event_id, 0, 'run_tags_1', 'b' FROM events WHERE event_id % 3 = 2)"""


NUMBERS = ("val_accuracy", "loss")


@query(
    "f_json_flatten",
    sql(
        LEAVES,
        f"""SELECT event_id, record, path, CASE WHEN path NOT IN {NUMBERS} THEN value END AS value, CASE WHEN path IN {NUMBERS} THEN value::DOUBLE END AS number FROM leaves""",
        ["number"],
    ),
)
def _(spark, d):
    # Engines spell numbers differently: numeric leaves are compared as numbers, the others as text.
    leaves = lg.flatten_json(fr.metric_json(spark, d), "event_id", "text")
    numeric = F.col("path").isin(*NUMBERS)
    return leaves.select("event_id", "record", "path", F.when(~numeric, F.col("value")).alias("value"), F.when(numeric, F.col("value").try_cast("double")).alias("number"))


@query(
    "flatten_json_metrics",
    sql(
        LEAVES,
        """SELECT CAST(event_id AS VARCHAR) AS source, record AS line_no, 'Validation accuracy' AS metric, value::DOUBLE AS value FROM leaves WHERE path = 'val_accuracy'
           UNION ALL SELECT CAST(event_id AS VARCHAR), record, 'Validation accuracy', (event_id % 100) / 100.0::DOUBLE FROM leaves WHERE path = 'val_acc'""",
        ["value"],
    ),
)
def _(spark, d):
    leaves = lg.flatten_json(fr.metric_json(spark, d), "event_id", "text")
    return lg.extract_metrics(lg.json_lines(leaves, "event_id")).select("source", "line_no", "metric", "value")


# --- histories --------------------------------------------------------------------------------------

HISTORY = """
restart AS (SELECT source FROM (SELECT source, epoch, lag(epoch) OVER (PARTITION BY source ORDER BY line_no) AS before FROM runs) WHERE epoch < before
            UNION SELECT source FROM runs GROUP BY source, epoch HAVING count(*) > 1),
hist AS (SELECT source, epoch, unnest(['Training loss', 'Validation loss']) AS metric, unnest([train_loss, val_loss]) AS value FROM runs WHERE source NOT IN (SELECT source FROM restart)),
tail5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY epoch DESC) AS back FROM runs WHERE source NOT IN (SELECT source FROM restart)) WHERE back <= 5),
tails AS (SELECT source, min(epoch) AS first_epoch, max(epoch) AS last_epoch, list(train_loss ORDER BY epoch) AS t, list(val_loss ORDER BY epoch) AS v,
                 min(train_loss) AS tmin, max(train_loss) AS tmax, min(val_loss) AS vmin, max(val_loss) AS vmax
          FROM tail5 GROUP BY 1 HAVING count(*) >= 4 AND max(epoch) - min(epoch) = count(*) - 1),
turns AS (SELECT source, count(*) FILTER (a * b < 0 AND abs(a) >= tmax * 0.1 AND abs(b) >= tmax * 0.1) AS tt, count(*) FILTER (c * e < 0 AND abs(c) >= vmax * 0.1 AND abs(e) >= vmax * 0.1) AS vt
          FROM (SELECT source, tmax, vmax, t[i + 2] - t[i + 1] AS a, t[i + 3] - t[i + 2] AS b, v[i + 2] - v[i + 1] AS c, v[i + 3] - v[i + 2] AS e FROM tails, range(3) r(i) WHERE i + 3 <= len(t)) GROUP BY 1),
overfit AS (SELECT source, first_epoch, last_epoch, 'Possible overfitting' AS title FROM tails WHERE t[-1] <= t[1] * 0.9 AND v[-1] >= v[1] * 1.1),
stalled AS (SELECT source, first_epoch, last_epoch, 'Possible stalled learning' AS title, CASE WHEN (tmax - tmin) / tmax <= 0.01 THEN 'Training loss' ELSE 'Validation loss' END AS curve
            FROM tails WHERE (tmax - tmin) / tmax <= 0.01 OR (vmax - vmin) / vmax <= 0.01),
unstable AS (SELECT source, first_epoch, last_epoch, 'Possible unstable training' AS title, CASE WHEN tt >= 2 THEN 'Training loss' ELSE 'Validation loss' END AS curve
             FROM tails JOIN turns USING (source) WHERE tt >= 2 OR vt >= 2)"""


def _history(spark, d):
    # The metric rows are the silver table of a log: written once, then read by every history rule.
    return tr.epoch_history(cut(lg.extract_metrics(fr.runs(spark, d)), "log-metrics"))


@query("epoch_history", sql(RU + "," + HISTORY, "SELECT * FROM hist", ["value"]))
def _(spark, d):
    return _history(spark, d)


@query(
    "history_tail",
    sql(RU + "," + HISTORY, "SELECT source, epoch, metric, value FROM (SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY epoch DESC) AS back FROM hist) WHERE back <= 6", ["value"]),
)
def _(spark, d):
    return tr.history_tail(_history(spark, d), 6)


@query("trend_overfit", sql(RU + "," + HISTORY, "SELECT * FROM overfit"))
def _(spark, d):
    return tr.trend_overfit(_history(spark, d))


@query("trend_stalled", sql(RU + "," + HISTORY, "SELECT * FROM stalled"))
def _(spark, d):
    return tr.trend_stalled(_history(spark, d))


@query("trend_unstable", sql(RU + "," + HISTORY, "SELECT * FROM unstable"))
def _(spark, d):
    return tr.trend_unstable(_history(spark, d))


@query(
    "job_log_audit",
    sql(
        RU + "," + HISTORY,
        """SELECT title, count(*) AS sources FROM (SELECT source, title FROM overfit UNION ALL SELECT source, title FROM stalled UNION ALL SELECT source, title FROM unstable) GROUP BY 1""",
    ),
)
def _(spark, d):
    from ..jobs import log_audit

    return log_audit(fr.runs(spark, d))["findings"].groupBy("title").agg(F.count(F.lit(1)).alias("sources"))


@query(
    "log_observations",
    sql(
        RU + "," + HISTORY,
        """SELECT source, line_no, 'log_line' AS kind, 'epoch=' || epoch || ' train_loss=' || train_loss || ' val_loss=' || val_loss AS text FROM runs
           UNION ALL SELECT source, NULL, 'epoch', 'epoch ' || epoch || ': ' || string_agg(DISTINCT metric, ', ' ORDER BY metric) FROM hist GROUP BY source, epoch
           UNION ALL SELECT source, NULL, 'finding', title FROM (SELECT source, title FROM overfit UNION ALL SELECT source, title FROM stalled UNION ALL SELECT source, title FROM unstable)""",
    ),
)
def _(spark, d):
    history = cut(_history(spark, d), "log-history")
    return lg.observations(fr.runs(spark, d), history, tr.trends(history))


@query(
    "bundled_evidence",
    sql(LL + "," + TOKENS + "," + GAPS, "SELECT DISTINCT title, source, source || ': ' || evidence AS excerpt FROM gaps"),
)
def _(spark, d):
    return tr.bundled_evidence(_gaps(spark, d))


# --- diagnosis ----------------------------------------------------------------------------------------

DIAG_COLS = ("quantity", "discount", "tax", "returnflag", "linestatus")


def _split(spark, d, name):
    return fr.split_of(spark, d, name).select(*DIAG_COLS)


DIAGNOSIS = """
tr AS (SELECT * FROM items WHERE split = 'train'), va AS (SELECT * FROM items WHERE split = 'val'), pd AS (SELECT * FROM items WHERE split = 'production'),
tshare AS (SELECT max(n) / sum(n)::DOUBLE AS s FROM (SELECT count(*) AS n FROM tr GROUP BY linestatus)),
ov AS (SELECT count(*) AS n FROM va SEMI JOIN (SELECT DISTINCT quantity, discount, tax, returnflag FROM tr) k USING (quantity, discount, tax, returnflag)),
means AS (SELECT 'quantity' AS c, (SELECT avg(quantity) FROM pd) - (SELECT avg(quantity) FROM tr) AS dm, (SELECT max(quantity) - min(quantity) FROM tr) AS rg UNION ALL
  SELECT 'discount', (SELECT avg(discount) FROM pd) - (SELECT avg(discount) FROM tr), (SELECT max(discount) - min(discount) FROM tr) UNION ALL
  SELECT 'tax', (SELECT avg(tax) FROM pd) - (SELECT avg(tax) FROM tr), (SELECT max(tax) - min(tax) FROM tr)),
sh AS (SELECT (SELECT count(*) FILTER (discount IS NULL)::DOUBLE / count(*) FROM pd) - (SELECT count(*) FILTER (discount IS NULL)::DOUBLE / count(*) FROM tr) AS miss,
              (SELECT count(*) FILTER (returnflag NOT IN (SELECT returnflag FROM tr)) FROM pd) AS unseen),
cls AS (SELECT label, (SELECT count(*) FILTER (linestatus = label)::DOUBLE / count(*) FROM pd) - (SELECT count(*) FILTER (linestatus = label)::DOUBLE / count(*) FROM tr) AS dl FROM (SELECT DISTINCT linestatus AS label FROM items)),
shiftn AS (SELECT (SELECT count(*) FROM means WHERE abs(dm) > rg * 0.2) + (SELECT count(*) FROM sh WHERE abs(miss) >= 0.1) + (SELECT count(*) FROM sh WHERE unseen > 0) + (SELECT count(*) FROM cls WHERE abs(dl) >= 0.1) AS n),
diag AS (SELECT 'missing' AS hypothesis, 3 AS score, 1 AS support, 0 AS conflicts FROM tr HAVING count(*) FILTER (discount IS NULL) > 0
  UNION ALL SELECT 'imbalance', 3, 1, 0 FROM tshare WHERE s >= 0.7
  UNION ALL SELECT 'leakage', 3 - 1, 1, 1 FROM ov WHERE n > 0
  UNION ALL SELECT 'shift', 2, n, 0 FROM shiftn WHERE n > 0)"""


def _diagnosis(spark, d):
    rows = cp.dataset_findings(_split(spark, d, "train"), "linestatus", _split(spark, d, "val"), _split(spark, d, "production"))
    return cp.combined_diagnosis(rows, feature_available="yes")


@query("combined_diagnosis", sql(IT + "," + DIAGNOSIS, "SELECT * FROM diag", longs=["score", "support", "conflicts"]))
def _(spark, d):
    return _diagnosis(spark, d)


# answer -> arguments of combined_diagnosis
ANSWERS = {
    "available_no": {"feature_available": "no"},
    "comparable_no": {"comparable": "no"},
    "other_run": {"same_run": "no", "sources": ("datasets", "logs")},
    "other_run_alone": {"same_run": "no"},
}
ANSWERED = DIAGNOSIS + """,
plain AS (SELECT hypothesis, CASE WHEN hypothesis = 'leakage' THEN 3 ELSE score END AS score, support, 0 AS conflicts FROM diag),
answered AS (
  SELECT 'available_no' AS answer, hypothesis, score, support + (hypothesis = 'leakage')::INT AS support, 0 AS conflicts FROM plain
  UNION ALL SELECT 'comparable_no', hypothesis, score - (hypothesis <> 'leakage')::INT, support, (hypothesis <> 'leakage')::INT FROM plain
  UNION ALL SELECT 'other_run', hypothesis, score - 1, support, 1 FROM plain
  UNION ALL SELECT 'other_run_alone', hypothesis, score, support, 0 FROM plain
  UNION ALL SELECT 'feature_missing', hypothesis, score, support, 0 FROM plain WHERE hypothesis <> 'leakage')"""


@query("diagnosis_answers", sql(IT + "," + ANSWERED, "SELECT * FROM answered", longs=["score", "support", "conflicts"]))
def _(spark, d):
    """The diagnosis under each answer of the user, and with a validation split that lacks a training feature."""
    train, val, production = (_split(spark, d, s) for s in ("train", "val", "production"))
    rows = cut(cp.dataset_findings(train, "linestatus", val, production), "findings")
    narrow = cp.dataset_findings(train, "linestatus", val.drop("discount"), production)
    tables = {name: cp.combined_diagnosis(rows, **given) for name, given in ANSWERS.items()}
    tables["feature_missing"] = cp.combined_diagnosis(narrow)
    return reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("answer"), "*") for name, t in tables.items()])


@query(
    "rank_hypotheses",
    sql(IT + "," + DIAGNOSIS, "SELECT hypothesis, row_number() OVER (ORDER BY score DESC, hypothesis) AS position FROM diag", longs=["position"]),
)
def _(spark, d):
    # Four hypotheses at most: the position is taken over that handful of rows.
    ranked = cp.rank_hypotheses(_diagnosis(spark, d))
    return ranked.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "hypothesis"))).alias("h")).select(
        F.posexplode("h").alias("at", "e")
    ).select(F.col("e.hypothesis").alias("hypothesis"), (F.col("at") + 1).alias("position"))
