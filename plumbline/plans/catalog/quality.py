"""Profiles, comparisons, leakage screening and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import cells as c
from ...functions.times import utc_day, utc_timestamp
from ...operators import compare as cp
from ...operators import drift as dr
from ...operators import leakage as lk
from ...operators import quality as q
from ...operators import sketches as sk
from .. import frames as fr
from ..registry import query, sql

IT, RC, LK, EO = fr.SPLITS_SQL, fr.CELLS_SQL, fr.LEAKS_SQL, fr.EVAL_ORDERS_SQL

# --- cells ------------------------------------------------------------------------------------

GONE = "(x IS NULL OR lower(trim(x)) IN ('', 'null', 'na', 'nan', 'n/a'))"


def gone(col: str) -> str:
    return GONE.replace("x ", f"{col} ").replace("(x)", f"({col})")


NUM = "CASE WHEN regexp_full_match({0}, '(?i)[+-]?(\\d+\\.?\\d*|\\.\\d+)(e[+-]?\\d+)?') AND isfinite(TRY_CAST({0} AS DOUBLE)) THEN TRY_CAST({0} AS DOUBLE) END"


@query("p_missing", sql(RC, f"SELECT row_no, {gone('amount')} AS is_missing FROM raw_cells"))
def _(spark, d):
    return fr.raw_cells(spark, d).select("row_no", c.is_missing(F.col("amount")).alias("is_missing"))


@query(
    "p_sentinel",
    sql(RC, f"SELECT row_no, CASE WHEN amount IS NULL OR trim(amount) = '' THEN 'empty' WHEN {gone('amount')} THEN lower(trim(amount)) END AS form FROM raw_cells"),
)
def _(spark, d):
    return fr.raw_cells(spark, d).select("row_no", c.sentinel_form(F.col("amount")).alias("form"))


@query("p_decimal", sql(RC, f"SELECT row_no, {NUM.format('amount')} AS amount, {NUM.format('code')} AS code FROM raw_cells", ["amount", "code"]))
def _(spark, d):
    return fr.raw_cells(spark, d).select("row_no", *[c.decimal_value(F.col(x)).alias(x) for x in ("amount", "code")])


@query("p_label_domain", sql(RC, "SELECT row_no, status IN ('F', 'O') AS in_pair FROM raw_cells"))
def _(spark, d):
    return fr.raw_cells(spark, d).select("row_no", c.in_label_pair(F.col("status"), "F", "O").alias("in_pair"))


@query(
    "p_probability",
    sql(RC, f"SELECT row_no, coalesce({NUM.format('code')} BETWEEN 0 AND 1, false) AS is_probability FROM raw_cells"),
)
def _(spark, d):
    return fr.raw_cells(spark, d).select("row_no", c.is_probability(c.decimal_value(F.col("code"))).alias("is_probability"))


@query("f_strip_bom", sql("", "SELECT doc_id, trim(text, ' \t\n\r\f' || chr(11) || chr(160) || chr(65279)) AS text FROM documents"))
def _(spark, d):
    text = F.concat(F.lit("﻿  "), F.col("text"), F.lit(" \n"))
    return fr.table(spark, d, "documents").select("doc_id", c.strip_bom(text).alias("text"))


STEM = "regexp_replace(regexp_extract({0}, '([^/\\\\]*)$', 1), '(?s)^(.+)\\.[^.]*$', '\\1')"


@query(
    "f_stem",
    sql("", f"SELECT page_id, {STEM.format('url')} AS url_stem, {STEM.format(chr(39) + '.conf' + chr(39) + ' || page_id')} AS dot_stem FROM pages"),
)
def _(spark, d):
    dotted = F.concat(F.lit(".conf"), F.col("page_id").cast("string"))
    return fr.table(spark, d, "pages").select(
        "page_id", c.file_stem(F.col("url")).alias("url_stem"), c.file_stem(dotted).alias("dot_stem")
    )


UTC = "TRY_CAST(CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{1,3}})?Z') THEN left({0}, length({0}) - 1) END AS TIMESTAMP)"


@query(
    "f_utc_ts",
    sql(LK, f"SELECT order_id, epoch_ms({UTC.format('predicted_at')}) AS predicted_ms, epoch_ms({UTC.format('outcome_at')}) AS outcome_ms FROM leaks"),
)
def _(spark, d):
    base = F.lit("1970-01-01").cast("timestamp_ntz")
    ms = lambda x: F.timestamp_diff("MILLISECOND", base, utc_timestamp(F.col(x)))
    return fr.leaks(spark, d).select("order_id", ms("predicted_at").alias("predicted_ms"), ms("outcome_at").alias("outcome_ms"))


@query("f_utc_day", sql(LK, f"SELECT order_id, strftime({UTC.format('outcome_at')}, '%Y-%m-%d') AS outcome_day FROM leaks"))
def _(spark, d):
    return fr.leaks(spark, d).select("order_id", utc_day(F.col("outcome_at")).alias("outcome_day"))


@query(
    "f_clamp",
    sql(IT, "SELECT line_id, price, greatest(1000, least(50000, price)) AS clamped FROM items", ["price", "clamped"]),
)
def _(spark, d):
    return fr.items(spark, d).select("line_id", "price", c.clamp(F.col("price"), 1000, 50000).alias("clamped"))


@query("f_delta_pp", sql(IT, "SELECT line_id, (discount - tax) * 100 AS delta_pp FROM items", ["delta_pp"]))
def _(spark, d):
    return fr.items(spark, d).select("line_id", c.delta_points(F.col("discount"), F.col("tax")).alias("delta_pp"))


@query("f_safe_divide", sql(IT, "SELECT line_id, price / nullif(tax, 0) AS ratio, CASE WHEN tax = 0 THEN 'zero denominator' END AS reason FROM items", ["ratio"]))
def _(spark, d):
    ratio = c.safe_ratio(F.col("price"), F.col("tax"))
    return fr.items(spark, d).select("line_id", ratio.alias("ratio"), F.when(ratio.isNull(), "zero denominator").alias("reason"))


@query(
    "f_percent",
    sql(
        "",
        """SELECT event_id, CASE WHEN event_id % 2 = 0 AND event_type <> 'error' THEN value / 100 ELSE value END AS scaled FROM events""",
        ["scaled"],
    ),
)
def _(spark, d):
    e = fr.table(spark, d, "events")
    return e.select(
        "event_id", c.scaled_percent(F.col("value"), F.col("event_id") % 2 == 0, F.col("event_type") != "error").alias("scaled")
    )


@query(
    "f_bin_label",
    sql(
        "",
        """SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN 'Balance [min to 0.00]' WHEN s_acctbal >= 9000 THEN 'Balance [> 9000.00]'
             ELSE format('Balance [{:.2f} to {:.2f}]', floor(s_acctbal / 1000) * 1000, floor(s_acctbal / 1000) * 1000 + 1000) END AS label FROM supplier""",
    ),
)
def _(spark, d):
    low = F.floor(F.col("s_acctbal") / 1000).cast("double") * 1000
    low_edge = F.when(F.col("s_acctbal") >= 0, low)
    high_edge = F.when(F.col("s_acctbal") < 0, 0.0).when(F.col("s_acctbal") < 9000, low + 1000)
    return fr.table(spark, d, "supplier").select("s_suppkey", c.bin_label("Balance", low_edge, high_edge).alias("label"))


@query(
    "f_map_extras",
    sql(
        RC,
        """SELECT row_no, count(v) AS n_extras, string_agg(k || '=' || v, ';' ORDER BY k) AS extras
           FROM (SELECT row_no, unnest(['amount', 'code', 'status']) AS k, unnest([trim(amount), trim(code), trim(status)]) AS v FROM raw_cells)
           WHERE v IS NULL OR v <> '' GROUP BY row_no""",
    ),
)
def _(spark, d):
    df = fr.raw_cells(spark, d)
    extras = c.extras_map(df.columns, ["row_no"])
    text = F.array_join(F.array_sort(F.transform(F.map_entries(extras), lambda e: F.concat_ws("=", e.key, e.value))), ";")
    return df.select("row_no", F.size(extras).cast("long").alias("n_extras"), text.alias("extras"))


# --- profiles ---------------------------------------------------------------------------------

PROFILE_COLS = ["split", "quantity", "price", "discount", "tax", "returnflag", "linestatus"]
TEXT_CELLS = {"split": "split", "quantity": "CAST(quantity AS VARCHAR)", "price": "CAST(price AS VARCHAR)", "discount": "CAST(discount AS VARCHAR)",
              "tax": "CAST(tax AS VARCHAR)", "returnflag": "returnflag", "linestatus": "linestatus"}


def unpivoted(src: str, cols: list[str], where: str = "") -> str:
    parts = [f"SELECT '{x}' AS \"column\", {TEXT_CELLS[x]} AS cell FROM {src} {where}" for x in cols]
    return " UNION ALL ".join(parts)


PROFILE_SQL = """
{name} AS (SELECT "column", CASE WHEN count(cell) = 0 THEN 'empty' WHEN count(cell) = count(TRY_CAST(cell AS DOUBLE)) THEN 'numeric' ELSE 'categorical' END AS type,
  count(*) - count(cell) AS missing, count(cell) AS observed, count(DISTINCT cell) AS "distinct",
  CASE WHEN count(cell) = count(TRY_CAST(cell AS DOUBLE)) THEN min(TRY_CAST(cell AS DOUBLE)) END AS "min",
  CASE WHEN count(cell) = count(TRY_CAST(cell AS DOUBLE)) THEN max(TRY_CAST(cell AS DOUBLE)) END AS "max",
  CASE WHEN count(cell) = count(TRY_CAST(cell AS DOUBLE)) THEN avg(TRY_CAST(cell AS DECIMAL(30, 12))) END AS mean
  FROM ({cells}) GROUP BY 1)"""


def profile_cte(name: str, src: str, cols: list[str], where: str = "") -> str:
    return PROFILE_SQL.format(name=name, cells=unpivoted(src, cols, where))


PROFILE_DOUBLES = ['"min"', '"max"', "mean"]


@query("column_profile", sql(IT + "," + profile_cte("prof", "items", PROFILE_COLS), "SELECT * FROM prof", PROFILE_DOUBLES))
def _(spark, d):
    return q.column_profile(fr.items(spark, d), PROFILE_COLS)


@query(
    "top_values",
    sql(
        IT,
        f"""SELECT "column", value, n, rank FROM (SELECT "column", cell AS value, count(*) AS n, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, cell) AS rank
            FROM ({unpivoted('items', PROFILE_COLS)}) WHERE cell IS NOT NULL GROUP BY 1, 2) WHERE rank <= 5""",
    ),
)
def _(spark, d):
    return q.top_values(fr.items(spark, d), PROFILE_COLS)


WARN_SQL = """
wide AS (SELECT CAST(y_true AS VARCHAR) AS y_true, copied, order_id, priority, 'x' AS fixed, y_true AS duplicate FROM leaks)"""


def _warn_frame(spark, d):
    df = fr.leaks(spark, d)
    return df.select("y_true", "copied", "order_id", "priority", F.lit("x").alias("fixed"), F.col("y_true").alias("duplicate"))


@query(
    "column_warnings",
    sql(
        LK + "," + WARN_SQL,
        """SELECT 'fixed' AS "column", 'constant' AS warning FROM wide HAVING count(DISTINCT fixed) = 1
           UNION ALL SELECT 'order_id', 'unique_identifier' FROM wide HAVING count(DISTINCT order_id) = count(order_id)
           UNION ALL SELECT 'duplicate', 'target_copy' FROM wide HAVING bool_and(duplicate = y_true)
           UNION ALL SELECT 'copied', 'target_copy' FROM wide HAVING bool_and(copied = y_true)
           UNION ALL SELECT 'y_true', 'dominant_class' FROM wide HAVING greatest(count(*) FILTER (y_true = '1'), count(*) FILTER (y_true = '0')) >= 0.7 * count(*)""",
    ),
)
def _(spark, d):
    return q.column_warnings(_warn_frame(spark, d), "y_true")


@query(
    "class_balance",
    sql(
        "",
        """SELECT label, n, n::DOUBLE / sum(n) OVER () AS share, rank = 1 AS is_dominant, rank = 1 AND n >= 0.7 * sum(n) OVER () AS imbalanced
           FROM (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, quality) AS rank FROM labels GROUP BY quality)""",
        ["share"],
    ),
)
def _(spark, d):
    return q.class_balance(fr.table(spark, d, "labels"), "quality")


@query(
    "class_prevalence",
    sql("", "SELECT o_orderpriority AS label, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS prevalence FROM orders GROUP BY 1", ["prevalence"]),
)
def _(spark, d):
    return q.class_prevalence(fr.table(spark, d, "orders"), "o_orderpriority")


BREAKDOWN = f"""
marked AS (
  SELECT row_no, 'amount' AS "column", CASE WHEN amount IS NULL OR trim(amount) = '' THEN 'empty' WHEN {gone('amount')} THEN lower(trim(amount)) END AS form FROM raw_cells
  UNION ALL SELECT row_no, 'code', NULL FROM raw_cells UNION ALL SELECT row_no, 'status', NULL FROM raw_cells),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "column", form IS NULL ORDER BY row_no) AS k FROM marked)"""


@query(
    "missing_breakdown",
    sql(
        RC + "," + BREAKDOWN,
        """SELECT m."column", m.missing, m.present, coalesce(s.sentinels, '') AS sentinels, coalesce(f.missing_rows, '') AS missing_rows,
             coalesce(f.present_rows, '') AS present_rows, m.missing::DOUBLE / (m.missing + m.present) AS missing_rate
           FROM (SELECT "column", count(form) AS missing, count(*) - count(form) AS present FROM marked GROUP BY 1) m
           LEFT JOIN (SELECT "column", string_agg(form || ':' || n, ',' ORDER BY form || ':' || n) AS sentinels FROM (SELECT "column", form, count(*) AS n FROM marked WHERE form IS NOT NULL GROUP BY 1, 2) GROUP BY 1) s USING ("column")
           LEFT JOIN (SELECT "column", string_agg(row_no::VARCHAR, ',' ORDER BY row_no) FILTER (form IS NOT NULL AND k <= 10) AS missing_rows,
                             string_agg(row_no::VARCHAR, ',' ORDER BY row_no) FILTER (form IS NULL AND k <= 5) AS present_rows FROM ranked GROUP BY 1) f USING ("column")""",
        ["missing_rate"],
    ),
)
def _(spark, d):
    return q.missing_breakdown(fr.raw_cells(spark, d), "row_no")


@query(
    "repeated_rows",
    sql("", """SELECT sum(n)::BIGINT AS total, count(*) AS "unique", (sum(n) - count(*))::BIGINT AS repeated FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)"""),
)
def _(spark, d):
    return q.repeated_rows(fr.table(spark, d, "documents"), ["text", "lang"])


@query(
    "first_occurrence",
    sql("", "SELECT doc_id, first_row FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_row FROM documents) WHERE doc_id > first_row"),
)
def _(spark, d):
    return q.first_occurrence(fr.table(spark, d, "documents").select("doc_id", "text"), ["text"], "doc_id")


@query(
    "dedupe_first",
    sql("", "SELECT o_custkey, o_orderkey, rank = 1 AS kept FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders)"),
)
def _(spark, d):
    orders = fr.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    kept, dropped = q.dedupe_first(orders, "o_custkey", "o_orderkey")
    mark = lambda df, flag: df.select("o_custkey", "o_orderkey", F.lit(flag).alias("kept"))
    return mark(kept, True).unionByName(mark(dropped, False))


@query(
    "stride_sample",
    sql(
        "",
        """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
           WHERE pos IN (SELECT (i * (SELECT count(*) FROM orders)) // 997 FROM range(997) t(i))""",
    ),
)
def _(spark, d):
    return q.stride_sample(fr.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 997)


@query(
    "cap_lists",
    sql(RC, f"""SELECT row_no, amount, (SELECT count(*) FROM raw_cells WHERE {gone('amount')}) AS total FROM raw_cells WHERE {gone('amount')} ORDER BY row_no LIMIT 50"""),
)
def _(spark, d):
    bad = fr.raw_cells(spark, d).filter(c.is_missing(F.col("amount"))).select("row_no", "amount")
    return q.cap_list(bad, 50, ["row_no"])


@query(
    "split_distribution",
    sql(IT, "SELECT split, count(*) AS n FROM items GROUP BY 1"),
)
def _(spark, d):
    return fr.items(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


ROLES = """VALUES ('row_id', 'unknown'), ('y_true', 'target'), ('y_pred', 'prediction'), ('y_probability', 'probability'),
 ('site', 'metadata'), ('environment', 'metadata'), ('feature_price', 'feature')"""


def _role_frame(spark, d):
    ev = fr.eval_orders(spark, d)
    return ev.select("row_id", "y_true", "y_pred", "y_probability", "site", "environment", F.col("price").alias("feature_price"))


@query(
    "p_column_role",
    sql(
        EO + """,
cellset AS (SELECT unnest(['row_id', 'y_true', 'y_pred', 'y_probability', 'site', 'environment', 'feature_price']) AS "column",
   unnest([row_id::VARCHAR, y_true, y_pred, y_probability::VARCHAR, site, CASE WHEN environment <> 'n/a' THEN environment END, price::VARCHAR]) AS cell FROM eval_orders),
roles AS (""" + ROLES + ")",
        """SELECT r.col0 AS "column", r.col1 AS role, CASE WHEN r.col0 IN ('row_id', 'y_probability', 'feature_price') THEN 'numeric' ELSE 'categorical' END AS type,
             count(*) - count(cell) AS missing, count(DISTINCT cell) AS "distinct"
           FROM roles r JOIN cellset c ON r.col0 = c."column" GROUP BY ALL""",
    ),
)
def _(spark, d):
    return q.column_roles(_role_frame(spark, d))


NAMES_SQL = """
names AS (SELECT p_partkey, lower(replace(p_name, ' ', '_')) || CASE p_partkey % 6 WHEN 0 THEN '_id' WHEN 1 THEN '_uuid' WHEN 2 THEN '_future'
  WHEN 3 THEN '_post_outcome_x' WHEN 4 THEN '' ELSE 'id' END AS column_name FROM part)"""


def _names(spark, d):
    k = F.col("p_partkey") % 6
    tail = F.when(k == 0, "_id").when(k == 1, "_uuid").when(k == 2, "_future").when(k == 3, "_post_outcome_x").when(k == 4, "").otherwise("id")
    name = F.concat(F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))), tail)
    return fr.table(spark, d, "part").select("p_partkey", name.alias("column_name"))


@query(
    "p_name_heuristics",
    sql(
        NAMES_SQL,
        """SELECT p_partkey, column_name, regexp_matches(column_name, '(?i)(^id$|_id$|uuid)') AS id_like,
             regexp_matches(column_name, '(?i)(^|_)(post_outcome|after_outcome|future|final_diagnosis|outcome_result)(_|$)') AS post_outcome,
             regexp_matches(column_name, '(?i)^(label|class|target|stroke|survived|churn|fraud|outcome|y_true|default)$') AS label_name FROM names""",
    ),
)
def _(spark, d):
    name = F.col("column_name")
    return _names(spark, d).select(
        "p_partkey",
        name,
        name.rlike(q.ID_NAME).alias("id_like"),
        name.rlike(lk.POST_OUTCOME_NAME).alias("post_outcome"),
        name.rlike(q.LABEL_NAME).alias("label_name"),
    )


@query(
    "profile_dataset",
    sql(
        EO + """,
cellset AS (SELECT unnest(['y_true', 'y_probability', 'site']) AS "column", unnest([y_true, y_probability::VARCHAR, site]) AS cell FROM eval_orders)""",
        """SELECT 'column' AS section, "column" AS name, CASE WHEN "column" = 'y_probability' THEN 'numeric' ELSE 'categorical' END AS kind, count(DISTINCT cell) AS n,
             CASE WHEN "column" = 'y_probability' THEN avg(TRY_CAST(cell AS DECIMAL(30, 12))) END AS value FROM cellset GROUP BY "column"
           UNION ALL SELECT 'class', y_true, 'prevalence', count(*), count(*)::DOUBLE / sum(count(*)) OVER () FROM eval_orders GROUP BY y_true""",
        ["value"],
    ),
)
def _(spark, d):
    ev = fr.eval_orders(spark, d).select("y_true", "y_probability", "site")
    roles = q.column_roles(ev).join(q.column_profile(ev).select("column", "mean"), "column")
    columns = roles.select(
        F.lit("column").alias("section"),
        F.col("column").alias("name"),
        F.col("type").alias("kind"),
        F.col("distinct").alias("n"),
        F.when(F.col("type") == "numeric", F.col("mean")).alias("value"),
    )
    classes = q.class_prevalence(ev, "y_true").select(
        F.lit("class").alias("section"), F.col("label").alias("name"), F.lit("prevalence").alias("kind"), "n", F.col("prevalence").alias("value")
    )
    return columns.unionByName(classes)


# --- comparing splits ---------------------------------------------------------------------------

FEATURES = list(fr.SPLIT_FEATURES)
SPLIT_COLS = FEATURES + ["linestatus"]
BOTH = (
    IT + "," + profile_cte("pa", "items", SPLIT_COLS, "WHERE split = 'train'") + "," + profile_cte("pb", "items", SPLIT_COLS, "WHERE split = 'production'")
)


def _sides(spark, d):
    return fr.split_of(spark, d, "train"), fr.split_of(spark, d, "production")


OVERLAP_COLS = ["quantity", "tax", "returnflag", "discount"]


@query(
    "j_feature_overlap",
    sql(
        IT,
        """SELECT count(*) FILTER (EXISTS (SELECT 1 FROM items t WHERE t.split = 'train' AND t.quantity IS NOT DISTINCT FROM p.quantity AND t.tax IS NOT DISTINCT FROM p.tax
             AND t.returnflag IS NOT DISTINCT FROM p.returnflag AND t.discount IS NOT DISTINCT FROM p.discount)) AS overlap, count(*) AS n FROM items p WHERE split = 'production'""",
    ),
)
def _(spark, d):
    return cp.feature_overlap(*_sides(spark, d), OVERLAP_COLS)


@query(
    "j_schema_diff",
    sql(
        "",
        """SELECT 'o_orderpriority' AS "column", 'missing' AS side, count(o_orderpriority) AS cells FROM orders
           UNION ALL SELECT 'o_totalprice', 'missing', count(o_totalprice) FROM orders
           UNION ALL SELECT 'o_custkey', 'missing', count(o_custkey) FROM orders
           UNION ALL SELECT 'l_tax', 'additional', count(l_tax) FROM lineitem""",
    ),
)
def _(spark, d):
    orders = fr.table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey", "o_totalprice", "o_orderpriority")
    lines = fr.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_tax")
    return cp.schema_diff(orders, lines)


@query(
    "column_except",
    sql("", """SELECT 'c_acctbal' AS "column", count(c_acctbal) AS cells FROM customer UNION ALL SELECT 'c_mktsegment', count(c_mktsegment) FROM customer"""),
)
def _(spark, d):
    customers = fr.table(spark, d, "customer").select(F.col("c_name").alias("name"), "c_acctbal", "c_mktsegment")
    suppliers = fr.table(spark, d, "supplier").select(F.col("s_name").alias("name"))
    return cp.column_except(customers, suppliers)


@query(
    "j_unseen_values",
    sql(
        IT,
        """SELECT * FROM (SELECT 'returnflag' AS "column", count(*) FILTER (returnflag NOT IN (SELECT returnflag FROM items WHERE split = 'train')) AS unseen,
             count(returnflag) AS observed FROM items WHERE split = 'production') WHERE unseen > 0""",
    ),
)
def _(spark, d):
    return cp.unseen_values(*_sides(spark, d), SPLIT_COLS)


SHARE_SQL = """
sa AS (SELECT linestatus AS label, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM items WHERE split = 'train' GROUP BY 1),
sb AS (SELECT linestatus AS label, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM items WHERE split = 'production' GROUP BY 1),
moved AS (SELECT coalesce(sa.label, sb.label) AS label, coalesce(sb.s, 0) - coalesce(sa.s, 0) AS delta FROM sa FULL JOIN sb ON sa.label = sb.label)"""


@query("j_class_share", sql(IT + "," + SHARE_SQL, "SELECT * FROM moved WHERE abs(delta) >= 0.1 ORDER BY abs(delta) DESC, label", ["delta"]))
def _(spark, d):
    return cp.class_share(*_sides(spark, d), "linestatus")


def _compared(spark, d):
    return cp.profile_compare(*_sides(spark, d), SPLIT_COLS)


@query(
    "j_profile_compare",
    sql(
        BOTH,
        """SELECT "column", pa.type AS type_train, pb.type AS type_other, pa.missing AS missing_train, pb.missing AS missing_other,
             pa."distinct" AS distinct_train, pb."distinct" AS distinct_other, pa."min" AS min_train, pb."min" AS min_other,
             pa."max" AS max_train, pb."max" AS max_other, pa.mean AS mean_train, pb.mean AS mean_other FROM pa JOIN pb USING ("column")""",
        ["min_train", "min_other", "max_train", "max_other", "mean_train", "mean_other"],
    ),
)
def _(spark, d):
    return _compared(spark, d).drop("observed_train", "observed_other")


@query(
    "missing_shift",
    sql(
        BOTH,
        """SELECT * FROM (SELECT "column", 100 * (pb.missing::DOUBLE / (pb.missing + pb.observed) - pa.missing::DOUBLE / (pa.missing + pa.observed)) AS delta_pp
           FROM pa JOIN pb USING ("column")) WHERE abs(delta_pp) >= 10""",
        ["delta_pp"],
    ),
)
def _(spark, d):
    return cp.missing_shift(_compared(spark, d))


@query(
    "mean_shift",
    sql(
        BOTH,
        """SELECT "column", pa.mean AS mean_train, pb.mean AS mean_other, abs(pb.mean - pa.mean) > greatest((pa."max" - pa."min") * 0.2, 1e-12) AS flagged
           FROM pa JOIN pb USING ("column") WHERE pa.mean IS NOT NULL AND pb.mean IS NOT NULL""",
        ["mean_train", "mean_other"],
    ),
)
def _(spark, d):
    return cp.mean_shift(_compared(spark, d))


# --- leakage ------------------------------------------------------------------------------------

FEATS = list(fr.LEAK_FEATURES)
FACTS = (
    """
fv AS (SELECT y_true, unnest(['copied','nearly','order_id','priority','future_status','nothing','cohort']) AS feature,
              unnest([CASE WHEN copied <> 'N/A' THEN copied END, nearly, order_id, priority, future_status, nothing, cohort]) AS value FROM leaks),
groups AS (SELECT feature, value, count(*) FILTER (y_true = '1') AS p, count(*) FILTER (y_true = '0') AS ng FROM fv WHERE value IS NOT NULL GROUP BY 1, 2),
gstat AS (SELECT feature, count(*) AS dist, min(p + ng) AS rarest, sum(greatest(p, ng))::BIGINT AS mapped FROM groups GROUP BY 1),
facts AS (SELECT f.feature, count(f.value) AS n, count(*) - count(f.value) AS missing, count(*) FILTER (f.value IS NOT NULL AND y_true = '1') AS pos,
            count(*) FILTER (f.value IS NOT NULL AND y_true = '0') AS neg, count(*) FILTER (f.value = y_true) AS copies,
            coalesce(any_value(g.dist), 0) AS dist, any_value(g.rarest) AS rarest, coalesce(any_value(g.mapped), 0) AS mapped
          FROM fv f LEFT JOIN gstat g ON f.feature = g.feature GROUP BY 1)"""
)
EXACT = "(n >= 3 AND copies = n)"
ENOUGH = "(n >= 20 AND pos >= 5 AND neg >= 5)"
NEAR = f"(NOT {EXACT} AND {ENOUGH} AND copies * 100 >= 95 * n)"
UNIQ = "(dist = n AND n >= 3 AND regexp_matches(feature, '(?i)((^|_)id$|uuid|identifier)'))"
POST = "regexp_matches(feature, '(?i)(^|_)(post_outcome|after_outcome|future|final_diagnosis|outcome_result)(_|$)')"
PROXY = f"coalesce({ENOUGH} AND dist BETWEEN 2 AND 20 AND rarest >= 2 AND mapped * 100 >= 95 * n AND (mapped - greatest(pos, neg)) * 10 >= n, false)"


def _facts(spark, d):
    return lk.feature_facts(lk.feature_values(fr.leaks(spark, d), FEATS))


@query("leak_complete_pairs", sql(LK + "," + FACTS, "SELECT feature, n AS complete, missing, n = 0 AS all_missing FROM facts"))
def _(spark, d):
    return lk.complete_pairs(_facts(spark, d))


@query("leak_exact_copy", sql(LK + "," + FACTS, f"SELECT feature, {EXACT} AS flag, {EXACT} AND pos > 0 AND neg > 0 AS suspicion FROM facts"))
def _(spark, d):
    return lk.exact_copy(_facts(spark, d))


@query("leak_near_copy", sql(LK + "," + FACTS, f'SELECT feature, copies::DOUBLE / nullif(n, 0) AS "match", {NEAR} AS flag FROM facts', ['"match"']))
def _(spark, d):
    return lk.near_copy(_facts(spark, d))


@query("leak_unique_id", sql(LK + "," + FACTS, f"SELECT feature, {UNIQ} AS flag FROM facts"))
def _(spark, d):
    return lk.unique_id(_facts(spark, d))


@query("leak_post_outcome_name", sql(NAMES_SQL, f"SELECT column_name, {POST.replace('feature', 'column_name')} AS flag FROM names"))
def _(spark, d):
    return lk.post_outcome_name(_names(spark, d), "column_name")


@query(
    "leak_category_proxy",
    sql(LK + "," + FACTS, f"SELECT feature, mapped::DOUBLE / nullif(n, 0) AS purity, greatest(pos, neg)::DOUBLE / nullif(n, 0) AS baseline, {PROXY} AS flag FROM facts", ["purity", "baseline"]),
)
def _(spark, d):
    return lk.category_proxy(_facts(spark, d))


@query(
    "leak_temporal",
    sql(
        LK + f""", t AS (SELECT {gone('predicted_at')} OR {gone('outcome_at')} AS gone, {UTC.format('predicted_at')} AS p, {UTC.format('outcome_at')} AS o FROM leaks)""",
        """SELECT count(*) FILTER (NOT gone AND p IS NOT NULL AND o IS NOT NULL) AS valid, count(*) FILTER (gone) AS missing,
             count(*) FILTER (NOT gone AND (p IS NULL OR o IS NULL)) AS invalid, count(*) FILTER (NOT gone AND o <= p) AS reversed FROM t""",
    ),
)
def _(spark, d):
    return lk.temporal_order(fr.leaks(spark, d), "predicted_at", "outcome_at")


@query(
    "scan_feature_leakage",
    sql(
        LK + "," + FACTS,
        f"""SELECT feature, n, missing, classification, method FROM (
              SELECT *, 'observation' AS classification, 'no_complete_pairs' AS method, n = 0 AS hit FROM facts UNION ALL
              SELECT *, 'observation', 'exact_target_copy', {EXACT} FROM facts UNION ALL
              SELECT *, 'suspicion', 'target_copy_review', {EXACT} AND pos > 0 AND neg > 0 FROM facts UNION ALL
              SELECT *, 'suspicion', 'near_target_copy', {NEAR} FROM facts UNION ALL
              SELECT *, 'suspicion', 'unique_identifier', {UNIQ} FROM facts UNION ALL
              SELECT *, 'suspicion', 'post_outcome_name', n > 0 AND {POST} FROM facts UNION ALL
              SELECT *, 'suspicion', 'categorical_target_proxy', {PROXY} FROM facts) WHERE hit""",
    ),
)
def _(spark, d):
    return lk.scan(fr.leaks(spark, d), FEATS)


# --- drift ----------------------------------------------------------------------------------------

NUMERIC = ["quantity", "price", "discount", "tax"]
DRIFT = """
pts AS (SELECT split = 'train' AS is_ref, unnest(['quantity','price','discount','tax']) AS feature, unnest([quantity, price, discount, tax]) AS v
        FROM items WHERE split IN ('train', 'production')),
num AS (SELECT * FROM pts WHERE v IS NOT NULL),
sizes AS (SELECT feature, count(*) FILTER (is_ref) AS n_ref, count(*) FILTER (NOT is_ref) AS n_comp, min(v) FILTER (is_ref) AS lo, max(v) FILTER (is_ref) AS hi FROM num GROUP BY 1),
steps AS (SELECT feature, v, count(*) FILTER (is_ref) AS a, count(*) FILTER (NOT is_ref) AS b FROM num GROUP BY 1, 2),
walk AS (SELECT s.feature, v, lead(v) OVER w AS nxt, abs(sum(a) OVER w / n_ref::DOUBLE - sum(b) OVER w / n_comp::DOUBLE) AS gap, n_ref, n_comp
         FROM steps s JOIN sizes z ON s.feature = z.feature WINDOW w AS (PARTITION BY s.feature ORDER BY v))"""
FLAGROW = """ UNION ALL SELECT 'returnflag', NULL, count(*) FILTER (split = 'train'), count(*) FILTER (split = 'production'), 'not numeric' FROM items"""


@query(
    "ks_stat",
    sql(IT + "," + DRIFT, "SELECT feature, max(gap) AS d, any_value(n_ref) AS n_ref, any_value(n_comp) AS n_comp, NULL::VARCHAR AS reason FROM walk GROUP BY 1" + FLAGROW, ["d"]),
)
def _(spark, d):
    return dr.ks_stat(*_sides(spark, d), FEATURES)


@query(
    "wasserstein1",
    sql(IT + "," + DRIFT, "SELECT feature, sum(gap * (nxt - v)) AS w, any_value(n_ref) AS n_ref, any_value(n_comp) AS n_comp, NULL::VARCHAR AS reason FROM walk GROUP BY 1" + FLAGROW, ["w"]),
)
def _(spark, d):
    return dr.wasserstein1(*_sides(spark, d), FEATURES)


# The sketch modes: the sample sizes are exact, and whether the distance keeps its bound must be true.
NUMBERS = ["quantity", "price", "discount", "tax"]
KEPT = "SELECT feature, any_value(n_ref) AS n_ref, any_value(n_comp) AS n_comp, true AS within FROM walk GROUP BY 1"


def _beside_exact(spark, d, distance, value, scale):
    ref, comp = _sides(spark, d)
    exact = distance(ref, comp, NUMBERS).select("feature", F.col(value).alias("exact"))
    found = distance(ref, comp, NUMBERS, approx=True).join(exact, "feature")
    bound = 2 * (sk.rank_error() + 1 / sk.STEPS)
    if scale:
        ranges = sk.number_sketches(ref.select(*NUMBERS).unionByName(comp.select(*NUMBERS)), NUMBERS).select("feature", (F.col("high") - F.col("low")).alias("range"))
        found = found.join(ranges, "feature")
    width = F.col("range") if scale else F.lit(1.0)
    return found.select("feature", "n_ref", "n_comp", (F.abs(F.col(value) - F.col("exact")) <= width * bound).alias("within"))


@query("ks_stat_sketch", sql(IT + "," + DRIFT, KEPT))
def _(spark, d):
    return _beside_exact(spark, d, dr.ks_stat, "d", False)


@query("wasserstein1_sketch", sql(IT + "," + DRIFT, KEPT))
def _(spark, d):
    return _beside_exact(spark, d, dr.wasserstein1, "w", True)


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]


@query(
    "distinct_sketch",
    sql("", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, count(DISTINCT {c}) AS exact, true AS within FROM lineitem" for c in LINE_COLUMNS)),
)
def _(spark, d):
    lines = fr.table(spark, d, "lineitem")
    found = sk.distinct_counts(sk.distinct_sketches(lines, LINE_COLUMNS, ["l_linestatus"]))  # a sketch per status, then their union
    exact = lines.agg(*[F.count_distinct(c).alias(c) for c in LINE_COLUMNS]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("exact")) for c in LINE_COLUMNS])))
    off = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * (3 * sk.hll_error()) + 1
    return found.join(exact, "feature").select("feature", "n", "exact", off.alias("within"))


@query(
    "unseen_sketch",
    sql(
        IT,
        """SELECT 'price' AS feature, count(DISTINCT price) AS seen, count(DISTINCT price) FILTER (price NOT IN (SELECT price FROM items WHERE split = 'train' AND price IS NOT NULL)) AS unseen,
             true AS within FROM items WHERE split = 'production'""",
    ),
)
def _(spark, d):
    ref, comp = _sides(spark, d)
    found = sk.unseen_estimates(sk.value_sketches(ref, ["price"]), sk.value_sketches(comp, ["price"])).select("feature", F.col("seen").alias("about"), F.col("unseen").alias("missing"))
    there = lambda df: df.where("price IS NOT NULL").select("price").distinct()
    both = there(comp).withColumn("here", F.lit(1)).join(there(ref).withColumn("known", F.lit(1)), "price", "full")
    exact = both.agg(F.count("here").alias("seen"), F.count_if(F.col("known").isNull()).alias("unseen"), F.count("*").alias("all"))
    joined = exact.select(F.lit("price").alias("feature"), "*").join(found, "feature")
    slack = F.col("all") * (3 * sk.theta_error()) + 1
    within = (F.abs(F.col("about") - F.col("seen")) <= slack) & (F.abs(F.col("missing") - F.col("unseen")) <= slack)
    return joined.select("feature", "seen", "unseen", within.alias("within"))


PSI_NUM = """
bins AS (SELECT n.feature, is_ref, (SELECT count(*) FROM range(1, 10) t(i) WHERE z.lo * (1 - i / 10.0::DOUBLE) + z.hi * (i / 10.0::DOUBLE) <= n.v) AS bin
         FROM num n JOIN sizes z ON n.feature = z.feature),
hist AS (SELECT z.feature, g.bin, any_value(z.n_ref) AS n_ref, any_value(z.n_comp) AS n_comp,
                count(*) FILTER (b.is_ref) AS a, count(*) FILTER (NOT b.is_ref) AS b
         FROM sizes z CROSS JOIN range(10) g(bin) LEFT JOIN bins b ON b.feature = z.feature AND b.bin = g.bin GROUP BY 1, 2),
psin AS (SELECT feature, sum(((b + .5) / (n_comp + 5.0) - (a + .5) / (n_ref + 5.0)) * ln(((b + .5) / (n_comp + 5.0)) / ((a + .5) / (n_ref + 5.0))))::DOUBLE AS psi FROM hist GROUP BY 1)"""
PSI_CAT = """
cats AS (SELECT returnflag AS c, count(*) FILTER (split = 'train') AS a, count(*) FILTER (split = 'production') AS b FROM items WHERE split IN ('train', 'production') GROUP BY 1),
catn AS (SELECT *, sum(a) OVER () AS n_ref, sum(b) OVER () AS n_comp, count(*) OVER () AS k FROM cats),
psic AS (SELECT 'returnflag' AS feature, sum(((b + .5) / (n_comp + .5 * k) - (a + .5) / (n_ref + .5 * k)) * ln(((b + .5) / (n_comp + .5 * k)) / ((a + .5) / (n_ref + .5 * k))))::DOUBLE AS psi FROM catn)"""


@query("psi_numeric", sql(IT + "," + DRIFT + "," + PSI_NUM, "SELECT feature, 'numeric' AS kind, psi, NULL::VARCHAR AS reason FROM psin", ["psi"]))
def _(spark, d):
    return dr.psi(*_sides(spark, d), NUMERIC, 10)


@query("psi_categorical", sql(IT + "," + PSI_CAT, "SELECT feature, 'categorical' AS kind, psi, NULL::VARCHAR AS reason FROM psic", ["psi"]))
def _(spark, d):
    return dr.psi(*_sides(spark, d), ["returnflag"], 10)


@query(
    "run_drift_tests",
    sql(
        IT + "," + DRIFT + "," + PSI_NUM + "," + PSI_CAT,
        """SELECT feature, 'psi' AS method, psi AS value FROM psin UNION ALL SELECT feature, 'psi', psi FROM psic
           UNION ALL SELECT feature, 'ks', max(gap) FROM walk GROUP BY 1 UNION ALL SELECT feature, 'wasserstein', sum(gap * (nxt - v)) FROM walk GROUP BY 1
           UNION ALL SELECT 'returnflag', 'ks', NULL UNION ALL SELECT 'returnflag', 'wasserstein', NULL""",
        ["value"],
    ),
)
def _(spark, d):
    ref, comp = _sides(spark, d)
    psi = dr.psi(ref, comp, FEATURES, 10).select("feature", F.lit("psi").alias("method"), F.col("psi").alias("value"))
    both = dr.ecdf_distances(ref, comp, FEATURES)
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(v).alias("value")) for m, v in (("ks", "ks"), ("wasserstein", "w1"))])
    return psi.unionByName(both.select("feature", F.inline(rows)))


@query(
    "psi_config",
    sql(
        IT + "," + DRIFT,
        """SELECT feature, 'numeric' AS kind, lo * (1 - i / 10.0::DOUBLE) + hi * (i / 10.0::DOUBLE) AS cut, NULL::VARCHAR AS category FROM sizes, range(1, 10) t(i)
           UNION ALL SELECT 'returnflag', 'categorical', NULL, returnflag FROM (SELECT DISTINCT returnflag FROM items WHERE split IN ('train', 'production'))""",
        ["cut"],
    ),
)
def _(spark, d):
    return dr.psi_config(*_sides(spark, d), FEATURES, 10)


@query("union_categories", sql(IT, "SELECT DISTINCT returnflag AS category FROM items WHERE split IN ('train', 'production')"))
def _(spark, d):
    return dr.categories_of(*_sides(spark, d), "returnflag")


def _datasets(spark, d):
    hit = F.col("linestatus") == "F"
    out = {}
    for name in ("train", "val", "production"):
        out[name] = fr.split_of(spark, d, name).select(
            *FEATURES, F.when(hit, "1").otherwise("0").alias("y_true"), F.when(F.col("quantity") > 25, "1").otherwise("0").alias("y_pred")
        )
    return out


REVIEW = """
ds AS (SELECT * FROM (VALUES ('train', 1), ('val', 2), ('production', 3)) v(name, pos)),
dpairs AS (SELECT a.name AS ref, b.name AS comp FROM ds a JOIN ds b ON a.pos < b.pos),
vals AS (SELECT split, unnest(['quantity','price','discount','tax']) AS feature, unnest([quantity, price, discount, tax]) AS v FROM items),
rows AS (SELECT p.ref, p.comp, feature, split = p.ref AS is_ref, v FROM vals JOIN dpairs p ON split IN (p.ref, p.comp) WHERE v IS NOT NULL),
sz AS (SELECT ref, comp, feature, count(*) FILTER (is_ref) AS n_ref, count(*) FILTER (NOT is_ref) AS n_comp, min(v) FILTER (is_ref) AS lo, max(v) FILTER (is_ref) AS hi FROM rows GROUP BY ALL),
bn AS (SELECT r.ref, r.comp, r.feature, is_ref, (SELECT count(*) FROM range(1, 10) t(i) WHERE lo * (1 - i / 10.0::DOUBLE) + hi * (i / 10.0::DOUBLE) <= v) AS bin FROM rows r JOIN sz USING (ref, comp, feature)),
hs AS (SELECT z.ref, z.comp, z.feature, g.bin, any_value(n_ref) AS n_ref, any_value(n_comp) AS n_comp, count(*) FILTER (is_ref) AS a, count(*) FILTER (NOT is_ref) AS b
       FROM sz z CROSS JOIN range(10) g(bin) LEFT JOIN bn ON bn.ref = z.ref AND bn.comp = z.comp AND bn.feature = z.feature AND bn.bin = g.bin GROUP BY ALL),
ps AS (SELECT ref, comp, feature, sum(((b + .5) / (n_comp + 5.0) - (a + .5) / (n_ref + 5.0)) * ln(((b + .5) / (n_comp + 5.0)) / ((a + .5) / (n_ref + 5.0)))) AS psi FROM hs GROUP BY ALL),
wrd AS (SELECT p.ref, p.comp, returnflag, count(*) FILTER (split = p.ref) AS a, count(*) FILTER (split = p.comp) AS b FROM items JOIN dpairs p ON split IN (p.ref, p.comp) GROUP BY ALL),
wn AS (SELECT *, sum(a) OVER w AS n_ref, sum(b) OVER w AS n_comp, count(*) OVER w AS k FROM wrd WINDOW w AS (PARTITION BY ref, comp)),
allpsi AS (SELECT ref, comp, psi FROM ps UNION ALL
  SELECT ref, comp, sum(((b + .5) / (n_comp + .5 * k) - (a + .5) / (n_ref + .5 * k)) * ln(((b + .5) / (n_comp + .5 * k)) / ((a + .5) / (n_ref + .5 * k)))) FROM wn GROUP BY 1, 2),
acc AS (SELECT split, avg(CASE WHEN (linestatus = 'F') = (quantity > 25) THEN 1.0 ELSE 0.0 END) AS acc FROM items GROUP BY 1),
review AS (SELECT ref, comp, 'max_psi' AS kind, max(psi)::DOUBLE AS value FROM allpsi GROUP BY 1, 2 UNION ALL
  SELECT ref, comp, 'accuracy_gap', a.acc - b.acc FROM dpairs JOIN acc a ON a.split = ref JOIN acc b ON b.split = comp)"""


@query(
    "dataset_pair_review",
    sql(
        IT + "," + REVIEW,
        """SELECT *, CASE WHEN value IS NULL THEN 'untested' WHEN kind = 'max_psi' AND value > 0.25 OR kind = 'accuracy_gap' AND abs(value) > 0.2 THEN 'critical'
             WHEN abs(value) > 0.1 THEN 'warning' ELSE 'healthy' END AS status FROM review""",
        ["value"],
    ),
)
def _(spark, d):
    return dr.dataset_pair_review(_datasets(spark, d), FEATURES)


@query(
    "j_dataset_pairs",
    sql(
        "ds AS (SELECT source, min(doc_id) AS pos FROM documents GROUP BY 1)",
        "SELECT a.source AS ref, b.source AS comp FROM ds a JOIN ds b ON a.pos < b.pos",
    ),
)
def _(spark, d):
    # The registered datasets are the document sources: a fixed list however many documents there are.
    names = fr.table(spark, d, "documents").groupBy(F.col("source").alias("dataset")).agg(F.min("doc_id").alias("position"))
    return dr.dataset_pairs(names)


@query(
    "alternative_review",
    sql(
        IT + "," + REVIEW,
        """SELECT 'class_imbalance' AS cause, CASE WHEN avg(CASE WHEN linestatus = 'F' THEN 1.0 ELSE 0 END) BETWEEN 0.35 AND 0.65 THEN 'insufficient_evidence' ELSE 'supported' END AS status
             FROM items WHERE split = 'production'
           UNION ALL SELECT 'covariate_shift', CASE WHEN (SELECT max(psi) FROM allpsi) > 0.25 THEN 'supported' ELSE 'weak_evidence' END
           UNION ALL SELECT 'overfitting', CASE WHEN (SELECT acc FROM acc WHERE split = 'train') - (SELECT acc FROM acc WHERE split = 'val') > 0.15 THEN 'supported' ELSE 'inconsistent_with_logs' END
           UNION ALL SELECT 'target_leakage', 'not_assessed'""",
    ),
)
def _(spark, d):
    from ...operators.metrics import confusion, rate_columns

    sets = _datasets(spark, d)
    rates = rate_columns()
    review = dr.dataset_pair_review(sets, FEATURES).filter(F.col("kind") == "max_psi").agg(F.max("value").alias("v"))
    accuracy = lambda name: confusion(sets[name]).select(rates["accuracy"][0].alias("a")).scalar()
    facts = confusion(sets["production"]).select(
        rates["positive_prevalence"][0].alias("positive_prevalence"),
        rates["accuracy"][0].alias("accuracy"),
        rates["balanced_accuracy"][0].alias("balanced_accuracy"),
        review.scalar().alias("max_psi"),
        accuracy("train").alias("train_accuracy"),
        accuracy("val").alias("eval_accuracy"),
        F.lit(None).cast("long").alias("suspicions"),
    )
    return dr.alternative_review(facts)
