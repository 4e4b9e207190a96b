"""Diagnostic frames derived from the driver tables, each with its SQL twin for the oracle.

Every frame is a lazy projection or join over whole tables; nothing is sampled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import average_hash
from ..functions.cells import predict


_SCHEMAS: dict[str, object] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table; its schema is read from the file footer once, not by every query."""
    path = f"{d}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


# --- evaluation rows over orders -------------------------------------------------------------

EVAL_ORDERS_SQL = """
eval_orders AS (
  SELECT o.o_orderkey AS row_id,
         CASE WHEN o.o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END AS y_true,
         CASE WHEN s.p >= 0.5 THEN '1' ELSE '0' END AS y_pred,
         s.p AS y_probability,
         c.c_mktsegment AS site,
         CASE WHEN o.o_orderstatus = 'P' THEN 'n/a' ELSE o.o_orderstatus END AS environment,
         'd' || CAST(c.c_nationkey AS VARCHAR) AS device,
         CASE WHEN o.o_orderpriority = '4-NOT SPECIFIED' AND o.o_orderstatus = 'O' THEN '2026-02-30T00:00:00Z'
              ELSE strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS "timestamp",
         o.o_totalprice AS price
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey,
       LATERAL (SELECT ((CASE WHEN o.o_orderpriority = '1-URGENT' THEN 350 ELSE 0 END)
                        + (o.o_orderkey * 7919 + o.o_custkey * 104729) % 651) / 1000.0::DOUBLE AS p) s
)"""


def eval_orders(spark: SparkSession, d: str) -> DataFrame:
    """A planted, deterministic score on every order; site, environment, device and time as metadata."""
    orders = table(spark, d, "orders")
    customers = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    score = (
        F.when(urgent, 350).otherwise(0) + (F.col("o_orderkey") * 7919 + F.col("o_custkey") * 104729) % 651
    ).cast("double") / F.lit(1000.0)
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    scored = joined.withColumn("y_probability", score)
    impossible = (F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "O")
    return scored.select(
        F.col("o_orderkey").alias("row_id"),
        F.when(urgent, "1").otherwise("0").alias("y_true"),
        predict(F.col("y_probability"), 0.5).alias("y_pred"),
        "y_probability",
        F.col("c_mktsegment").alias("site"),
        F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_orderstatus")).alias("environment"),
        F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("device"),
        F.when(impossible, "2026-02-30T00:00:00Z")
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .alias("timestamp"),
        F.col("o_totalprice").alias("price"),
    )


# --- evaluation rows over labelled documents -------------------------------------------------

EVAL_DOCS_SQL = """
eval_docs AS (
  SELECT l.doc_id AS row_id, CAST(l.quality AS VARCHAR) AS y_true,
         CASE WHEN least(1.0::DOUBLE, x.n_chars / 4000.0::DOUBLE) >= 0.02 THEN '1' ELSE '0' END AS y_pred,
         least(1.0::DOUBLE, x.n_chars / 4000.0::DOUBLE) AS y_probability,
         x.source AS site, x.lang AS "group", l.toxic AS toxic, x.n_chars AS n_chars
  FROM labels l JOIN documents x ON l.doc_id = x.doc_id
)"""


def eval_docs(spark: SparkSession, d: str) -> DataFrame:
    """Quality labels with document length as the score: real imbalance."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = table(spark, d, "labels").join(docs, "doc_id")
    scored = joined.withColumn("y_probability", F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0)))
    return scored.select(
        F.col("doc_id").alias("row_id"),
        F.col("quality").cast("string").alias("y_true"),
        predict(F.col("y_probability"), 0.02).alias("y_pred"),
        "y_probability",
        F.col("source").alias("site"),
        F.col("lang").alias("group"),
        F.col("toxic").cast("long").alias("toxic"),
        "n_chars",
    )


# --- train / validation / production splits --------------------------------------------------

# The splits overlap in nothing but values: each line item belongs to exactly one of them.
SPLITS_SQL = """
items AS (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1999-01-01' THEN 'train'
              WHEN l_shipdate < TIMESTAMP '2000-07-01' THEN 'val' ELSE 'production' END AS split,
         l_orderkey * 10 + l_linenumber AS line_id,
         l_quantity AS quantity,
         CASE WHEN l_shipdate >= TIMESTAMP '2000-07-01' THEN l_extendedprice * 1.5 ELSE l_extendedprice END AS price,
         CASE WHEN l_shipdate >= TIMESTAMP '2000-07-01' AND l_linenumber <= 2 THEN NULL ELSE l_discount END AS discount,
         l_tax AS tax,
         CASE WHEN l_shipdate >= TIMESTAMP '2000-07-01' AND l_linenumber = 3 THEN 'X' ELSE l_returnflag END AS returnflag,
         CASE WHEN l_shipdate >= TIMESTAMP '1999-01-01' AND l_linenumber <= 3 THEN 'F' ELSE l_linestatus END AS linestatus
  FROM lineitem
)"""

SPLIT_FEATURES = ("quantity", "price", "discount", "tax", "returnflag")


def items(spark: SparkSession, d: str) -> DataFrame:
    """Line items with a split by ship date and a planted shift of the later ones."""
    day = F.col("l_shipdate")
    val, prod = F.lit("1999-01-01").cast("timestamp_ntz"), F.lit("2000-07-01").cast("timestamp_ntz")
    day = day.cast("timestamp_ntz")
    late = day >= prod
    return table(spark, d, "lineitem").select(
        F.when(day < val, "train").when(day < prod, "val").otherwise("production").alias("split"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id"),
        F.col("l_quantity").alias("quantity"),
        F.when(late, F.col("l_extendedprice") * 1.5).otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(~(late & (F.col("l_linenumber") <= 2)), F.col("l_discount")).alias("discount"),
        F.col("l_tax").alias("tax"),
        F.when(late & (F.col("l_linenumber") == 3), "X").otherwise(F.col("l_returnflag")).alias("returnflag"),
        F.when((day >= val) & (F.col("l_linenumber") <= 3), "F").otherwise(F.col("l_linestatus")).alias("linestatus"),
    )


def split_of(spark: SparkSession, d: str, split: str) -> DataFrame:
    return items(spark, d).filter(F.col("split") == split).drop("split", "line_id")


# --- perceptual hashes over embeddings -------------------------------------------------------

HASHES_SQL = """
base_hash AS (
  SELECT vec_id, label,
         CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS hash
  FROM (SELECT vec_id, label,
               list_sum([CASE WHEN embedding[i + 1]::DOUBLE > m
                        THEN (1::HUGEINT << (63 - i)::INT) ELSE 0::HUGEINT END for i in range(64)]) AS h
        FROM (SELECT vec_id, label, embedding, list_avg(embedding::DOUBLE[]) AS m FROM embeddings))
),
hashes AS (
  SELECT vec_id AS id, hash, 'train' AS split, label FROM base_hash
  UNION ALL
  SELECT 1000000 + vec_id, xor(hash, CAST((1 << (vec_id % 9)::INT) - 1 AS BIGINT)),
         CASE WHEN vec_id % 10 = 0 THEN 'val' ELSE 'production' END, label
  FROM base_hash WHERE vec_id % 5 = 0
)"""


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Average hash of every embedding plus planted near copies at 0..8 bits in evaluation splits."""
    base = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), average_hash(F.col("embedding")).alias("hash"), F.col("label").cast("long").alias("label")
    )
    flips = F.expr("shiftleft(1L, cast(id % 9 as int)) - 1")
    copies = base.filter(F.col("id") % 5 == 0).select(
        (F.col("id") + 1000000).alias("id"),
        F.col("hash").bitwiseXOR(flips).alias("hash"),
        F.when(F.col("id") % 10 == 0, "val").otherwise("production").alias("split"),
        "label",
    )
    return base.select("id", "hash", F.lit("train").alias("split"), "label").unionByName(copies)


# --- image predictions over the same ids ------------------------------------------------------

PREDICTIONS_SQL = (
    HASHES_SQL
    + """,
preds AS (
  SELECT id, split, CASE WHEN label < 3 THEN 1 ELSE 0 END::BIGINT AS y_true,
         CASE WHEN (label < 3) <> ((id * 31 + label * 17) % 100 < CASE WHEN label % 2 = 1 THEN 35 ELSE 10 END)
              THEN 1 ELSE 0 END::BIGINT AS y_pred,
         ((id * 7919) % 1000) / 1000.0::DOUBLE AS y_probability,
         'site' || CAST(id % 3 AS VARCHAR) AS site, 'cam' || CAST(label % 4 AS VARCHAR) AS device,
         CASE WHEN id % 7 = 0 THEN NULL ELSE 'reader' || CAST(id % 2 AS VARCHAR) END AS annotator,
         CASE WHEN label % 2 = 1 THEN '1' ELSE '0' END AS has_ruler
  FROM hashes
)"""
)


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """One image prediction per hash; odd labels are wrong more often (a planted concept)."""
    label, key = F.col("label"), F.col("id")
    truth = label < 3
    flip = (key * 31 + label * 17) % 100 < F.when(label % 2 == 1, 35).otherwise(10)
    return hashes(spark, d).select(
        "id",
        "split",
        truth.cast("int").cast("long").alias("y_true"),
        (truth != flip).cast("int").cast("long").alias("y_pred"),
        (((key * 7919) % 1000).cast("double") / F.lit(1000.0)).alias("y_probability"),
        F.concat(F.lit("site"), (key % 3).cast("string")).alias("site"),
        F.concat(F.lit("cam"), (label % 4).cast("string")).alias("device"),
        F.when(key % 7 != 0, F.concat(F.lit("reader"), (key % 2).cast("string"))).alias("annotator"),
        F.create_map(F.lit("has_ruler"), F.when(label % 2 == 1, "1").otherwise("0")).alias("metadata"),
    )


# --- pixel statistics standing in for image profiles --------------------------------------------

PROFILES_SQL = """
profiles AS (
  SELECT vec_id AS id, list_max(embedding)::DOUBLE AS sharpness, embedding[1]::DOUBLE AS mean_luminance,
         list_min(embedding)::DOUBLE AS rms_contrast, embedding[2]::DOUBLE AS colorfulness,
         (vec_id % 40)::DOUBLE AS jpeg_quality
  FROM embeddings
)"""


def profiles(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.array_max(e).cast("double").alias("sharpness"),
        F.get(e, F.lit(0)).cast("double").alias("mean_luminance"),
        F.array_min(e).cast("double").alias("rms_contrast"),
        F.get(e, F.lit(1)).cast("double").alias("colorfulness"),
        (F.col("vec_id") % 40).cast("double").alias("jpeg_quality"),
    )


# --- training logs over events ------------------------------------------------------------------

LOG_LINES_SQL = """
log_lines AS (
  SELECT 'run_' || CAST(user_id AS VARCHAR) AS source, event_id AS line_no,
         CASE event_type
           WHEN 'view' THEN '[epoch ' || CAST(event_id AS VARCHAR) || '/90000] train_loss=' || CAST(value AS VARCHAR) || ' val/accuracy: ' || CAST(event_id % 120 AS VARCHAR) || '%'
           WHEN 'click' THEN 'epoch: ' || CAST(event_id AS VARCHAR) || ' validation.loss = ' || CAST(value AS VARCHAR) || ', train_acc=0.' || CAST(10 + event_id % 90 AS VARCHAR)
           WHEN 'purchase' THEN '[production] accuracy=0.' || CAST(10 + event_id % 80 AS VARCHAR) || ' test_r2=-0.5 majority=' || CAST(event_id % 130 AS VARCHAR) || '%'
           WHEN 'signup' THEN 'loss: ' || CAST(value AS VARCHAR) || ' val_mae=' || CAST(value AS VARCHAR) || '% prod_recall=nan'
           ELSE '   ' END AS line
  FROM events
)"""


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """One log line per event and one run per user: tracker, Keras and bracket spellings, bad values, blanks."""
    e, v = F.col("event_id"), F.col("value").cast("string")
    txt = lambda c: c.cast("string")
    kind = F.col("event_type")
    line = (
        F.when(kind == "view", F.concat(F.lit("[epoch "), txt(e), F.lit("/90000] train_loss="), v, F.lit(" val/accuracy: "), txt(e % 120), F.lit("%")))
        .when(kind == "click", F.concat(F.lit("epoch: "), txt(e), F.lit(" validation.loss = "), v, F.lit(", train_acc=0."), txt(e % 90 + 10)))
        .when(kind == "purchase", F.concat(F.lit("[production] accuracy=0."), txt(e % 80 + 10), F.lit(" test_r2=-0.5 majority="), txt(e % 130), F.lit("%")))
        .when(kind == "signup", F.concat(F.lit("loss: "), v, F.lit(" val_mae="), v, F.lit("% prod_recall=nan")))
        .otherwise(F.lit("   "))
    )
    return table(spark, d, "events").select(
        F.concat(F.lit("run_"), txt(F.col("user_id"))).alias("source"), e.alias("line_no"), line.alias("line")
    )


# --- two ratings of every labelled document -------------------------------------------------------

RATINGS_SQL = """
ratings AS (
  SELECT l.doc_id, 'concept_' || CAST(l.doc_id % 5 AS VARCHAR) AS concept_id, l.quality::BIGINT AS r1,
         CASE WHEN (l.doc_id // 5) % (5 + l.doc_id % 5) = 0 THEN 1 - l.quality ELSE l.quality END::BIGINT AS r2
  FROM labels l
)"""


def ratings(spark: SparkSession, d: str) -> DataFrame:
    quality, doc = F.col("quality").cast("long"), F.col("doc_id")
    odd = F.expr("(doc_id div 5) % (5 + doc_id % 5)") == 0
    return table(spark, d, "labels").select(
        "doc_id",
        F.concat(F.lit("concept_"), (doc % 5).cast("string")).alias("concept_id"),
        quality.alias("r1"),
        F.when(odd, 1 - quality).otherwise(quality).alias("r2"),
    )


def as_text(df: DataFrame) -> DataFrame:
    """Every column as a text cell, the way a CSV reader would hand it over."""
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def texts(column: str) -> Column:
    return F.col(column).cast("string")


# --- features with planted leaks ------------------------------------------------------------------

LEAKS_SQL = """
leaks AS (
  SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END AS y_true,
         CASE WHEN o_orderkey % 50 = 7 THEN 'N/A' WHEN o_orderpriority = '1-URGENT' THEN '1' ELSE '0' END AS copied,
         CASE WHEN (o_orderpriority = '1-URGENT') <> (o_orderkey % 40 = 0) THEN '1' ELSE '0' END AS nearly,
         'k' || CAST(o_orderkey AS VARCHAR) AS order_id, o_orderpriority AS priority, o_orderstatus AS future_status,
         NULL::VARCHAR AS nothing, CAST(o_custkey % 5 AS VARCHAR) AS cohort,
         CASE WHEN o_orderkey % 11 = 3 THEN '' WHEN o_orderkey % 13 = 5 THEN '2026-02-30T00:00:00Z'
              ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.5Z' END AS predicted_at,
         CASE WHEN o_orderkey % 17 = 2 THEN strftime(o_orderdate, '%Y-%m-%d')
              ELSE strftime(o_orderdate + INTERVAL 1 DAY * (o_custkey % 4 - 1), '%Y-%m-%dT%H:%M:%SZ') END AS outcome_at
  FROM orders
)"""

LEAK_FEATURES = ("copied", "nearly", "order_id", "priority", "future_status", "nothing", "cohort")


def leaks(spark: SparkSession, d: str) -> DataFrame:
    """Orders with an exact and a near copy of the target, an id, a proxy category and time pairs."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    bit = lambda c: F.when(c, "1").otherwise("0")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    stamp = lambda c, form: F.date_format(c, form)
    moved = F.expr("cast(o_orderdate as timestamp_ntz) + make_dt_interval(cast(o_custkey % 4 as int) - 1)")
    return table(spark, d, "orders").select(
        bit(urgent).alias("y_true"),
        F.when(key % 50 == 7, "N/A").otherwise(bit(urgent)).alias("copied"),
        bit(urgent != (key % 40 == 0)).alias("nearly"),
        F.concat(F.lit("k"), key.cast("string")).alias("order_id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("future_status"),
        F.lit(None).cast("string").alias("nothing"),
        (cust % 5).cast("string").alias("cohort"),
        F.when(key % 11 == 3, "")
        .when(key % 13 == 5, "2026-02-30T00:00:00Z")
        .otherwise(F.concat(stamp(day, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5Z")))
        .alias("predicted_at"),
        F.when(key % 17 == 2, stamp(day, "yyyy-MM-dd")).otherwise(stamp(moved, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("outcome_at"),
    )


# --- text cells with planted defects ----------------------------------------------------------------

CELLS_SQL = """
raw_cells AS (
  SELECT o_orderkey AS row_no,
         CASE o_orderkey % 12 WHEN 0 THEN '' WHEN 1 THEN ' NaN ' WHEN 2 THEN 'NULL' WHEN 3 THEN 'n/a' WHEN 4 THEN NULL WHEN 5 THEN 'na'
              WHEN 6 THEN '1e400' WHEN 7 THEN '0x1F' WHEN 8 THEN '1d' ELSE CAST(o_totalprice AS VARCHAR) END AS amount,
         CASE WHEN o_orderkey % 3 = 0 THEN '.5e-2' WHEN o_orderkey % 3 = 1 THEN '+7.' ELSE CAST(o_custkey AS VARCHAR) END AS code,
         o_orderstatus AS status
  FROM orders
)"""


def raw_cells(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    k = key % 12
    amount = F.when(k == 0, "").when(k == 1, " NaN ").when(k == 2, "NULL").when(k == 3, "n/a").when(k == 4, F.lit(None))
    amount = amount.when(k == 5, "na").when(k == 6, "1e400").when(k == 7, "0x1F").when(k == 8, "1d")
    code = F.when(key % 3 == 0, ".5e-2").when(key % 3 == 1, "+7.").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select(
        key.alias("row_no"),
        amount.otherwise(F.col("o_totalprice").cast("string")).alias("amount"),
        code.alias("code"),
        F.col("o_orderstatus").alias("status"),
    )


# --- training runs with known curves ------------------------------------------------------------------

RUNS_SQL = """
runs AS (
  SELECT 'cust_' || CAST(o_custkey AS VARCHAR) AS source, o_orderkey AS line_no, kind,
         CASE kind WHEN 3 THEN idx * 2 WHEN 4 THEN idx % 4 ELSE idx END AS epoch,
         CASE kind WHEN 0 THEN 1000 - 50 * least(idx, 18) WHEN 1 THEN 800 WHEN 2 THEN 500 + (idx % 2) * 200 WHEN 3 THEN 1000 - 10 * idx ELSE 700 END / 1000.0::DOUBLE AS train_loss,
         CASE kind WHEN 0 THEN 500 + 40 * idx WHEN 1 THEN 700 + (idx % 2) * 100 WHEN 2 THEN 600 ELSE 700 END / 1000.0::DOUBLE AS val_loss
  FROM (SELECT o_custkey, o_orderkey, o_custkey % 5 AS kind, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders)
)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """One training run per customer and one log line per order: overfitting, flat, swinging, gappy and restarted curves."""
    from ..operators.running import row_index

    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    placed = row_index(orders, "o_orderkey", ("o_custkey",), "idx")
    kind, idx = F.col("o_custkey") % 5, F.col("idx")
    epoch = F.when(kind == 3, idx * 2).when(kind == 4, idx % 4).otherwise(idx)
    train = F.when(kind == 0, 1000 - 50 * F.least(idx, F.lit(18))).when(kind == 1, 800).when(kind == 2, 500 + (idx % 2) * 200)
    train = train.when(kind == 3, 1000 - 10 * idx).otherwise(700)
    val = F.when(kind == 0, 500 + 40 * idx).when(kind == 1, 700 + (idx % 2) * 100).when(kind == 2, 600).otherwise(700)
    text = lambda c: (c.cast("double") / F.lit(1000.0)).cast("string")
    line = F.concat(F.lit("epoch="), epoch.cast("string"), F.lit(" train_loss="), text(train), F.lit(" val_loss="), text(val))
    return placed.select(
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("source"),
        F.col("o_orderkey").alias("line_no"),
        line.alias("line"),
    )


JSON_SQL = """
metric_json AS (
  SELECT event_id, CASE WHEN event_id % 3 = 0
     THEN '[{"val":{"accuracy":0.' || (10 + event_id % 80) || '}},{"loss":' || CAST(value AS VARCHAR) || '}]'
     WHEN event_id % 3 = 1 THEN '{"history":[{"epoch":1,"val_acc":"' || (event_id % 100) || '%"}]}'
     ELSE '{"props":' || props || ',"run":{"tags":["a","b"],"ok":true,"none":null}}' END AS text FROM events)"""


def metric_json(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    txt = lambda c: c.cast("string")
    text = (
        F.when(e % 3 == 0, F.concat(F.lit('[{"val":{"accuracy":0.'), txt(e % 80 + 10), F.lit('}},{"loss":'), txt(F.col("value")), F.lit("}]")))
        .when(e % 3 == 1, F.concat(F.lit('{"history":[{"epoch":1,"val_acc":"'), txt(e % 100), F.lit('%"}]}')))
        .otherwise(F.concat(F.lit('{"props":'), F.col("props"), F.lit(',"run":{"tags":["a","b"],"ok":true,"none":null}}')))
    )
    return table(spark, d, "events").select("event_id", text.alias("text"))


# --- provenance records over customers, orders and line items -------------------------------------------

ENTITIES_SQL = """
sources AS (SELECT 'source_' || c_custkey AS id, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'user_assumption' ELSE 'uploaded_file' END AS kind FROM customer),
datasets AS (SELECT 'dataset_' || o_orderkey AS id, CASE WHEN o_orderkey % 1000 = 7 THEN 'source_x' ELSE 'source_' END || o_custkey AS source_id, 10 + o_orderkey % 90 AS row_count,
                    CASE WHEN o_orderkey % 250 = 8 THEN ['y_true', 'y_pred'] ELSE ['y_true', 'y_pred', 'site'] END AS columns FROM orders),
calls AS (SELECT CASE WHEN o_orderkey % 600 = 9 THEN 'investigation_2' ELSE 'investigation_1' END AS investigation, CASE WHEN o_orderkey % 2 = 0 THEN 'site' ELSE 'y_pred' END AS "column", 'call_' || o_orderkey AS id, 'dataset_' || o_orderkey AS dataset_id, CASE o_orderstatus WHEN 'F' THEN 'threshold_sweep' WHEN 'O' THEN 'run_drift_tests' ELSE 'profile_dataset' END AS tool,
                 o_orderdate AS requested_at FROM orders),
results AS (SELECT 'dataset_' || CASE WHEN o_orderkey % 650 = 4 THEN o_orderkey + 1 ELSE o_orderkey END AS dataset_id, 'result_' || o_orderkey AS id, 'call_' || CASE WHEN o_orderkey % 500 = 3 THEN o_orderkey + 1 ELSE o_orderkey END AS call_id,
                   CASE WHEN o_orderkey % 700 = 5 THEN 'check_calibration' WHEN o_orderstatus = 'F' THEN 'threshold_sweep' WHEN o_orderstatus = 'O' THEN 'run_drift_tests' ELSE 'profile_dataset' END AS tool,
                   CASE WHEN o_orderpriority = '5-LOW' THEN 'failed' ELSE 'completed' END AS status,
                   o_orderdate + INTERVAL 1 DAY * (CASE WHEN o_orderkey % 900 = 11 THEN -1 ELSE 1 END) AS completed_at FROM orders),
evidence AS (SELECT CASE WHEN l_orderkey % 350 <> 6 THEN 'dataset_' || l_orderkey END AS dataset_id, CASE l_linenumber % 3 WHEN 0 THEN 'site' WHEN 1 THEN 'y_true' END AS "column",
                    l_linenumber::BIGINT AS first_row, CASE WHEN l_orderkey % 333 = 1 THEN l_linenumber - 1 WHEN l_orderkey % 444 = 2 THEN 1000 ELSE l_linenumber + l_orderkey % 5 END::BIGINT AS last_row,
                    CASE WHEN l_orderkey % 400 <> 2 THEN min(l_quantity) END AS value, 'evidence_' || l_orderkey || '_' || l_linenumber AS id, 'result_' || l_orderkey AS result_id, CASE WHEN min(l_returnflag) = 'N' THEN 'assumption' ELSE 'measurement' END AS kind
             FROM lineitem GROUP BY l_orderkey, l_linenumber),
hypotheses AS (SELECT 'hypothesis_' || c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'supported' WHEN 'MACHINERY' THEN 'rejected' ELSE 'proposed' END AS status,
                      CASE c_nationkey % 4 WHEN 0 THEN 'unassessed' WHEN 1 THEN 'limited' WHEN 2 THEN 'moderate' ELSE 'strong' END AS level, (c_nationkey % 3)::BIGINT AS open_questions FROM customer),
experiments AS (SELECT 'experiment_' || o_orderkey AS id, 'hypothesis_' || o_custkey AS hypothesis_id, CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 THEN 'completed' ELSE 'planned' END AS status,
                       CASE WHEN o_orderstatus = 'F' AND o_custkey % 3 <> 0 OR o_orderkey % 800 = 1 THEN
                         CASE WHEN o_custkey % 7 < 4 THEN 'supports' WHEN o_orderpriority = '1-URGENT' THEN 'weakens' WHEN o_orderpriority = '2-HIGH' THEN 'rejects' WHEN o_orderpriority = '5-LOW' THEN 'inconclusive' ELSE 'supports' END END AS outcome
                FROM orders),
record_events AS (SELECT 'event_' || event_id AS id, CASE event_id % 4 WHEN 0 THEN 'source_' WHEN 1 THEN 'hypothesis_' WHEN 2 THEN 'call_' ELSE 'nothing_' END || user_id AS entity_id, ts AS at FROM events),
comparisons AS (SELECT 'experiment_' || CASE WHEN o_orderkey % 750 = 6 THEN -1 ELSE o_orderkey END AS experiment_id, 'comparison_' || o_orderkey AS id, CASE WHEN o_totalprice > 300000 THEN 'passed' WHEN o_totalprice > 100000 THEN 'failed' ELSE 'inconclusive' END AS status FROM orders)"""


def entities(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Record tables with planted broken references, mismatched results and unsupported claims."""
    customer, orders, lines = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "lineitem")
    key, cust, nation = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_nationkey")
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    tool = F.when(F.col("o_orderstatus") == "F", "threshold_sweep").when(F.col("o_orderstatus") == "O", "run_drift_tests").otherwise("profile_dataset")
    day = F.col("o_orderdate").cast("timestamp_ntz")
    segment, priority = F.col("c_mktsegment"), F.col("o_orderpriority")
    done = (F.col("o_orderstatus") == "F") & (cust % 3 != 0)
    outcome = (
        F.when(cust % 7 < 4, "supports").when(priority == "1-URGENT", "weakens").when(priority == "2-HIGH", "rejects")
        .when(priority == "5-LOW", "inconclusive").otherwise("supports")
    )
    price = F.col("o_totalprice")
    line_key, number = F.col("l_orderkey"), F.col("l_linenumber")
    event, user = F.col("event_id"), F.col("user_id")
    about = F.when(event % 4 == 0, name("source_", user)).when(event % 4 == 1, name("hypothesis_", user)).when(event % 4 == 2, name("call_", user))
    return {
        "record_events": table(spark, d, "events").select(
            name("event_", event).alias("id"), about.otherwise(name("nothing_", user)).alias("entity_id"), F.col("ts").cast("timestamp_ntz").alias("at")
        ),
        "sources": customer.select(
            name("source_", F.col("c_custkey")).alias("id"), F.when(segment == "MACHINERY", "user_assumption").otherwise("uploaded_file").alias("kind")
        ),
        "datasets": orders.select(
            name("dataset_", key).alias("id"), F.when(key % 1000 == 7, name("source_x", cust)).otherwise(name("source_", cust)).alias("source_id"),
            (key % 90 + 10).alias("row_count"),
            F.when(key % 250 == 8, F.array(F.lit("y_true"), F.lit("y_pred"))).otherwise(F.array(F.lit("y_true"), F.lit("y_pred"), F.lit("site"))).alias("columns"),
        ),
        "calls": orders.select(
            F.when(key % 600 == 9, "investigation_2").otherwise("investigation_1").alias("investigation"),
            F.when(key % 2 == 0, "site").otherwise("y_pred").alias("column"),
            name("call_", key).alias("id"), name("dataset_", key).alias("dataset_id"), tool.alias("tool"), day.alias("requested_at")
        ),
        "results": orders.select(
            name("dataset_", F.when(key % 650 == 4, key + 1).otherwise(key)).alias("dataset_id"),
            name("result_", key).alias("id"),
            name("call_", F.when(key % 500 == 3, key + 1).otherwise(key)).alias("call_id"),
            F.when(key % 700 == 5, "check_calibration").otherwise(tool).alias("tool"),
            F.when(priority == "5-LOW", "failed").otherwise("completed").alias("status"),
            (day + F.expr("make_dt_interval(case when o_orderkey % 900 = 11 then -1 else 1 end)")).alias("completed_at"),
        ),
        "evidence": lines.groupBy("l_orderkey", "l_linenumber")
        .agg(F.min("l_returnflag").alias("flag"), F.min("l_quantity").alias("quantity"))
        .select(
            F.when(line_key % 350 != 6, name("dataset_", line_key)).alias("dataset_id"),
            F.when(number % 3 == 0, "site").when(number % 3 == 1, "y_true").alias("column"),
            number.cast("long").alias("first_row"),
            F.when(line_key % 333 == 1, number - 1).when(line_key % 444 == 2, 1000).otherwise(number + line_key % 5).cast("long").alias("last_row"),
            F.when(line_key % 400 != 2, F.col("quantity")).alias("value"),
            F.concat(name("evidence_", F.col("l_orderkey")), name("_", F.col("l_linenumber"))).alias("id"),
            name("result_", F.col("l_orderkey")).alias("result_id"),
            F.when(F.col("flag") == "N", "assumption").otherwise("measurement").alias("kind"),
        ),
        "hypotheses": customer.select(
            name("hypothesis_", F.col("c_custkey")).alias("id"),
            F.when(segment == "BUILDING", "supported").when(segment == "MACHINERY", "rejected").otherwise("proposed").alias("status"),
            F.when(nation % 4 == 0, "unassessed").when(nation % 4 == 1, "limited").when(nation % 4 == 2, "moderate").otherwise("strong").alias("level"),
            (nation % 3).cast("long").alias("open_questions"),
        ),
        "experiments": orders.select(
            name("experiment_", key).alias("id"),
            name("hypothesis_", cust).alias("hypothesis_id"),
            F.when(done, "completed").otherwise("planned").alias("status"),
            F.when(done | (key % 800 == 1), outcome).alias("outcome"),
        ),
        "comparisons": orders.select(
            name("experiment_", F.when(key % 750 == 6, -1).otherwise(key)).alias("experiment_id"),
            name("comparison_", key).alias("id"), F.when(price > 300000, "passed").when(price > 100000, "failed").otherwise("inconclusive").alias("status")
        ),
    }


# --- raw evaluation cells and raw predictions -------------------------------------------------------------

RAW_EVAL_SQL = """
raw_eval AS (
  SELECT row_id AS row_no, CASE WHEN row_id % 997 = 1 THEN 'yes' WHEN row_id % 991 = 2 THEN ' NA ' ELSE ' ' || y_true END AS y_true, y_pred,
         CASE row_id % 503 WHEN 0 THEN '1e400' WHEN 1 THEN 'nan' WHEN 2 THEN '0.5d' WHEN 3 THEN '-0.1' WHEN 4 THEN '1.5' WHEN 5 THEN '' ELSE CAST(y_probability AS VARCHAR) END AS y_probability, site
  FROM eval_orders)"""


def raw_eval(spark: SparkSession, d: str, clean: bool = False) -> DataFrame:
    """Evaluation rows as text, with bad labels and probabilities planted unless ``clean``."""
    ev, key = eval_orders(spark, d), F.col("row_id")
    p = F.col("y_probability").cast("string")
    truth = F.concat(F.lit(" "), F.col("y_true"))
    if not clean:
        truth = F.when(key % 997 == 1, "yes").when(key % 991 == 2, " NA ").otherwise(truth)
        k = key % 503
        p = (
            F.when(k == 0, "1e400").when(k == 1, "nan").when(k == 2, "0.5d").when(k == 3, "-0.1").when(k == 4, "1.5").when(k == 5, "").otherwise(p)
        )
    return ev.select(key.alias("row_no"), truth.alias("y_true"), F.col("y_pred"), p.alias("y_probability"), F.col("site"))


RAW_PREDS_SQL = """
raw_preds AS (
  SELECT o_orderkey AS row_no, CASE WHEN o_orderkey % 300 = 0 THEN ' ' ELSE 'Img_' || CAST(CASE WHEN o_orderkey % 10 = 9 THEN o_orderkey - 1 ELSE o_orderkey END AS VARCHAR) || '.PNG' END AS filename,
    CASE o_orderkey % 4 WHEN 0 THEN 'Positive' WHEN 1 THEN '1' WHEN 2 THEN 'maybe' ELSE '0' END AS label, CASE WHEN o_orderstatus = 'F' THEN 'TRUE' ELSE 'no' END AS pred,
    CASE o_orderkey % 50 WHEN 0 THEN 'high' WHEN 1 THEN '1.7' WHEN 2 THEN '-3' WHEN 3 THEN '0.25abc' ELSE CAST((o_custkey % 1000) / 1000.0::DOUBLE AS VARCHAR) END AS score,
    CASE o_orderkey % 6 WHEN 0 THEN 'Training' WHEN 1 THEN 'VALIDATION' WHEN 2 THEN 'production' WHEN 3 THEN 'testset' WHEN 4 THEN 'holdout' ELSE 'train-val' END AS subset,
    o_orderpriority AS hospital, CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE CAST(o_custkey % 3 AS VARCHAR) END AS has_ruler
  FROM orders)"""


def raw_preds(spark: SparkSession, d: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    txt = lambda c: c.cast("string")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (key % n + 1).cast("int"))
    k = key % 50
    score = F.when(k == 0, "high").when(k == 1, "1.7").when(k == 2, "-3").when(k == 3, "0.25abc")
    return table(spark, d, "orders").select(
        key.alias("row_no"),
        F.when(key % 300 == 0, " ").otherwise(F.concat(F.lit("Img_"), txt(F.when(key % 10 == 9, key - 1).otherwise(key)), F.lit(".PNG"))).alias("filename"),
        pick(4, "Positive", "1", "maybe", "0").alias("label"),
        F.when(F.col("o_orderstatus") == "F", "TRUE").otherwise("no").alias("pred"),
        score.otherwise(txt((cust % 1000).cast("double") / F.lit(1000.0))).alias("score"),
        pick(6, "Training", "VALIDATION", "production", "testset", "holdout", "train-val").alias("subset"),
        F.col("o_orderpriority").alias("hospital"),
        F.when(key % 5 == 0, "  ").otherwise(txt(cust % 3)).alias("has_ruler"),
    )
