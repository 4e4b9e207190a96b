"""Monitoring streams run to the end of their input, the image job, and the composite jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions.bits import average_hash
from ...operators import images as img
from ...session import shared_dir
from ...streaming import monitors as mon
from .. import frames as fr
from .. import jobs
from ..registry import query, sql

# --- streams ------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table as a file stream; the pattern takes a single file or a folder of files of any names."""
    schema = fr.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}[.]parquet")


def _events(spark, d) -> DataFrame:
    return _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "10 minutes")


def _text_times(df: DataFrame) -> DataFrame:
    times = [c for c in df.columns if c.startswith("window_")]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})


ENDS = ["window_start", "window_end"]


def windows_sql(length: str, body: str, keys: str = "") -> str:
    extra = f"{keys}, " if keys else ""
    return f"""win AS (SELECT {extra}time_bucket(INTERVAL '{length}', ts) AS window_start, time_bucket(INTERVAL '{length}', ts) + INTERVAL '{length}' AS window_end, {body}
      FROM events GROUP BY ALL)"""


STAMP = "strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end"


@query(
    "st_metric_floor_alert",
    sql(
        windows_sql("15 minutes", "quantile_disc(value, 0.5) AS median, count(*) AS n"),
        f"SELECT {STAMP}, median, n FROM win WHERE median < 10",
        ["median"],
    ),
)
def _(spark, d):
    alerts = mon.metric_floor_alert(_events(spark, d), "value", 10.0)
    return _text_times(mon.run_latest(alerts, shared_dir(spark, "floor"), ENDS).filter("alert").drop("alert"))


def episodes_sql(alert: str, worst: str, length: str, windows: int) -> str:
    """Gaps and islands over the alerting windows of ``win``."""
    return f"""SELECT strftime(min(window_start), '%Y-%m-%d %H:%M:%S') AS episode_start, strftime(max(window_end), '%Y-%m-%d %H:%M:%S') AS episode_end, {worst} AS worst, count(*) AS windows
      FROM (SELECT *, window_start - INTERVAL '{length}' * row_number() OVER (ORDER BY window_start) AS island FROM win, base WHERE {alert}) AS a GROUP BY island HAVING count(*) >= {windows}"""


def _episode_times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("episode_start", "episode_end")})


@query(
    "st_floor_episodes",
    sql(
        windows_sql("15 minutes", "quantile_disc(value, 0.5) AS median, count(*) AS n") + ", base AS (SELECT 1)",
        episodes_sql("median < 10", "min(median)", "15 minutes", 3),
        ["worst"],
    ),
)
def _(spark, d):
    windows = mon.run_latest(mon.metric_floor_alert(_events(spark, d), "value", 10.0), shared_dir(spark, "floor"), ENDS)
    return _episode_times(mon.sustained(windows, F.min("median"), "15 minutes", "45 minutes"))


@query(
    "st_prevalence_episodes",
    sql(
        windows_sql("30 minutes", "avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) AS n")
        + ", base AS (SELECT avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS b FROM events)",
        episodes_sql("abs(share - b) > 0.1", "max(abs(share - b))", "30 minutes", 2),
        ["worst"],
    ),
)
def _(spark, d):
    error = F.col("event_type") == "error"
    base = fr.table(spark, d, "events").agg(F.avg(error.cast("double")).alias("baseline"))
    windows = mon.run_latest(mon.prevalence_shift_alert(_events(spark, d), error, base), shared_dir(spark, "prevalence"), ENDS)
    return _episode_times(mon.sustained(windows, F.max(F.abs("shift")), "30 minutes", "60 minutes"))


@query(
    "st_prevalence_shift_alert",
    sql(
        windows_sql("30 minutes", "avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS share, count(*) AS n"),
        f"""SELECT {STAMP}, share, n, share - b AS shift FROM win, (SELECT avg(CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS b FROM events)
            WHERE abs(share - b) > 0.1""",
        ["share", "shift"],
    ),
)
def _(spark, d):
    error = F.col("event_type") == "error"
    base = fr.table(spark, d, "events").agg(F.avg(error.cast("double")).alias("baseline"))
    alerts = mon.prevalence_shift_alert(_events(spark, d), error, base)
    return _text_times(mon.run_latest(alerts, shared_dir(spark, "prevalence"), ENDS).filter("alert").drop("alert"))


@query(
    "st_rate_window",
    sql(windows_sql("1 day", "count(*) AS n", "user_id"), f'SELECT user_id, {STAMP}, n, n > 3 AS "over" FROM win'),
)
def _(spark, d):
    counts = mon.rate_window(_events(spark, d), {"1 day": 3})
    return _text_times(mon.run_latest(counts, shared_dir(spark, "rate"), ["user_id", *ENDS]))


@query(
    "st_rate_window_batch",
    sql(windows_sql("1 minute", "count(*) AS n", "user_id"), f'SELECT user_id, {STAMP}, n, n > 1 AS "over" FROM win'),
)
def _(spark, d):
    events = fr.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _text_times(mon.rate_window(events, {"1 minute": 1}))


@query(
    "st_duplicate_leak_alert",
    sql(
        fr.HASHES_SQL,
        """SELECT DISTINCT h.id, t.hash AS train_hash, bit_count(xor(h.hash, t.hash))::BIGINT AS distance FROM hashes h JOIN base_hash t ON bit_count(xor(h.hash, t.hash)) <= 6
           WHERE h.split <> 'train'""",
    ),
)
def _(spark, d):
    training = fr.hashes(spark, d).filter(F.col("split") == "train").select("hash")
    base = _stream(spark, d, "embeddings").select(F.col("vec_id").alias("id"), average_hash(F.col("embedding")).alias("hash"))
    flipped = F.col("hash").bitwiseXOR(F.expr("shiftleft(1L, cast(id % 9 as int)) - 1"))
    incoming = base.filter(F.col("id") % 5 == 0).select((F.col("id") + 1000000).alias("id"), flipped.alias("hash"))
    folder = shared_dir(spark, "leak")
    name = f"training_keys_{folder.rsplit('-', 1)[-1]}"
    even = F.pmod("hash", F.lit(2)) == 0
    for part in (training.where(even), training):  # written, then extended
        mon.index_training(part, name, f"{folder}/keys", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    alerts = mon.run_to_table(mon.duplicate_leak_alert(incoming, name), folder)
    spark.sql(f"DROP TABLE {name}")
    return alerts


@query(
    "st_ingest_validate",
    sql(
        "",
        """SELECT event_id AS "row", 'y_true' AS "column", 'label' AS code FROM events WHERE event_type = 'click'
           UNION ALL SELECT event_id, 'y_probability', 'probability' FROM events WHERE value > 1
           UNION ALL SELECT event_id, NULL, 'accepted' FROM events WHERE event_type <> 'click' AND value <= 1""",
    ),
)
def _(spark, d):
    kind = F.col("event_type")
    raw = _stream(spark, d, "events").select(
        F.col("event_id").alias("row_no"),
        F.when(kind == "error", "1").when(kind == "click", "yes").otherwise("0").alias("y_true"),
        F.lit("0").alias("y_pred"),
        F.col("value").cast("string").alias("y_probability"),
    )
    folder = shared_dir(spark, "validate")
    mon.ingest_validate(raw, "row_no", folder)().awaitTermination()
    accepted = spark.read.parquet(f"{folder}/rows").select(
        F.col("row_id").alias("row"), F.lit(None).cast("string").alias("column"), F.lit("accepted").alias("code")
    )
    return spark.read.parquet(f"{folder}/issues").select("row", "column", "code").unionByName(accepted)


@query(
    "st_sequence_check",
    sql(
        """seq AS (SELECT user_id, event_id, event_id - CASE WHEN event_id % 97 = 0 THEN 100000 ELSE 0 END AS num,
                 ts - CASE WHEN event_id % 89 = 0 THEN INTERVAL '3 days' ELSE INTERVAL '0 days' END AS t FROM events),
        pre AS (SELECT *, lag(num) OVER w AS prev, lag(t) OVER w AS prev_t FROM seq WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        near AS (SELECT * FROM pre WHERE t - prev_t <= INTERVAL '2 days')""",
        """SELECT user_id, event_id AS position, num AS sequence, prev AS previous, 'sequence' AS rule FROM near WHERE num <= prev
           UNION ALL SELECT user_id, event_id, num, prev, 'time' FROM near WHERE t < prev_t""",
        longs=["position", "sequence", "previous"],
    ),
)
def _(spark, d):
    number = F.col("event_id") - F.when(F.col("event_id") % 97 == 0, 100000).otherwise(0)
    at = F.col("ts").cast("timestamp") - F.when(F.col("event_id") % 89 == 0, F.expr("INTERVAL 3 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    events = _stream(spark, d, "events").select("user_id", F.col("event_id").alias("position"), number.alias("sequence"), at.alias("ts"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", mon.ROCKSDB)
    try:
        late = events.withWatermark("ts", "4 days")
        return mon.run_to_table(mon.sequence_check(late, keep_ms=2 * mon.DAY_MS), shared_dir(spark, "sequence"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


# --- images ---------------------------------------------------------------------------------------

IMAGES = """
px AS (SELECT vec_id AS id, i, floor(abs(embedding[1 + (i * 5 + i // 64) % 64]::DOUBLE) * 1000) % 256 AS r, floor(abs(embedding[1 + (i * 5 + 11 + i // 64) % 64]::DOUBLE) * 1000) % 256 AS g,
              floor(abs(embedding[1 + (i * 5 + 22 + i // 64) % 64]::DOUBLE) * 1000) % 256 AS b FROM embeddings, range(256) t(i)),
luma AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS y FROM px),
lum AS (SELECT *, power(y::FLOAT::DOUBLE - avg(y) OVER (PARTITION BY id), 2) AS sq, r - g AS rg, 0.5 * (r + g) - b AS yb, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM luma)"""


def _images(spark, d) -> DataFrame:
    """A 16 x 16 RGB image from every embedding."""
    e = F.col("embedding")
    channel = lambda i, shift: (
        F.floor(F.abs(F.get(e, ((i * 5 + shift + F.floor(i / 64)) % 64).cast("int")).cast("double")) * 1000) % 256
    ).cast("double")
    pixels = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.array(channel(i, 0), channel(i, 11), channel(i, 22))))
    return fr.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(16).alias("width"), F.lit(16).alias("height"), pixels.alias("pixels"))


@query("profile_images")
def _(spark, d):
    return img.profile_images(_images(spark, d))


@query(
    "profile_images_basic",
    sql(
        IMAGES,
        """SELECT id, avg(y) AS mean_luminance, sqrt(avg(sq)) AS std_luminance, sqrt(avg(sq)) / 255 AS rms_contrast, avg(CASE WHEN mx = 0 THEN 0 ELSE (mx - mn) / mx END) AS mean_saturation,
             sqrt(var_pop(rg) + var_pop(yb)) + 0.3 * sqrt(avg(rg) * avg(rg) + avg(yb) * avg(yb)) AS colorfulness,
             avg(CASE WHEN y >= 250 THEN 1.0 ELSE 0 END) AS clipped_highlights, avg(CASE WHEN y <= 5 THEN 1.0 ELSE 0 END) AS crushed_blacks FROM lum GROUP BY id""",
        ["mean_luminance", "std_luminance", "rms_contrast", "mean_saturation", "colorfulness", "clipped_highlights", "crushed_blacks"],
    ),
)
def _(spark, d):
    return img.profile_images(_images(spark, d)).select(
        "id", "mean_luminance", "std_luminance", "rms_contrast", "mean_saturation", "colorfulness", "clipped_highlights", "crushed_blacks"
    )


# --- composite jobs -----------------------------------------------------------------------------------

from .logs import DIAGNOSIS, DIAG_COLS  # noqa: E402
from .metrics import CONF, ECE, METRICS_FROM, SLICES, SWEEP, WIDTH_EDGES, bins_sql  # noqa: E402
from .quality import FEATURES, REVIEW, _datasets  # noqa: E402
from .vision import QF, VERDICT, _audit, _labels  # noqa: E402

EO, ED, IT = fr.EVAL_ORDERS_SQL, fr.EVAL_DOCS_SQL, fr.SPLITS_SQL


@query(
    "job_threshold_repair",
    sql(
        EO + "," + SWEEP + ", best AS (SELECT threshold, total_cost FROM costed ORDER BY total_cost, threshold DESC LIMIT 1)",
        """SELECT b.threshold, b.total_cost AS after, c.total_cost AS before, 'passed' AS status, CASE WHEN b.total_cost = c.total_cost THEN 'unchanged' ELSE 'improved' END AS improvement, true AS gate_passed
           FROM best b, costed c WHERE c.threshold = 0.5""",
        ["threshold", "after", "before"],
    ),
)
def _(spark, d):
    report = jobs.threshold_repair(fr.eval_orders(spark, d))
    row = report["comparison"].filter(F.col("metric") == "total_cost")
    return row.select(
        report["selection"].select("threshold").scalar().alias("threshold"),
        "after",
        "before",
        "status",
        "improvement",
        report["gate"].select("passed").scalar().alias("gate_passed"),
    )


@query(
    "job_calibration_case",
    sql(
        EO + "," + CONF.format(src="eval_orders") + "," + bins_sql(WIDTH_EDGES),
        f"""SELECT metric, value FROM ({METRICS_FROM.format(keys='', conf='conf')}) UNION ALL
            SELECT 'brier_score', avg(power(y_probability - CASE WHEN y_true = '1' THEN 1.0 ELSE 0.0 END, 2)) FROM eval_orders UNION ALL SELECT metric, value FROM ({ECE})""",
        ["value"],
    ),
)
def _(spark, d):
    return jobs.calibration_case(fr.eval_orders(spark, d))["metrics"].select("metric", "value")


@query(
    "job_site_case",
    sql(EO + "," + SLICES, """SELECT slice_value, metric, value, n, n < 5 AS small FROM smetrics WHERE "column" = 'site'""", ["value"]),
)
def _(spark, d):
    return jobs.site_case(fr.eval_orders(spark, d))["slices"].select("slice_value", "metric", "value", "n", "small")


@query(
    "job_dataset_audit",
    sql(IT + "," + DIAGNOSIS.replace("'leakage', 3 - 1, 1, 1", "'leakage', 3, 1, 0"), "SELECT * FROM diag", longs=["score", "support", "conflicts"]),
)
def _(spark, d):
    sides = [fr.split_of(spark, d, s).select(*DIAG_COLS) for s in ("train", "val", "production")]
    return jobs.dataset_audit(*sides, "linestatus")["diagnosis"]


@query(
    "job_vision_audit",
    sql(VERDICT, "SELECT concept_id, verdict, n1, n2 FROM verdicts"),
)
def _(spark, d):
    report = jobs.vision_audit(
        fr.predictions(spark, d), fr.hashes(spark, d), fr.profiles(spark, d), _labels(spark, d), _audit(spark, d), QF
    )
    return report["concepts"].select("concept_id", "verdict", "n1", "n2")


@query(
    "job_multi_dataset_challenge",
    sql(
        IT + "," + REVIEW,
        """SELECT ref, comp, kind, value, ref = 'train' AND comp = 'production' AS next FROM review""",
        ["value"],
    ),
)
def _(spark, d):
    report = jobs.multi_dataset_challenge(_datasets(spark, d), [("val", "train")], FEATURES)
    upcoming = report["next"].withColumn("next", F.lit(True))
    rows = report["review"].select("ref", "comp", "kind", "value").join(F.broadcast(upcoming), ["ref", "comp"], "left")
    return rows.withColumn("next", F.coalesce("next", F.lit(False)))
