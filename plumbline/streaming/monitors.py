"""Continuous monitoring rules as Structured Streaming jobs.

The windowed rules are plain functions of a DataFrame: given a stream they need its watermark, given a
table they compute the same windows at rest.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.bits import HASH_BITS
from ..operators.neardup import AGREE, _bands, _choices, _longs
from ..session import cut
from ..sources.evaluation import ingest_rowwise

DAY_MS = 24 * 60 * 60 * 1000


def event_stream(spark: SparkSession, path: str, schema: T.StructType, delay: str = "10 minutes", at: str = "ts") -> DataFrame:
    """A stream of event files with its watermark."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def _window(length: str, at: str) -> tuple[Column, list[Column]]:
    return F.window(at, length).alias("w"), [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]


def sustained(alerts: DataFrame, worst: Column, length: str, lasting: str, at: str = "window_start", by: Sequence[str] = ()) -> DataFrame:
    """Episodes of alerting windows one after the other: (by...,) episode_start, episode_end, worst and windows.

    ``alerts``: window_start, window_end and alert of windows of ``length``. Only episodes of ``lasting`` or more come out.
    They are sessions whose gap is one window, a second stateful step: at rest over all windows, or on a stream of windows in
    append mode, where an episode comes out when the watermark has passed its end; ``at`` is then the windows' own time
    (``timed`` below), which carries that watermark.
    """
    session = F.session_window(at, f"{length} 1 second")  # beside a key, without which Spark refuses sessions of a stream
    found = alerts.where("alert").groupBy("alert", *by, session).agg(
        F.min("window_start").alias("episode_start"), F.max("window_end").alias("episode_end"), worst.alias("worst"), F.count("*").alias("windows")
    )
    return found.where(F.col("episode_end") - F.col("episode_start") >= F.expr(f"INTERVAL '{lasting}'")).select(*by, "episode_start", "episode_end", "worst", "windows")


def metric_floor_alert(events: DataFrame, value: str, floor: float, length: str = "15 minutes", at: str = "ts", timed: bool = False) -> DataFrame:
    """Windows and whether their median of ``value`` lies below the floor (``alert``); ``timed`` adds the window's time ``at``.

    The median is a mergeable sketch: exact up to about 10,000 values a window, with a relative rank error of
    1/10,000 beyond.
    """
    window, ends = _window(length, at)
    medians = events.groupBy(window).agg(F.percentile_approx(value, 0.5, 10000).alias("median"), F.count(F.lit(1)).alias("n"))
    when = [F.window_time("w").alias("at")] if timed else []
    return medians.select(*ends, "median", "n", (F.col("median") < floor).alias("alert"), *when)


def prevalence_shift_alert(
    events: DataFrame, positive: Column, baseline: float | DataFrame, limit: float = 0.10, length: str = "30 minutes", at: str = "ts"
) -> DataFrame:
    """Windows and whether their positive share differs from the baseline by more than ``limit`` (``alert``).

    ``baseline`` is a number or a one-row frame of a column ``baseline``.
    """
    window, ends = _window(length, at)
    shares = events.groupBy(window).agg(F.avg(positive.cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))
    if isinstance(baseline, DataFrame):
        baseline = float(baseline.first()["baseline"])
    moved = F.col("share") - F.lit(baseline)
    return shares.select(*ends, "share", "n", moved.alias("shift"), (F.abs(moved) > limit).alias("alert"))


def rate_window(events: DataFrame, limits: dict[str, int], user: str = "user_id", at: str = "ts") -> DataFrame:
    """Requests per user in tumbling windows, with a flag where a limit is exceeded.

    ``limits`` maps a window length (``1 minute``, ``1 day``) to the allowed count.
    """
    if len(limits) != 1:
        raise ValueError("one window length per query; run one query per limit")
    length, allowed = next(iter(limits.items()))
    window, ends = _window(length, at)
    counts = events.groupBy(user, window).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(user, *ends, "n", (F.col("n") > allowed).alias("over"))


def _keyed(df: DataFrame, hash_: str, k: int) -> DataFrame:
    """One row per choice of bands: choice and key, the hash's bits in them."""
    masks = _longs(_choices(_bands(list(range(HASH_BITS)), k + AGREE), AGREE))
    return df.select("*", F.posexplode(masks).alias("choice", "mask")).withColumn("key", F.col(hash_).bitwiseAND(F.col("mask")))


def index_training(training: DataFrame, name: str, folder: str, k: int = 6, buckets: int = 64) -> None:
    """Add the band keys of ``training`` (hash) to the table ``name``, whose files lie in ``folder``; the first call makes it.

    The table is bucketed by key, so a join need not move it. Hashes that it already holds are left out; a null hash
    has no keys. Choose ``buckets`` for the size the table will have.
    """
    spark = training.sparkSession
    new = training.where(F.col("hash").isNotNull()).select(F.col("hash").alias("train_hash")).distinct()
    if spark.catalog.tableExists(name):
        held = spark.table(name).where("choice = 0").select("train_hash")
        new = cut(new.join(held, "train_hash", "left_anti"), "new-hashes")  # read before the table is written
    rows = _keyed(new, "train_hash", k).select("train_hash", "choice", "key").repartition(buckets, "choice", "key")
    rows.write.bucketBy(buckets, "choice", "key").sortBy("choice", "key").option("path", folder).mode("append").saveAsTable(name)


def duplicate_leak_alert(incoming: DataFrame, training: DataFrame | str, k: int = 6) -> DataFrame:
    """Incoming hashes within ``k`` bits of a training hash: id, train_hash, distance.

    A stream-static join on band keys, checked exactly. Each pair comes out under its first agreeing
    choice of bands, so no state is kept. ``training`` is the name of a table of ``index_training`` (same ``k``), of which only
    the incoming side moves in each micro-batch, or a frame of hashes, which is keyed anew in every one.
    """
    if isinstance(training, str):
        known = incoming.sparkSession.table(training)
    else:
        known = _keyed(training.select(F.col("hash").alias("train_hash")).distinct(), "train_hash", k).select("train_hash", "choice", "key")
    differ = F.col("hash").bitwiseXOR(F.col("train_hash"))
    near = _keyed(incoming, "hash", k).join(known.hint("merge"), ["choice", "key"]).filter(F.bit_count(differ) <= k)
    agreeing = F.filter(_longs(_bands(list(range(HASH_BITS)), k + AGREE)), lambda band: differ.bitwiseAND(band) == 0)
    first = F.aggregate(F.slice(agreeing, 1, AGREE), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(b))
    return near.filter(first == F.col("mask")).select("id", "train_hash", F.bit_count(differ).cast("long").alias("distance"))


# --- sequence state ----------------------------------------------------------------------------

SEQUENCE_OUT = T.StructType([*[T.StructField(c, T.LongType()) for c in ("user_id", "position", "sequence", "previous")], T.StructField("rule", T.StringType())])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS_AT_ONCE = 10_000


class LastSequence(StatefulProcessor):
    """Keeps the last sequence number and time of each user; a timer in event time forgets them."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "sequence bigint, at_ms bigint")

    def _violations(self, user: int, rows: Iterator[tuple[int, int, int]]) -> Iterator[tuple]:
        before = self.last.get() if self.last.exists() else None
        due = None if before is None else before[1] + self.keep_ms
        for position, sequence, at in rows:
            if before is not None and at - before[1] <= self.keep_ms:
                if sequence <= before[0]:
                    yield user, position, sequence, before[0], "sequence"
                if at < before[1]:
                    yield user, position, sequence, before[0], "time"
            before = (sequence, at)
        self.last.update(before)
        if due is not None:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(before[1] + self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Batches come in any order: each is sorted, then all are merged row by row.
        runs = [batch[["position", "sequence", "at_ms"]].to_numpy("int64") for batch in rows]
        runs = [run[run[:, 0].argsort(kind="stable")] for run in runs]
        merged = heapq.merge(*(map(tuple, map(np.ndarray.tolist, run)) for run in runs))
        found = self._violations(int(key[0]), merged)
        while some := list(islice(found, ROWS_AT_ONCE)):
            yield pd.DataFrame(some, columns=SEQUENCE_OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({f.name: pd.Series(dtype="object" if f.name == "rule" else "int64") for f in SEQUENCE_OUT})

    def close(self) -> None:
        pass


def sequence_check(events: DataFrame, at: str = "ts", keep_ms: int = DAY_MS) -> DataFrame:
    """Sequence numbers that do not increase and times that run backwards, per user in recorded order.

    ``events``: user_id, position, sequence and the watermarked time ``at``; a row of rule ``sequence`` or ``time`` names the
    number before it. A number more than ``keep_ms`` older than the event is forgotten: an event-time timer clears a user's
    state once the watermark passes that moment, so expiry depends on the events alone and a finite run ends. Timers and state
    live in RocksDB: set ``spark.sql.streaming.stateStore.providerClass`` to ``ROCKSDB`` before starting the query. A task holds
    24 bytes for each row of one user in one micro-batch, so bound the batch at the source (``maxFilesPerTrigger`` and the
    like); over a table use ``records.sequence_violations``, which splits a busy user over tasks.
    """
    rows = events.select("user_id", "position", "sequence", F.unix_millis(at).alias("at_ms"), at)
    return rows.groupBy("user_id").transformWithStateInPandas(LastSequence(keep_ms), SEQUENCE_OUT, outputMode="append", timeMode="eventTime")


# --- running a monitor to the end of its input ----------------------------------------------------

def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process everything available into parquet files with exactly-once commits, and return them."""
    query: StreamingQuery = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_latest(stream: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Process everything available in update mode and return the latest row of each key.

    Every micro-batch writes the rows that it changed under its number (a replayed one replaces its own), so windows
    that the watermark has not passed yet are there too, with what they hold so far. ``at_batch`` tells readers which
    of several rows of a key is the latest; a consumer in a hurry reads the last folder only.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/at_batch={number}")

    writer = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("at_batch", T.LongType())])
    rows = stream.sparkSession.read.schema(schema).parquet(f"{folder}/out")
    others = [c for c in stream.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "at_batch").alias("last"))
    return latest.select(*[F.col(c) if c in keys else F.col("last")[c].alias(c) for c in stream.columns])


def ingest_validate(stream: DataFrame, row: str, folder: str, positive: str = "1", negative: str = "0") -> Callable[[], StreamingQuery]:
    """A query that writes valid evaluation rows and issues of every micro-batch.

    Validity is per row here. Files are written under the batch id, so a replayed batch replaces
    its own output.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows, issues = ingest_rowwise(batch, row, positive, negative)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
        issues.write.mode("overwrite").parquet(f"{folder}/issues/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
    return lambda: writer.trigger(availableNow=True).start()
