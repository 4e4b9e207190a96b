"""The sequence monitor over several micro-batches: order inside a batch, both rules, and expiry in event time."""

from datetime import datetime, timedelta

from plumbline.streaming import monitors as mon

START = datetime(2024, 1, 1)


def plain(rows, keep_hours):
    last, out = {}, []
    for user, position, sequence, hour in sorted(rows, key=lambda r: r[1]):
        if user in last and hour - last[user][1] <= keep_hours:
            before = last[user][0]
            out += [(user, position, sequence, before, "sequence")] * (sequence <= before) + [(user, position, sequence, before, "time")] * (hour < last[user][1])
        last[user] = (sequence, hour)
    return sorted(out)


def run(spark, folder, batches, keep_hours):
    schema = "user_id long, position long, sequence long, ts timestamp"
    for rows in batches:
        stamped = [(u, p, s, START + timedelta(hours=h)) for u, p, s, h in rows]
        spark.createDataFrame(stamped, schema).repartition(3).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").withWatermark("ts", "1 hour")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", mon.ROCKSDB)
    try:
        checked = mon.sequence_check(stream, keep_ms=keep_hours * 3_600_000)
        return sorted(tuple(r) for r in mon.run_to_table(checked, folder).collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_rules_and_expiry_over_batches(spark, tmp_path):
    first = [(1, 1, 10, 0), (1, 2, 9, 1), (1, 3, 12, 0), (2, 4, 5, 1), (2, 5, 5, 1), (3, 6, 1, 1)]
    second = [(1, 7, 11, 3), (2, 8, 1, 40), (3, 9, 1, 25)]
    third = [(2, 10, 1, 41), (1, 11, 1, 41)]
    got = run(spark, str(tmp_path), [first, second, third], 24)
    assert got == plain(first + second + third, 24)
    assert (3, 9, 1, 1, "sequence") in got and (2, 8, 1, 5, "sequence") not in got and (1, 11, 1, 11, "sequence") not in got


def test_one_busy_user_comes_in_many_batches(spark, tmp_path):
    rows = [(7, i, i - 50 * (i % 97 == 0), i / 3600) for i in range(25_000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    try:
        assert run(spark, str(tmp_path), [rows], 24) == plain(rows, 24)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
