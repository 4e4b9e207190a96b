"""Sustained alerts: the same episodes at rest and as a second stateful step of a stream."""

import datetime as dt

from plumbline.streaming import monitors as mon
from pyspark.sql import functions as F

START = dt.datetime(2024, 1, 1)
# quarter hours with a low value: four in a row, one alone, two in a row with a normal one between
LOW = {2: 5.0, 3: 1.0, 4: 7.0, 5: 8.0, 9: 2.0, 12: 3.0, 14: 4.0, 15: 6.0}


def events(spark):
    rows = [(START + dt.timedelta(minutes=15 * q + m), LOW.get(q, 50.0)) for q in range(20) for m in (0, 14)]
    rows.append((START + dt.timedelta(days=2), 50.0))  # moves the watermark past all of them
    return spark.createDataFrame(rows, "ts timestamp, value double")


def spans(rows):
    quarter = lambda t: int((t - START).total_seconds() // 900)
    return sorted((quarter(r.episode_start), quarter(r.episode_end), r.worst, r.windows) for r in rows)


def test_at_rest(spark):
    windows = mon.metric_floor_alert(events(spark), "value", 10.0)
    found = lambda lasting: spans(mon.sustained(windows, F.min("median"), "15 minutes", lasting).collect())
    assert found("15 minutes") == [(2, 6, 1.0, 4), (9, 10, 2.0, 1), (12, 13, 3.0, 1), (14, 16, 4.0, 2)]
    assert found("30 minutes") == [(2, 6, 1.0, 4), (14, 16, 4.0, 2)] and found("61 minutes") == []
    assert mon.sustained(windows.where("false"), F.min("median"), "15 minutes", "15 minutes").count() == 0


def test_on_a_stream(spark, tmp_path):
    events(spark).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = mon.event_stream(spark, str(tmp_path / "in"), events(spark).schema)
    windows = mon.metric_floor_alert(stream, "value", 10.0, timed=True)
    episodes = mon.sustained(windows, F.min("median"), "15 minutes", "30 minutes", at="at")
    assert spans(mon.run_to_table(episodes, str(tmp_path / "run")).collect()) == [(2, 6, 1.0, 4), (14, 16, 4.0, 2)]
