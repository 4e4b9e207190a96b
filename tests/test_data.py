import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import bits, cells, times
from plumbline.operators import compare as cp
from plumbline.operators import drift as dr
from plumbline.operators import leakage as lk
from plumbline.operators import quality as q
from plumbline.operators import running as rn


def test_decimal_cells(spark):
    given = ["1", "+.5", "1.", "-2e3", "1e400", "nan", "inf", "0x1f", "1d", " 1 ", "", None]
    df = spark.createDataFrame([(x,) for x in given], "cell string")
    got = [r[0] for r in df.select(cells.decimal_value(F.col("cell"))).collect()]
    assert got == [1.0, 0.5, 1.0, -2000.0] + [None] * 8


def test_strict_utc_and_hash(spark):
    stamps = ["2026-02-28T00:00:00Z", "2026-02-30T00:00:00Z", "2026-01-01T00:00:00+00:00", "2026-01-01T00:00:00.123Z", "2026-01-01"]
    df = spark.createDataFrame([(x,) for x in stamps], "t string")
    assert [r[0] for r in df.select(times.utc_day(F.col("t"))).collect()] == ["2026-02-28", None, None, "2026-01-01", None]
    row = spark.range(1).select(
        bits.hash64(F.lit("ffffffffffffffff")), bits.hash64(F.lit("8000000000000000")), bits.hamming(F.lit(None).cast("bigint"), F.lit(1))
    ).first()
    assert tuple(row) == (-1, -(2**63), 64)


def test_profile_target_copy_and_overlap(spark):
    train = spark.createDataFrame([("1", "1", "a", "a"), ("2", "3", "b", "b"), ("3", None, "a", "a")], "id string, x string, label string, copy string")
    profile = {r.column: r for r in q.column_profile(train).collect()}
    assert profile["x"].missing == 1 and profile["x"].mean == 2.0 and profile["label"].type == "categorical"
    warned = {(r.column, r.warning) for r in q.column_warnings(train, "label").collect()}
    assert ("copy", "target_copy") in warned and ("id", "unique_identifier") in warned
    other = train.limit(1)
    assert tuple(cp.feature_overlap(train, other, ["id", "x", "copy"]).first()) == (1, 1)


def test_mean_survives_overflow(spark):
    df = spark.createDataFrame([("1.7e308",), ("1.7e308",)], "x string")
    assert q.column_profile(df).first().mean == pytest.approx(1.7e308)


def test_running_matches_plain_sums_on_skewed_parts(spark):
    random.seed(5)
    rows = [("hot" if i % 3 else f"p{i % 7}", i, random.randint(-5, 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "part string, at long, v long").repartition(6)
    aggs = {"upto": ("sum", F.col("v")), "low": ("min", F.col("v")), "before": ("prev", F.col("v"))}
    got = {(r.part, r.at): (r.upto, r.low, r.before, r.all_upto) for r in rn.running(df, "at", aggs, ("part",)).collect()}
    for part in {r[0] for r in rows}:
        total, seen, last = 0, [], None
        mine = sorted(r for r in rows if r[0] == part)
        for _, at, v in mine:
            total += v
            seen.append(v)
            assert got[(part, at)] == (total, min(seen), last, sum(r[2] for r in mine))
            last = v


def test_stride_sample_positions(spark):
    df = spark.range(103).withColumnRenamed("id", "k")
    got = sorted(r.k for r in q.stride_sample(df, "k", 10).collect())
    assert got == [i * 103 // 10 for i in range(10)]
    assert q.stride_sample(df, "k", 500).count() == 103


def one(spark, name, data, kind="double"):
    return spark.createDataFrame([(x,) for x in data], f"{name} {kind}")


@pytest.mark.parametrize(
    "a, b, ks, w1", [([0, 1], [0, 0, 1, 1], 0, 0), ([0, 1], [2, 3], 1, 2), ([0], [0, 2], 0.5, 1)]
)
def test_ecdf_distances(spark, a, b, ks, w1):
    row = dr.ecdf_distances(one(spark, "x", map(float, a)), one(spark, "x", map(float, b)), ["x"]).first()
    assert (row.ks, row.w1) == pytest.approx((ks, w1))


def test_psi_rules(spark):
    import math

    words = dr.psi(one(spark, "x", "aab", "string"), one(spark, "x", "abb", "string"), ["x"]).first()
    assert words.psi == pytest.approx(2 * (0.625 - 0.375) * math.log(0.625 / 0.375))
    assert dr.psi(one(spark, "x", [0.0, 2.0]), one(spark, "x", [-100.0, 100.0]), ["x"], 2).first().psi == pytest.approx(0)
    flat = dr.psi(one(spark, "x", [1.0, 1.0]), one(spark, "x", [2.0, 2.0]), ["x"], 2).first()
    assert flat.psi is None and flat.reason == "constant reference"
    none = dr.psi(one(spark, "x", [None], "double"), one(spark, "x", [2.0]), ["x"], 2).first()
    assert none.psi is None and none.reason == "empty sample"
    mixed = dr.ks_stat(one(spark, "x", ["1", "b"], "string"), one(spark, "x", ["1", "2"], "string"), ["x"]).first()
    assert mixed.d is None and mixed.reason == "not numeric"


def test_leakage_boundaries(spark):
    truth = ["1"] * 50 + ["0"] * 50
    near = [("0" if t == "1" else "1") if i % 20 == 0 else t for i, t in enumerate(truth)]
    rows = list(zip(truth, near, [f"u{i}" for i in range(100)], truth[:3] + [None] * 97))
    df = spark.createDataFrame(rows, "y_true string, near string, user_id string, copy string")
    got = {(r.feature, r.method) for r in lk.scan(df, ["near", "user_id", "copy"]).collect()}
    assert ("near", "near_target_copy") in got and ("user_id", "unique_identifier") in got
    assert ("copy", "exact_target_copy") in got and ("copy", "target_copy_review") not in got


def test_temporal_order(spark):
    rows = [("2026-01-02T00:00:00Z", "2026-01-01T00:00:00Z"), ("2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z"), ("", "x"), ("2026-01-01", "2026-01-01T00:00:00Z")]
    df = spark.createDataFrame(rows, "p string, o string")
    assert tuple(lk.temporal_order(df, "p", "o").first()) == (2, 1, 1, 1)
