"""Plans that must hold beyond what the small tables show."""

import random

import pytest
from plumbline.operators import compare as cp
from plumbline.operators import drift as dr
from plumbline.operators import quality as q
from plumbline.operators import running as rn
from plumbline.sources import logs as lg
from pyspark.sql import functions as F


def plain_running(rows, key, order, value):
    by, out = {}, {}
    for r in sorted(rows, key=lambda r: r[order]):
        before, total = by.get(r[key], (None, 0))
        by[r[key]] = (r[value], total + r[value])
        out[r[order]] = (before, total + r[value])
    return out, {k: t for k, (_, t) in by.items()}


@pytest.mark.parametrize("kind", ["hot", "many", "null", "single"])
def test_running_totals_of_hot_and_of_many_parts(spark, kind):
    rng = random.Random(2)
    n = 20_000 if kind == "many" else 3000
    part = {"hot": lambda i: 0 if rng.random() < 0.99 else i % 7, "many": lambda i: i % 2000, "null": lambda i: None if i % 3 else i % 5, "single": lambda i: 1}[kind]
    rows = [{"p": part(i), "at": i * 3, "v": rng.randint(-5, 9)} for i in range(n)]
    df = spark.createDataFrame(rows, "p long, at long, v long").repartition(5)
    want, totals = plain_running(rows, "p", "at", "v")
    got = rn.running(df, "at", {"upto": ("sum", F.col("v")), "before": ("prev", F.col("v"))}, ("p",)).collect()
    assert {r.at: (r.before, r.upto) for r in got} == want and len(got) == n
    assert all(r.all_upto == totals[r.p] for r in got)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_of_a_whole_frame(spark, descending):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 9)) for i in range(4000)]
    df = spark.createDataFrame(rows, "at long, v long").repartition(3)
    got = rn.running(df, "at", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, descending=descending).collect()
    total = most = 0
    by = {r["at"]: (r.s, r.m, r.all_s) for r in got}
    for at, v in sorted(rows, reverse=descending):
        total, most = total + v, max(most, v)
        assert by[at] == (total, most, sum(v for _, v in rows))
    assert rn.running(df.filter("false"), "at", {"s": ("sum", F.col("v"))}).count() == 0


def test_plans_have_no_nested_loop(spark):
    df = spark.range(1000).selectExpr("id AS at", "id % 2 AS p", "1L AS v")
    for part in ((), ("p",)):
        out = rn.running(df.withColumn("p", F.lit(7)), "at", {"s": ("sum", F.col("v"))}, part)
        assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_results_beyond_the_old_limits(spark):
    wide = spark.range(400).selectExpr("CAST(id % 101 AS STRING) AS c", "CAST(concat('w', id % 101) AS STRING) AS w")
    other = wide.selectExpr("c", "concat('x', w) AS w")
    assert q.class_balance(wide, "w").count() == 101
    row = dr.psi(wide.select("w"), other.select("w"), ["w"]).first()
    assert row.psi > 1 and row.reason is None
    assert dr.psi_config(wide.select("w"), other.select("w"), ["w"]).count() == 202
    seen = cp.unseen_values(wide.select("w"), other.select("w"), ["w"]).first()
    assert (seen.unseen, seen.observed) == (400, 400)
    assert cp.unseen_values(wide.select("w"), other.select("w"), ["w"], most=50).count() == 0
    a = spark.createDataFrame([(f"l{i % 20}",) for i in range(20)], "t string")
    b = spark.createDataFrame([("m0",)] * 3 + [("l0",)], "t string")
    assert cp.class_share(a.unionByName(a), b, "t").count() == 2
    many = spark.createDataFrame([(f"l{i}",) for i in range(9)] , "t string")
    assert cp.class_share(many, spark.createDataFrame([("z",)], "t string"), "t").count() == 10
    names = spark.createDataFrame([(i, f"d{i}") for i in range(250)], "position int, dataset string")
    assert dr.dataset_pairs(names).count() == 250 * 249 // 2


def test_deep_json_is_opened_whole(spark):
    text = '{"a":' * 40 + '[1, {"b": "x"}, []]' + "}" * 40
    rows = lg.flatten_json(spark.createDataFrame([(1, text), (2, "7"), (3, "{}"), (4, "nope {")], "k long, t string"), "k", "t").collect()
    path = "_".join(["a"] * 40)
    assert sorted((r.k, r.path, r.value) for r in rows) == [(1, f"{path}_0", "1"), (1, f"{path}_1_b", "x"), (2, "", "7")]


def test_means_do_not_depend_on_the_partitions(spark):
    rng = random.Random(4)
    cells = [(str(rng.randint(0, 9) / 100), str(rng.uniform(-1e-9, 1e9)), str(rng.choice([1e300, -1e300, 1.7e308]))) for _ in range(5000)]
    frame = spark.createDataFrame(cells, "a string, b string, c string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in (2, 8, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(repr, q.column_profile(frame.repartition(n + 1)).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]
    from fractions import Fraction

    by = {r.column: r.mean for r in q.column_profile(frame).collect()}
    for i, c in enumerate("abc"):
        exact = sum(Fraction(x[i]) for x in cells) / len(cells)
        assert by[c] == pytest.approx(float(exact), rel=1e-12)


def test_diagnosis_answers(spark):
    rows = spark.createDataFrame([("leakage", "support", "a", 3), ("shift", "support", "b", 2)], "hypothesis string, kind string, detail string, score int")
    of = lambda **k: {r.hypothesis: (r.score, r.support, r.conflicts) for r in cp.combined_diagnosis(rows, **k).collect()}
    assert of() == {"leakage": (3, 1, 0), "shift": (2, 1, 0)}
    assert of(feature_available="no") == {"leakage": (3, 2, 0), "shift": (2, 1, 0)}
    assert of(same_run="no") == of()
    assert of(same_run="no", sources=("logs", "datasets")) == {"leakage": (2, 1, 1), "shift": (1, 1, 1)}


def plain_psi(a, b, bins):
    import math

    low, high = min(a), max(a)
    cuts = sorted({low * (1 - i / bins) + high * (i / bins) for i in range(1, bins)})
    k = len(cuts) + 1
    count = lambda xs, j: sum(sum(c <= x for c in cuts) == j for x in xs)
    share = lambda xs, j: (count(xs, j) + 0.5) / (len(xs) + k / 2)
    return sum((share(b, j) - share(a, j)) * math.log(share(b, j) / share(a, j)) for j in range(k))


def test_psi_of_fifty_datasets(spark):
    rng = random.Random(6)
    values = {f"d{i}": [rng.gauss(i / 10, 1 + i / 50) for _ in range(30)] for i in range(50)}
    frames = {k: spark.createDataFrame([(v,) for v in x], "x double").coalesce(1) for k, x in values.items()}
    names = list(frames)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    got = {(r.ref, r.comp): r.psi for r in dr.psi_pairs(frames, pairs, ["x"], 5).collect()}
    assert len(got) == len(pairs)
    for a, b in pairs[::37]:
        assert got[a, b] == pytest.approx(plain_psi(values[a], values[b], 5), abs=1e-12)
