"""Sketch modes against exact results, with their error bounds."""

import random

import numpy as np
from plumbline.operators import calibration as cal
from plumbline.operators import drift as dr
from plumbline.operators import impact as im
from plumbline.operators import sketches as sk
from pyspark.sql import functions as F

LINES = "/root/testdata/sf0.01/lineitem.parquet"


def sides(spark):
    items = spark.read.parquet(LINES)
    return items.where("l_orderkey % 3 = 0"), items.where("l_orderkey % 3 <> 0 AND l_quantity > 10")


def test_distances_are_within_the_bound(spark):
    ref, comp = sides(spark)
    columns = ["l_quantity", "l_extendedprice", "l_tax"]
    exact = {r.feature: r for r in dr.ecdf_distances(ref, comp, columns).collect()}
    daily = lambda df: sk.number_sketches(df.withColumn("day", F.to_date("l_shipdate")), columns, ["day"])
    got = sk.distances(sk.merged_numbers(daily(ref)), sk.merged_numbers(daily(comp))).collect()
    assert {r.feature for r in got} == set(columns)
    bound = 2 * (sk.rank_error() + 1 / sk.STEPS)
    for r in got:
        want = exact[r.feature]
        spread = ref.unionByName(comp).agg(F.max(r.feature) - F.min(r.feature)).first()[0]
        assert (r.n_ref, r.n_comp) == (want.n_ref, want.n_comp)
        assert abs(r.ks - want.ks) <= bound and abs(r.w1 - want.w1) <= bound * spread


def test_equal_frequency_cuts(spark):
    ref, _ = sides(spark)
    row = sk.quantile_cuts(sk.number_sketches(ref, ["l_extendedprice"]), 10).first()
    values = np.sort([r[0] for r in ref.select("l_extendedprice").collect()])
    ranks = np.searchsorted(values, row.cuts, "right") / len(values)
    assert np.abs(ranks - np.arange(1, 10) / 10).max() <= sk.rank_error() + 1 / len(values)
    few = spark.createDataFrame([(1.0,)] * 9 + [(2.0,)], "x double")
    assert sk.quantile_cuts(sk.number_sketches(few, ["x"]), 4).first().cuts == [1.0]


def test_odd_numbers_have_no_part(spark):
    odd = spark.createDataFrame([(None, "a"), (float("nan"), "a"), (float("inf"), "b"), (3.0, "b")], "x double, g string")
    assert [(r.g, r.feature, r.n, r.low) for r in sk.number_sketches(odd, ["x"], ["g"]).collect()] == [("b", "x", 1, 3.0)]
    assert sk.number_sketches(odd.where("false"), ["x"]).count() == 0


def test_distinct_counts_merge(spark):
    items = spark.read.parquet(LINES)
    columns = ["l_orderkey", "l_partkey", "l_returnflag"]
    parts = sk.distinct_sketches(items, columns, ["l_linestatus"])
    got = {r.feature: r for r in sk.distinct_counts(parts).collect()}
    for c in columns:
        exact = items.select(c).distinct().count()
        assert got[c].n == items.count() and abs(got[c].distinct - exact) <= 3 * sk.hll_error() * exact + 1


def test_unseen_and_shared_values(spark):
    ref, comp = sides(spark)
    got = {r.feature: r for r in sk.unseen_estimates(sk.value_sketches(ref, ["l_partkey", "l_tax"]), sk.value_sketches(comp, ["l_partkey", "l_tax", "l_returnflag"])).collect()}
    for c in ("l_partkey", "l_tax"):
        a, b = ({r[0] for r in df.select(c).distinct().collect()} for df in (ref, comp))
        slack = 3 * sk.theta_error() * len(a | b) + 1
        assert abs(got[c].unseen - len(b - a)) <= slack and abs(got[c].shared - len(a & b)) <= slack
    assert got["l_returnflag"].unseen == got["l_returnflag"].seen == 3 and got["l_returnflag"].shared == 0
    columns = ["l_quantity", "l_discount", "l_returnflag"]
    rows = sk.unseen_estimates(sk.tuple_sketch(ref, columns), sk.tuple_sketch(comp, columns)).first()
    a, b = ({tuple(r) for r in df.select(*columns).distinct().collect()} for df in (ref, comp))
    assert abs(rows.shared - len(a & b)) <= 3 * sk.theta_error() * len(a | b) + 1


def test_merging_does_not_depend_on_the_parts(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.gauss(0, 1), i % 7) for i in range(5000)], "x double, g int")
    whole, parts = sk.number_sketches(rows, ["x"]), sk.merged_numbers(sk.number_sketches(rows, ["x"], ["g"]))
    r = sk.distances(whole, parts).first()
    assert r.n_ref == r.n_comp == 5000 and r.ks <= 2 * (sk.rank_error() + 1 / sk.STEPS)


def test_equal_frequency_bins_from_sketches(spark):
    rng = random.Random(12)
    scores = [rng.random() ** 3 for _ in range(40_000)] + [0.25] * 6000 + [0.0, 1.0]
    ev = spark.createDataFrame([(i, str(i % 2), "0", p) for i, p in enumerate(scores)], "row_id long, y_true string, y_pred string, y_probability double").repartition(6)
    exact, about = (cal.calibration_equal_frequency(ev, 10, approx=a).collect() for a in (False, True))
    assert sum(r.n for r in exact) == sum(r.n for r in about) == len(scores)
    known = sorted(scores)
    slack = sk.rank_error() * len(known) + 1
    for i, r in enumerate(sorted(about, key=lambda r: r.lower)[1:], 1):
        below, upto = (np.searchsorted(known, r.lower, side) for side in ("left", "right"))
        assert any(below - slack <= len(known) * j / 10 <= upto + slack for j in range(1, 10))
    assert cal.calibration_equal_frequency(ev.where("false"), 10, approx=True).count() == 1


def test_quantile_slices_from_sketches(spark):
    rng = random.Random(13)
    n = 20_000
    preds = spark.createDataFrame([(i, i % 2, int(rng.random() < 0.3)) for i in range(n)], "id long, y_true long, y_pred long")
    profiles = spark.createDataFrame([(i, rng.gauss(0, 1), float(i % 3), None if i else 1.0) for i in range(n)], "id long, sharpness double, noise double, colorfulness double")
    bins = {"sharpness": 5, "noise": 4, "colorfulness": 5}
    exact, about = im.quantile_cuts(profiles, bins), im.sketched_cuts(profiles, bins)
    assert set(exact) == set(about) == {"sharpness", "noise"} and [len(about[f]) for f in ("sharpness", "noise")] == [4, 3]
    values = np.sort([r[0] for r in profiles.select("sharpness").collect()])
    assert np.abs(np.searchsorted(values, about["sharpness"], "right") / n - np.arange(1, 5) / 5).max() <= sk.rank_error() + 1 / n
    assert set(about["noise"]) <= {0.0, 1.0, 2.0}
    rows = im.quantile_slices(preds, profiles, bins, approx=True).collect()
    assert sum(r.n for r in rows if r.dimension == "feature:sharpness") == n
