import math
import random

import numpy as np
import pytest

from plumbline.operators import concepts as co
from plumbline.operators import impact as im
from plumbline.operators import images as img
from plumbline.operators import inference as inf
from plumbline.operators import neardup as nd


@pytest.mark.parametrize("hot, probe", [(2000, 16), (1, 1)])
def test_neighbors_match_brute_force(spark, hot, probe):
    """Random clusters plus a crowd sharing many zero bits; the second case refines every key."""
    random.seed(11)
    hashes = {0}
    for _ in range(12):
        base = random.getrandbits(64)
        for _ in range(6):
            h = base
            for b in random.sample(range(64), random.randint(0, 8)):
                h ^= 1 << b
            hashes.add(h)
    hashes |= {sum(1 << b for b in random.sample(range(20), random.randint(1, 4))) for _ in range(30)}
    signed = sorted(h - (1 << 64) if h >> 63 else h for h in hashes)
    df = spark.createDataFrame([(h,) for h in signed], "hash long")
    got = sorted((r.hash_a, r.hash_b, r.distance) for r in nd.hash_neighbors(df, 6, hot, probe).collect())
    dist = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = [(a, b, dist(a, b)) for i, a in enumerate(signed) for b in signed[i + 1 :] if dist(a, b) <= 6]
    assert got == sorted(want)


def test_pairs_collapse_copies_and_find_leaks(spark):
    rows = [(1, 5, "train"), (2, 5, "train"), (3, 5, "train"), (4, 5, "val"), (5, 5, "val"), (6, 4, "test"), (7, -1, "val"), (8, None, "val")]
    df = spark.createDataFrame(rows, "id long, hash long, split string")
    pairs = nd.near_dup_pairs(df)
    assert sum(r.pairs for r in pairs.collect()) == 10 + 5
    assert sum(r.pairs for r in pairs.filter("cross").collect()) == 6 + 3
    assert sorted(r.id for r in nd.leaked_ids(df).collect()) == [4, 5, 6]
    preds = spark.createDataFrame([(r[0], r[2], 1, int(r[0] != 7)) for r in rows], "id long, split string, y_true long, y_pred long")
    gap = nd.leak_accuracy_gap(preds, nd.leaked_ids(df)).first()
    assert (gap.n_leaked, gap.n_clean, gap.acc_leaked, gap.acc_clean, gap.severity) == (3, 2, 1.0, 0.5, "critical")


def test_wilson_edges(spark):
    df = spark.createDataFrame([(0, 0), (0, 100), (50, 100), (100, 100)], "k long, n long")
    rows = inf.wilson_ci(df).collect()
    assert (rows[0].low, rows[0].high) == (0.0, 0.0)
    assert rows[1].low == 0.0 and 0.03 < rows[1].high < 0.04
    assert rows[2].low == pytest.approx(0.4038, abs=1e-4)
    assert rows[3].high == 1.0


def test_two_proportion_and_exact(spark):
    df = spark.createDataFrame([(50, 100, 10, 100), (1, 10, 9, 10), (3, 30, 0, 30), (0, 0, 5, 10)], "k1 long, n1 long, k2 long, n2 long")
    a, b, c, d = inf.two_proportion(df).collect()
    assert a.test == "z_test" and 0.27 < a.diff_low < 0.31 and 0.49 < a.diff_high < 0.53 and a.p < 1e-6
    assert b.test == "fisher_exact" and b.p < 0.01 and b.underpowered
    assert c.rr_infinite and c.risk_ratio is None
    assert d.underpowered and d.p == pytest.approx(1.0)


def test_exact_p_matches_direct_sum():
    random.seed(2)
    for _ in range(60):
        n1, n2 = random.randint(1, 60), random.randint(1, 60)
        k1, k2 = random.randint(0, n1), random.randint(0, n2)
        chance = lambda x: math.comb(k1 + k2, x) * math.comb(n1 + n2 - k1 - k2, n1 - x) / math.comb(n1 + n2, n1)  # noqa: B023, E731
        low, high = max(0, n1 - (n1 + n2 - k1 - k2)), min(n1, k1 + k2)
        want = sum(chance(x) for x in range(low, high + 1) if chance(x) <= chance(k1) * (1 + 1e-9))
        assert inf.exact_p(k1, n1, k2, n2) == pytest.approx(want, rel=1e-9)
    assert inf.exact_p(2, 4_000_000, 1, 3_000_000) <= 1.0


def test_bh_and_kappa(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.04]
    df = spark.createDataFrame([("i", k, v) for k, v in enumerate(p)], "investigation string, id int, p double")
    got = {r.id: r.p_adjusted for r in inf.bh_adjust(df, ("investigation",)).collect()}
    assert [got[i] for i in range(5)] == pytest.approx([0.025, 0.04, 0.04, 0.025, 0.04])
    same = spark.createDataFrame([(1, 1)] * 4, "r1 int, r2 int")
    assert inf.cohen_kappa(same).first().kappa == 1.0
    half = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0)], "r1 int, r2 int")
    assert inf.cohen_kappa(half).first().kappa == pytest.approx(0.0)


def test_concept_verdict_supported_and_unreliable(spark):
    rows = [(i, "c", int(i < 60), f"s{i % 2}", "production", i < 45 or i >= 114) for i in range(120)]
    labelled = spark.createDataFrame(rows, "id long, concept_id string, label int, site string, split string, is_error boolean")
    none = spark.createDataFrame([], "concept_id string, r1 int, r2 int")
    assert co.concept_verdict(labelled, none).first().verdict == "supported"
    noisy = spark.createDataFrame([("c", 1, 0), ("c", 0, 1), ("c", 1, 1), ("c", 0, 0)], "concept_id string, r1 int, r2 int")
    assert co.concept_verdict(labelled, noisy).first().verdict == "unreliable_labelling"


def test_quantile_slices_collapse_equal_cuts(spark):
    n = 40
    preds = spark.createDataFrame([(i, i % 2, int(i < 20)) for i in range(n)], "id long, y_true long, y_pred long")
    profiles = spark.createDataFrame([(i, 1.0 if i < 30 else float(i)) for i in range(n)], "id long, sharpness double")
    rows = im.quantile_slices(preds, profiles, {"sharpness": 4}, 1).collect()
    assert sorted((r.n, r.value) for r in rows) == [
        (1, "sharpness [1.00 to 30.00]"), (9, "sharpness [> 30.00]"), (30, "sharpness [min to 1.00]")
    ]
    assert [r.n for r in im.quantile_slices(preds, profiles, {"sharpness": 4}, 10).collect()] == [30]


def test_image_profile_of_known_pictures(spark):
    flat = np.full(16 * 16 * 3, 100.0)
    ramp = np.repeat(np.tile(np.arange(16) * 10.0, 16), 3)
    df = spark.createDataFrame([(1, 16, 16, flat.tolist()), (2, 16, 16, ramp.tolist()), (3, 0, 0, [])], "id long, width int, height int, pixels array<double>")
    rows = {r.id: r for r in img.profile_images(df).collect()}
    assert set(rows) == {1, 2}
    assert rows[1].mean_luminance == pytest.approx(100) and rows[1].sharpness == 0 and rows[1].jpeg_quality == 95
    assert rows[1].dhash == "0" * 16 and rows[1].dominant_hue == 15
    assert rows[2].dhash == "0" * 16 and rows[2].ahash == "0f" * 8 and rows[2].jpeg_quality == 100
    assert rows[2].edge_density == 1.0 and rows[2].colorfulness == pytest.approx(0, abs=1e-9)
