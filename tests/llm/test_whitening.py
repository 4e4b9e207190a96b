import math

import numpy as np
import pyarrow.parquet as pq
import pytest
from plumbline.llm import whitening as W

SMALL = "/root/testdata/sf0.001/embeddings.parquet"


def plain(rows):
    """({id: (deviation, whitened up to sign)}, explained, n) by numpy over all rows at once."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    scaled = x * n - sums
    centred = (scaled / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[: W.COMPONENTS]
    return (scaled * scaled).sum(1), centred @ vectors[:, order] / np.sqrt(values[order]), values[order] / values.sum(), n


def compare(got, rows):
    deviation, white, explained, n = plain(rows)
    k = white.shape[1]
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    sign = None
    for (i, _), d, w in zip(rows, deviation, white):
        mine = np.array([by_id[i][c].whitened for c in range(1, k + 1)])
        sign = np.sign(mine * w) if sign is None else sign
        assert np.allclose(mine * sign, w, atol=1e-8)
        assert {by_id[i][c].deviation for c in range(1, k + 1)} == {d}
    assert np.allclose([by_id[rows[0][0]][c].explained for c in range(1, k + 1)], explained, rtol=1e-9)
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert len(got) == k * len(rows)


@pytest.mark.parametrize("block, width", [(W.ROWS, W.WIDTH), (7, 24)])
def test_given_table(spark, monkeypatch, block, width):
    monkeypatch.setattr(W, "ROWS", block)
    monkeypatch.setattr(W, "WIDTH", width)
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(SMALL).to_pylist()]
    given = spark.read.parquet(SMALL).repartition(5)
    compare(W.whiten(given).collect(), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=5)]) for i in range(40)]
    odd = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0]), (93, [math.inf] * 5), (94, [math.nan] * 5), (95, [1.0] * 4), (96, [1e300] * 5)]
    docs = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 AS x", "2 AS part", "'a' AS ids")
    compare(W.whiten(docs).collect(), rows)


def test_components_without_variance(spark):
    rows = [(None, [1.0, 2.0, 3.0]), (1, [1.0, 2.5, 3.0]), (1, [1.0, 2.5, 3.0])]
    got = sorted(((r.vec_id or 0, r.component), r.whitened, r.explained, r.identity_error) for r in W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert len(got) == 9 and all((g[1] is None) == (g[0][1] > 1) for g in got)
    assert got[0][2] == pytest.approx(1) and abs(got[0][1]) == pytest.approx(math.sqrt(2)) and got[0][3] < 1e-9
    same = W.whiten(spark.createDataFrame([(1, [2.0, 2.0])] * 3, "vec_id long, embedding array<double>")).collect()
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.deviation == 0 for r in same)


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [float(2**50 * (i % 3)), float(i)]) for i in range(9)]
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = plain(rows)[0]
    assert all(r.deviation is None if want[r.vec_id] >= 1 << 63 else r.deviation == want[r.vec_id] for r in got)
    assert any(r.deviation is None for r in got)


def test_empty_table(spark):
    assert W.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0
