"""Near hashes where very many share most of their bits."""

import random

import pytest
from plumbline.operators import neardup as nd


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def apart(a, b):
    return bin((a ^ b) & (2**64 - 1)).count("1")


def crowd(rng, n, free, high=0):
    """Distinct hashes that differ in the bits ``free`` only."""
    out = set()
    while len(out) < n:
        out.add(signed(high | sum(1 << b for b in free if rng.random() < 0.5)))
    return sorted(out)


@pytest.mark.parametrize("k, free, hot", [(6, 30, 20), (6, 18, 20), (3, 40, 10), (15, 64, 50), (30, 64, 40), (0, 30, 5)])
def test_crowds_match_brute_force(spark, k, free, hot):
    rng = random.Random(k * 100 + free)
    places = rng.sample(range(64), free)
    hashes = crowd(rng, 250, places, 0 if free == 64 else 1 << next(b for b in range(63, -1, -1) if b not in places))
    hashes = sorted({*hashes, *(signed((h ^ 1 << rng.randrange(64)) & (2**64 - 1)) for h in hashes[:40])})
    df = spark.createDataFrame([(h,) for h in hashes], "hash long")
    got = [(r.hash_a, r.hash_b, r.distance) for r in nd.hash_neighbors(df, k, hot, 1).collect()]
    want = [(a, b, apart(a, b)) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if apart(a, b) <= k]
    assert sorted(got) == sorted(want)
    asks, filed = hashes[::3], hashes[1::3] + hashes[:6:3]
    frame = lambda some: spark.createDataFrame([(h,) for h in [*some, None]], "hash long")
    near = sorted(r.hash for r in nd.near_hashes(frame(asks), frame(filed), k, hot, 1).collect())
    assert near == sorted(a for a in asks if any(apart(a, f) <= k for f in filed))


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], "hash long"), spark.createDataFrame([(5,)], "hash long")
    assert nd.hash_neighbors(none).count() == 0 and nd.hash_neighbors(none, 30).count() == 0
    assert nd.near_hashes(none, one).count() == nd.near_hashes(one, none).count() == 0
    with pytest.raises(ValueError):
        nd.hash_neighbors(one, 65)


def test_many_hashes_share_forty_bits(spark):
    """All pairs meet under few keys; the split uses the bits that differ, so no group holds a large share."""
    rng = random.Random(8)
    hashes = crowd(rng, 50_000, range(24), 1 << 50)
    df = spark.createDataFrame([(h,) for h in hashes], "hash long").repartition(4)
    meetings = list(nd._meetings(nd.cut(df.selectExpr("hash", "true asks", "true filed")), 1, 2000, 16))
    largest = max(m.rows.groupBy(*m.keys).count().agg({"count": "max"}).first()[0] or 0 for m in meetings)
    assert largest <= 4000 and not meetings[-1].blocked
    got = {(r.hash_a, r.hash_b) for r in nd.hash_neighbors(df, 1).collect()}
    there = set(hashes)
    assert got == {(h, h ^ 1 << b) for h in hashes for b in range(24) if h < h ^ 1 << b and h ^ 1 << b in there}


def test_keyed_rows_are_never_broadcast(spark):
    """A small file of hashes explodes into 84 keys each, which Spark's estimate does not see."""
    df = nd.cut(spark.range(3000).selectExpr("xxhash64(id) hash", "id % 2 = 0 asks", "id % 2 = 1 filed"))
    gone = spark.createDataFrame([], "hash long")
    for meeting in nd._meetings(df, 6, 100, 1):
        for found in (meeting.pairs(6), meeting.met(6, gone)):
            depth = None
            for line in found._jdf.queryExecution().executedPlan().toString().splitlines():
                at = len(line) - len(line.lstrip(" :+-"))
                depth = None if depth is not None and at <= depth else depth
                if "BroadcastExchange" in line:
                    depth = at
                assert depth is None or "Generate explode" not in line
