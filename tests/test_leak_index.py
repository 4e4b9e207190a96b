"""The kept key index of the duplicate alert."""

import random

from plumbline.plans.catalog import streaming
from plumbline.streaming import monitors as mon


def test_index_is_extended_and_not_moved(spark, tmp_path):
    rng = random.Random(4)
    known = [rng.getrandbits(62) for _ in range(300)]
    asked = [(i, h ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 9)))) for i, h in enumerate(known[::3])] + [(900, None)]
    frame = lambda hashes: spark.createDataFrame([(h,) for h in hashes], "hash long")
    mon.index_training(frame(known[:200]), "leak_keys", f"{tmp_path}/keys", buckets=4)
    mon.index_training(frame([*known[100:], None, known[5]]), "leak_keys", f"{tmp_path}/keys", buckets=4)
    assert spark.table("leak_keys").count() == 84 * 300
    incoming = spark.createDataFrame(asked, "id long, hash long")
    found = mon.duplicate_leak_alert(incoming, "leak_keys")
    distance = lambda a, b: (a ^ b).bit_count()
    want = sorted((i, t, distance(h, t)) for i, h in asked if h is not None for t in known if distance(h, t) <= 6)
    assert sorted(tuple(r) for r in found.collect()) == want == sorted(tuple(r) for r in mon.duplicate_leak_alert(incoming, frame(known)).collect())
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    spark.sql("DROP TABLE leak_keys")


def test_a_table_may_be_a_file_or_a_folder(spark, tmp_path):
    """A table written by Spark is a folder whose parts have names of their own."""
    rows = spark.range(40).selectExpr("id", "id * 3 AS x")
    rows.repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    rows.toPandas().to_parquet(f"{tmp_path}/one.parquet", index=False)
    rows.limit(1).write.parquet(f"{tmp_path}/other.parquet")
    for name in ("many", "one"):
        read = mon.run_to_table(streaming._stream(spark, str(tmp_path), name), f"{tmp_path}/{name}-run")
        assert sorted(tuple(r) for r in read.collect()) == [(i, 3 * i) for i in range(40)]
