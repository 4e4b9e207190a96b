"""The catalog as the driver sees it, on the smallest tables."""

import __spark_entry__ as entry
import pytest
from plumbline.plans.registry import ORACLE, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_query_but_the_image_job_has_an_oracle():
    assert set(QUERIES) - set(ORACLE) == {"profile_images"}
    assert not set(ORACLE) - set(QUERIES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 11


@pytest.mark.parametrize("name", ["confusion", "slice_metrics", "near_dup_pairs", "j_integrity", "leak_temporal"])
def test_agrees_with_duckdb(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "customer", "lineitem", "embeddings", "events", "documents", "labels", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    want = sorted(repr(r) for r in cur.fetchall())
    got = sorted(repr(tuple(r)) for r in QUERIES[name](spark, SMALL).select(*columns).collect())
    assert got == want
