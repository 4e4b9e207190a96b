import re

import pyarrow.parquet as pq
import pytest
import xxhash
from plumbline.llm import simhash_dedup as S
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001/documents.parquet"


def plain_print(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """{index: smallest id reachable} of (id, fingerprint) pairs, every pair compared."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        least.setdefault(find(i), []).append(d)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(prints))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_follows_its_definition():
    long = "ab " * 70_000 + "É Straße ſ \x1c x\x0by"
    for text in ["", None, " \n", "One", "one TWO", "a b c", "a  b\tc d", "É é Ö", long]:
        assert S.fingerprint(text) == plain_print(text)


def test_agrees_with_all_pairs(spark):
    rows = pq.read_table(SMALL, columns=["doc_id", "text"]).to_pylist()
    texts = [(r["doc_id"], r["text"]) for r in rows] + [(None, rows[3]["text"]), (900, None), (901, ""), (3, "a b"), (3, "a b")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("root", F.lit(1))
    prints = [(d, plain_print(t)) for d, t in texts]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, plain_groups(prints))), key=repr)
    got = sorted((tuple(r) for r in S.near_dedup(docs).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("tile", [S.TILE, 7])
def test_dense_cells_chains_and_tiles(spark, tile):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = set(base)
    for b in base[:20]:
        for _ in range(30):
            x = b
            for bit in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    pairs = S.links(frame, tile)
    rows = pairs.collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in rows)
    roots = {r.node: r.root for r in S.components(pairs).collect()}
    want = plain_groups([(i, p) for i, p in enumerate(prints)])
    ids = [roots.get(signed(p), signed(p)) for p in prints]
    assert len(set(ids)) == len(set(want)) == len(set(zip(ids, want)))


def test_links_stay_few_in_a_dense_group(spark):
    prints = [signed(sum(1 << b for b in range(11) if i >> b & 1)) for i in range(2048)]
    frame = spark.createDataFrame([(p,) for p in prints], "fp long").coalesce(1)
    assert S.links(frame).count() < 40 * len(prints)
    assert {r.root for r in S.components(S.links(frame)).collect()} == {0}


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text, "a"), (2, text, "b"), (2, text, "b"), (2, "other words here now", "c"), (None, "lone text of words", "d"), (5, None, "e"), (9, "", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, best string")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [rows[1], rows[3], rows[4], rows[5]]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_dedup(docs).count() == 0 and S.keep_one(docs).count() == 0
