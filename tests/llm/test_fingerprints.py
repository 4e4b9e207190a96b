import hashlib
import random
import re

import pytest
from plumbline.llm import fingerprints as FP
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001/documents.parquet"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_print(hashes_and_weights):
    """The fingerprint's hex digits from ((h0, h1), weight) of every term."""
    total = sum(w for _, w in hashes_and_weights)
    out = ""
    for i in range(2):
        votes = [sum(w for h, w in hashes_and_weights if h[i] >> b & 1) for b in range(64)]
        out += f"{sum(1 << b for b in range(64) if 2 * votes[b] > total):016x}"
    return out


def plain_terms(spark, texts):
    """Terms and weights in Python, hashes by the session's XXH64 row by row."""
    rows = []
    for t in texts:
        words = [w for w in re.split(r"[\x09-\x0D\x20]+", t.lower()) if w]
        for i in range(len(words)):
            term = words[i : i + 3]
            rows.append((t, *(term + [None] * (3 - len(term))), min(16, sum(len(w.encode()) for w in term))))
    df = spark.createDataFrame(rows, "t string, a string, b string, c string, w int")
    hashed = df.select("t", "w", F.xxhash64(F.lit(0), "a", "b", "c").alias("h0"), F.xxhash64(F.lit(1), "a", "b", "c").alias("h1")).collect()
    by = {t: [] for t in texts}
    for r in hashed:
        by[r.t].append(((r.h0 % (1 << 64), r.h1 % (1 << 64)), r.w))
    return {t: plain_print(x) for t, x in by.items()}


def test_edited_texts_and_likeness(spark):
    docs = spark.read.parquet(SMALL)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows += [(500, None), (501, ""), (502, "Ä"), (None, "none id"), (7, "a tie"), (7, "a tie"), (503, "word " * 5000 + "end")]
    given = spark.createDataFrame(rows, "doc_id long, text string").withColumn("range", F.lit("x")).withColumn("fp", F.lit(1))
    got = FP.edited_fingerprints(given).collect()
    assert len(got) == len(rows)
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        want.append((d, t, t[: len(t) - half] + after[:half], after))
    prints = plain_terms(spark, sorted({x for w in want for x in w[1:]}))

    def like(a, b):
        return 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128

    expected = [
        (d, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t], prints[e], like(prints[t], prints[e]), like(prints[t], prints[n])) for d, t, e, n in want
    ]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


@pytest.mark.parametrize("radius, blocks", [(0, 2), (3, 8), (6, 8), (3, 4)])
def test_search_agrees_with_all_pairs(spark, radius, blocks):
    rng = random.Random(3)
    prints = {rng.getrandbits(128) for _ in range(30)}
    for p in list(prints):
        for _ in range(4):
            x = p
            for b in rng.sample(range(128), rng.randint(0, 8)):
                x ^= 1 << b
            prints.add(x)
    prints = sorted(prints)
    both = lambda x: [signed(x & (1 << 64) - 1), signed(x >> 64)]
    frame = spark.createDataFrame([(both(p),) for p in prints], "fp array<long>")
    asked = spark.createDataFrame([(both(p),) for p in prints[::3]], "fp array<long>")
    found = sorted((tuple(r.query), tuple(r.found), r.distance) for r in FP.near(frame, asked, radius, blocks).collect())
    want = sorted((tuple(both(q)), tuple(both(p)), (p ^ q).bit_count()) for q in prints[::3] for p in prints if (p ^ q).bit_count() <= radius)
    assert found == want
    dealt = FP.near(frame, asked, radius, blocks, hot=2)
    assert sorted((tuple(r.query), tuple(r.found), r.distance) for r in dealt.collect()) == want
    assert FP.near(frame.where("false"), asked, radius, blocks).count() == FP.near(frame, asked.where("false"), radius, blocks).count() == 0


def test_numbers_of_near_documents(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(128) for _ in range(20)]
    prints = [b ^ sum(1 << x for x in rng.sample(range(128), rng.randint(0, 4))) for b in base for _ in range(30)]
    rows = [(i * 20 if i % 7 else None if i == 0 else i, f"{p:032x}") for i, p in enumerate(prints)]
    rows += rows[100:110]
    got = FP.with_near(spark.createDataFrame(rows, "doc_id long, fingerprint string").withColumn("n", F.lit("x"))).collect()
    near = lambda p: sum((int(p, 16) ^ int(q, 16)).bit_count() <= 3 for _, q in rows) - 1
    want = [(d, p, "x", near(p) if d is not None and d % 100 == 0 else None) for d, p in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_empty_table_and_a_single_row(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert FP.edited_fingerprints(empty).count() == 0
    row = FP.edited_fingerprints(spark.createDataFrame([(4, "one two three four")], "doc_id long, text string")).collect()
    assert len(row) == 1 and row[0].near_next == 1.0 and row[0].n_chars == 18
