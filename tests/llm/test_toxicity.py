import random
import zlib

import numpy as np
from plumbline.llm import toxicity as T
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.1"


def test_scores_by_the_formula_of_all_pairs():
    rng = np.random.default_rng(1)
    m = T.Machine({}, 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    for places in ([], [2], [0, 3, 8], list(range(9))):
        x = 0.3 + sum(m.w[i] for i in places) + sum(m.v[i] @ m.v[j] for i in places for j in places if i < j)
        assert abs(m.score(places) - 1 / (1 + np.exp(-x))) < 1e-9


def test_learns_a_pair_that_neither_term_tells():
    rng = random.Random(1)
    rows, y = [], []
    for _ in range(2000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        rows.append([i for i, on in enumerate((a, b)) if on])
        y.append(int(a == b))
    m = T.fit(rows, y, {0: 0, 1: 1})
    assert m.score([0, 1]) > 0.8 and m.score([0]) < 0.2 and m.score([1]) < 0.2


def test_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    out = T.toxicity(docs, labels)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == ["doc_id bigint", "held_out boolean", "score double", "predicted int"]
    rows = out.collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    toxic, clean = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    assert sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean) > 0.97
    assert sum(p for _, t, p in held if not t) <= 0.005 * len(clean) and sum(p for _, t, p in held if t) >= 0.65 * len(toxic)


def test_odd_rows_and_labels(spark):
    rows = [(i, "you awful clown thing" if i % 4 == 0 else "a fine day it was") for i in range(400)]
    rows += [(None, "awful clown"), (1, "a fine day it was"), (500, None), (501, ""), (502, "clown " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(9))
    marks = [(i, 1 if i % 4 == 0 else 0) for i in range(400)] + [(3, 0), (None, 1), (6, None), (7, 5)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int").withColumn("text", F.lit("z"))
    by = {(r.doc_id, r.text): r.s for r in T.with_score(docs, T.train(docs, labels), "s").collect()}
    assert by[None, "awful clown"] > 0.7 and by[500, None] == by[501, ""] < 0.5 and by[502, "clown " * 30_000] > 2 * by[501, ""]
    kept = T.keep_civil(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {500, 501, 1, 2, 3}
    assert not {r.doc_id for r in kept.collect()} & {0, 4, 8}
    empty = labels.where("false")
    assert {r.predicted for r in T.toxicity(docs, empty).collect()} == {0}
    assert T.toxicity(docs.where("false"), labels).count() == 0
    assert len({r.score for r in T.toxicity(docs, labels.where("toxic = 0")).collect()}) == 1


def test_sample_is_bounded_and_leaves_the_held_out_fold(spark):
    labels = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    ids = [r.doc_id for r in T.sample(labels, 100).collect()]
    assert len(ids) == 100 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)


def test_learns_terms_that_tell_only_as_a_pair_among_many_others(spark):
    rng = random.Random(5)
    others = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(2500)]

    def text(first, second):
        return " ".join([*rng.sample(others, 30), first, second])

    # each of the four words is in half of the documents, and toxic as often as not; only their pairs tell
    pairs = [(a, b) for a in ("frobber", "grubble") for b in ("glinter", "shaleish")]
    learnt, chosen = 0, []
    for i in range(3000):  # in equal parts among those that teach
        chosen.append(pairs[learnt % 4])
        learnt += zlib.crc32(str(i).encode()) % 3 != 1
    docs = spark.createDataFrame([(i, text(*p)) for i, p in enumerate(chosen)], "doc_id long, text string")
    toxic = {i: int(p in (pairs[0], pairs[3])) for i, p in enumerate(chosen)}
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    held = [r for r in T.toxicity(docs, labels).collect() if r.held_out]
    assert sum((r.score > 0.5) == bool(toxic[r.doc_id]) for r in held) > 0.95 * len(held)
