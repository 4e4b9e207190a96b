import corpus_pipeline
import pytest
from plumbline.llm import language, packing, simhash_dedup, toxicity
from plumbline.llm.queries import QUERIES, TOKENIZER
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_stages_by_hand(spark):
    """run() against the stages' decisions taken row by row in Python."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs.collect()
    machine = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    places = toxicity._Places(machine.place)
    rows = [r for r in rows if machine.score(toxicity._active(r.text, places)) < toxicity.THRESHOLD]
    known = language.train(spark.createDataFrame(rows, docs.schema))
    rows = [r for r in rows if (p := known.predict(r.text))[0] != "und" and p[1] >= language.MIN_SCORE]
    prints = [(r.doc_id, simhash_dedup.fingerprint(r.text)) for r in rows]
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
        least[find(i)] = min(d, least.get(find(i), d))
    kept = {r.doc_id: r.text for r in rows if r.doc_id in set(least.values())}
    ids = packing.Ids(TOKENIZER)
    want = sorted((d, len(ids(t)) // 4 + 1) for d, t in kept.items())
    got = corpus_pipeline.run(spark, FOLDER).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert sorted((r.doc_id, r.n) for r in got) == want
    assert len(kept) < len(docs.collect())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).schema == docs.schema
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
