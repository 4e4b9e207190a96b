import re

from plumbline.llm import licenses as L
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.01/documents.parquet"


def plain(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = [(i, t.label) for t in L.PHRASES for i in range(len(words)) if tuple(words[i : i + len(t.words)]) == t.words]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))


def plain_templates(words, weights):
    """(template, start, score) by trying every template at every place."""
    found = []
    for n, t in enumerate(L.TEMPLATES):
        total = sum(weights[w] for w in t.words)
        for start in range(-len(t.words), len(words)):
            there = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words)]
            score = sum(weights[w] for w, x in zip(t.words, there) if x) / total
            if all(there[t.first : t.last]) and score >= L.ENOUGH:
                found.append((n, start, round(score, 9)))
    return sorted(found)


ODD = [
    None,
    "",
    "MIT License",
    "mit-license, apache_license; the GNU general\npublic license",
    "mit licenseé mit license2 mıt license Mİt license miK license worK",
    "general public license general public license " * 200 + "x" * 5000,
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "You may not use this FILE except in compliance with the License.",
    "license license license mit mit license license",
]


def test_base_results(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SMALL).select("doc_id", "text").collect()] + [(i, t) for i, t in enumerate(ODD)] + [(None, "mit license")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(3)).withColumn("hits", F.lit(3))
    got = [tuple(r) for r in L.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()]
    assert sorted(map(repr, got)) == sorted(repr((d, *plain(t))) for d, t in rows)
    assert L.scan(docs.where("false")).count() == 0


def test_templates_at_every_place(spark):
    rows = list(enumerate(ODD))
    indexed = L.index_words(spark.createDataFrame(rows, "row long, text string"))
    weights = L.idf(indexed)
    got = {}
    for r in L.places(indexed, weights, "row").collect():
        got.setdefault(r.row, []).append((r.template, r.start, round(r.score, 9)))
    for i, t in rows:
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        assert sorted(got.get(i, [])) == plain_templates(words, weights)


def test_labels_and_score(spark):
    by = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")).collect()}
    assert (by[0].labels, by[0].score) == ("", 0.0)
    assert by[2].labels == "mit" and by[2].score == 1.0
    assert by[6].labels == "mit" and by[6].base_labels == "" and by[6].n_base == 0
    assert by[7].labels == "apache-2.0"
