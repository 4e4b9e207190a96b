import zlib

import numpy as np
from plumbline.llm import language as L
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


def test_every_stored_gram_is_found():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    places = rng.integers(0, 70, 5000)
    f = L.Filter.build([f"l{i:02}" for i in range(70)], 0, hashes, places)
    for h, p in zip(hashes[:500], places[:500]):
        found = [np.bitwise_and.reduce([f.slots[p // 64][at] for at in L._slots_of(np.array([h]), f.slots.shape[1])])[0]]
        assert int(found[0]) >> int(p % 64) & 1
    assert (f.chance < 0.01).all()


def test_grams_do_not_depend_on_how_long_texts_are_cut(monkeypatch):
    text = "Ärger über 12 große Häuser! " * 50
    whole = np.concatenate(list(L.grams(text)))
    monkeypatch.setattr(L, "CHARS_AT_ONCE", 7)
    assert np.array_equal(np.concatenate(list(L.grams(text))), whole)
    assert list(L.grams(" 12 ½ _ ")) == [] == list(L.grams(""))
    assert len(list(L.grams("é"))) == 1


def test_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = L.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_odd_rows(spark):
    rows = [(i, "the cat and the dog sat there" if i % 2 else "der hund und die katze sitzen dort", "en" if i % 2 else "de") for i in range(80)]
    rows += [(None, "the cat sat", None), (100, None, "en"), (101, "", None), (102, "12 + 3 = ½", "de"), (103, "漢字", None), (1, "the cat and the dog sat there", "en"), (104, "Katze " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    by = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs).collect()}
    assert by[None][0] == "en" and by[104][0] == "de" and by[0][0] == "de" and by[1][0] == "en"
    assert by[100] == by[101] == by[102] == ("und", 0.0)
    assert by[103] == ("en", 0.0) or by[103] == ("de", 0.0)
    kept = L.keep_known(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert not set(ids) & {100, 101, 102, 103} and ids.count(1) == 2 and None in ids and len(ids) == 83
    assert L.identify(docs.where("false")).count() == 0
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in L.identify(unknown).collect()} == {("und", 0.0)}


def test_forty_languages_each_keep_their_ngrams(spark):
    """Languages of different alphabets; one spreads its n-grams over a thousand characters."""
    rng = np.random.default_rng(5)
    alphabets = [[chr(0x4E00 + 1200 * i + j) for j in range(1000 if i == 0 else 12)] for i in range(16)]
    alphabets += [[chr(0x0400 + 8 * i + j) for j in range(8)] for i in range(12)] + [[chr(0x0620 + 2 * i + j) for j in range(6)] for i in range(12)]
    word = lambda a: "".join(rng.choice(a, rng.integers(2, 7)))
    rows, vocabulary = [], {i: [word(a) for _ in range(60 if i else 3000)] for i, a in enumerate(alphabets)}
    for i in range(len(alphabets)):
        rows += [(len(rows) + j, " ".join(rng.choice(vocabulary[i], 40)), f"l{i:02}") for j in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {d: lang for d, _, lang in rows}
    found = L.identify(docs).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in found) >= 0.98 * len(found)
    kept = L.keep_known(docs).groupBy("lang").count().collect()
    assert len(kept) == 40 and all(r["count"] >= 29 for r in kept)


def test_the_share_of_a_language_does_not_shrink_as_others_join(spark, monkeypatch):
    monkeypatch.setattr(L, "GRAMS", 50)
    rng = np.random.default_rng(6)
    words = {lang: ["".join(rng.choice(list(letters), 6)) for _ in range(40)] for lang, letters in (("a", "abcdef"), ("b", "ghijkl"), ("c", "mnopqr"))}
    rows = [(i, " ".join(rng.choice(words[lang], 30)), lang) for i, lang in enumerate("abc" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    alone = L.train(docs.where("lang = 'a'"))
    among = L.train(docs)
    bits = lambda f, place: int(np.count_nonzero(f.slots[0] >> np.uint64(place) & np.uint64(1)))
    assert bits(alone, 0) == bits(among, 0) and min(bits(among, i) for i in range(3)) > 100


def test_counts_and_thresholds_come_from_every_document(spark, monkeypatch):
    """6,000 documents of one language: each has a word of its own, twice; no count or median leaves one out."""
    rows = [(i, f"the cat sat {w} {w}", "en") for i in range(6000) for w in ["".join(chr(97 + i // 26**j % 26) for j in range(4))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    monkeypatch.setattr(L, "COUNTS_AT_ONCE", 500)
    counts = L.Counts.of(L._teaching(docs))
    want = np.unique(np.concatenate([h for _, t, _ in learned for h in L.grams(t)]), return_counts=True)
    got = {r.gram: r.n for r in counts.grams.groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    assert got == dict(zip(want[0].view(np.int64).tolist(), want[1].tolist()))
    own = np.array([next(L.grams(t.split()[-1]))[2] for _, t, _ in learned])
    slots = L.train(docs).slots[0]
    assert np.bitwise_and.reduce([slots[at] for at in L._slots_of(own, len(slots))]).all()
    seen = []
    plain = L.with_language
    monkeypatch.setattr(L, "with_language", lambda frame, *rest: (seen.append(frame.count()), plain(frame, *rest))[1])
    L.least_scores(L._teaching(docs), counts)
    assert len(seen) == 2 and sum(seen) == len(learned)
