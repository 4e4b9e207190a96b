"""License scans by a positional index of rare template words.

Texts are cut into words (runs of ASCII letters and digits and of all other code points from U+0080 on, A-Z lower-cased)
and each row keeps the places of words that occur in any template, in one pass and without a shuffle. From these the
document frequency of every template word over the whole corpus gives its inverse document frequency.

A template is looked up by the ``ANCHORS`` words of highest idf in its key phrase: a place of such a word in a file and its offset in the
template give the relative position at which the template would begin. There the postings of all other template words
are intersected with the file's words at the same relative positions. A template is found if every word of its key phrase
is in place and the words in place carry at least ``ENOUGH`` of the template's idf. Phrases are templates that are all
key phrase.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import only, text_of

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The one code point above ASCII whose lower case is an ASCII letter; another letter stands in for it.
KELVIN, STAND_IN = "\u212A", "\u00E5"
ANCHORS = 1
ENOUGH = 0.6


@dataclass(frozen=True)
class Template:
    """Words of a notice; the key phrase is words[first:last]. Phrases (``base``) count towards the base results."""

    label: str
    words: tuple[str, ...]
    first: int
    last: int
    base: bool = False


def phrase(label: str, text: str) -> Template:
    words = tuple(text.split())
    return Template(label, words, 0, len(words), True)


def notice(label: str, text: str, key: str) -> Template:
    """A notice and the phrase in it that must be there."""
    words, wanted = tuple(text.split()), tuple(key.split())
    first = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
    return Template(label, words, first, first + len(wanted))


# Phrases and labels of the base results.
PHRASES = (phrase("mit", "mit license"), phrase("apache", "apache license"), phrase("gpl", "general public license"))
# Sentences by which well-known licences are declared.
NOTICES = (
    notice("mit", "released under the mit license", "mit license"),
    notice("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    notice("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    notice("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    notice("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    notice("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    notice("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    notice("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    notice("agpl", "under the terms of the gnu affero general public license", "affero general public license"),
    notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    notice("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    notice("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    notice("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    notice("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    notice("cc", "licensed under a creative commons attribution license", "creative commons"),
    notice("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    notice("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
)
TEMPLATES = (*PHRASES, *NOTICES)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit(STAND_IN))), NOT_WORD), "")


def index_words(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """All columns of ``docs`` but text, n_words, and hits: (at, word) of every template word, by place."""
    vocabulary = sorted({w for t in templates for w in t.words})
    split = docs.select(*[c for c in docs.columns if c != "text"], words_of(text_of()).alias("__words"))
    placed = F.transform("__words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    hits = F.filter(placed, lambda x: x["word"].isin(vocabulary))
    return split.select(*[c for c in docs.columns if c != "text"], F.size("__words").cast("long").alias("n_words"), hits.alias("hits"))


def idf(indexed: DataFrame, templates: Sequence[Template] = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency of each template word (a fixed list) over all rows of ``indexed``."""
    each = indexed.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["word"]))).alias("word"))
    found = {r.word: r.n for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = indexed.count()
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1 for t in templates for w in t.words}


def places(indexed: DataFrame, weights: dict[str, float], row: str, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(row, template number, start, score) of every template found in ``indexed``."""
    posts, sized, anchors = [], [], set()
    for n, t in enumerate(templates):
        # the key phrase must be there in full, so its words of highest idf find it
        rare = sorted(set(t.words[t.first : t.last]), key=lambda w: (-weights[w], w))[:ANCHORS]
        anchors.update(rare)
        posts += [F.struct(F.lit(w).alias("word"), F.lit(n).alias("template"), F.lit(i).alias("offset")) for i, w in enumerate(t.words) if w in rare]
        total = sum(weights[w] for w in t.words)
        sized.append(
            F.struct(
                F.array(*[F.lit(w) for w in t.words]).alias("words"),
                F.array(*[F.lit(weights[w] / total) for w in t.words]).alias("share"),
                F.lit(t.first).alias("first"),
                F.lit(t.last).alias("last"),
            )
        )
    spark = indexed.sparkSession
    postings = spark.range(1).select(F.inline(F.array(*posts)))
    known = spark.range(1).select(F.posexplode(F.array(*sized)).alias("template", "t"))
    numbered = F.transform("hits", lambda h, k: F.struct(k.alias("k"), h["at"].alias("at"), h["word"].alias("word")))
    looked_up = indexed.select(row, "hits", F.explode(F.filter(numbered, lambda h: h["word"].isin(sorted(anchors)))).alias("h"))
    # postings and templates are the fixed list above
    candidates = looked_up.join(F.broadcast(postings), F.col("h.word") == postings["word"]).join(F.broadcast(known), "template")
    start = F.col("h.at") - F.col("offset")
    size = F.size("t.words")
    around = F.slice("hits", F.greatest(F.lit(1), F.col("h.k") + 1 - size), 2 * size + 1)
    near = candidates.select(row, "template", start.alias("start"), "t", around.alias("around"))
    expected = F.transform("t.words", lambda w, i: F.struct((F.col("start") + i).alias("at"), w.alias("word")))
    in_place = F.transform(expected, lambda e: F.array_contains("around", e))
    aligned = near.select(row, "template", "start", "t", in_place.alias("there"))
    score = F.aggregate(F.zip_with("there", "t.share", lambda there, s: F.when(there, s).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    key = F.forall(F.slice("there", F.col("t.first") + 1, F.col("t.last") - F.col("t.first")), lambda x: x)
    scored = aligned.select(row, "template", "start", F.least(score, F.lit(1.0)).alias("score"), key.alias("key"))
    return scored.where(F.col("key") & (F.col("score") >= ENOUGH)).select(row, "template", "start", "score").distinct()


def scan(docs: DataFrame, templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row of ``docs`` (doc_id, text).

    Places overlap freely. score is the highest share of a found template's idf, 0 without any. A null text is empty.
    Repeated rows are scanned as often as they occur. An empty table gives no rows.
    """
    row = "__row"
    numbered = only(docs, "doc_id", "text").select("doc_id", "text", F.monotonically_increasing_id().alias(row))
    indexed = cut(index_words(numbered, templates), "words")
    label = F.get(F.array(*[F.lit(t.label) for t in templates]), F.col("template"))
    base = F.get(F.array(*[F.lit(t.base) for t in templates]), F.col("template"))
    found = places(indexed, idf(indexed, templates), row, templates).select(row, "start", "score", label.alias("label"), base.alias("base"))
    only_base = lambda c: F.when(F.col("base"), F.col(c))
    summary = found.groupBy(row).agg(
        F.count(only_base("start")).alias("n_base"),
        F.min(only_base("start")).cast("long").alias("first_word"),
        F.max(only_base("start")).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(only_base("label"))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
    )
    joined = indexed.select(row, "doc_id", "n_words").join(summary, row, "left")
    filled = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return joined.select(*[F.coalesce(c, filled[c]).alias(c) if c in filled else F.col(c) for c in columns])
