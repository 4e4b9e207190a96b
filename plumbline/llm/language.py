"""Language of texts by n-gram filters that answer for all languages at once.

Texts are lower-cased, everything but letters becomes a space, and every ``GRAM`` code points in a row are
hashed. A Bloom filter, sized from the n-grams it holds, keeps one bit per language in each slot: ANDing the slots of an
n-gram's hashes gives the bitmask of all languages that contain it. Counting each language's bits over a text
and taking away what its share of set bits lets through by chance gives the votes; most votes win, ties go to
the language of smaller name. The score is the winner's votes as a share of the text's n-grams.

The filter is filled from all documents with a language outside the held-out fold, whose n-grams are counted in
Spark. A language contains an n-gram if it has it ``SEEN`` times and at least ``SHARE`` times as
often as the language that has it most often. Of each language the ``GRAMS`` most frequent ones are kept, however many
languages there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import held_out, only, small_batches

GRAM = 4
LEAST_SLOTS = 1 << 12
ROOM = 16
HASHES = 3
SEEN = 2
SHARE = 0.2
GRAMS = 100_000
MIN_SCORE = 0.3
MIN_SHARE = 0.5
UNKNOWN = "und"
FOLDS, HELD_FOLD = 4, 2
WORD_BITS = 64
CHARS_AT_ONCE = 1 << 20
COUNTS_AT_ONCE = 1 << 20

_other = re.compile(r"[\W\d_]+")


def grams(text: str) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's n-grams, repeats included, some at a time; none if it has no letter."""
    letters = _other.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, letters)):
        return
    points = np.frombuffer(f"  {letters}  ".encode("utf-32-le"), "<u4").astype(np.uint64)
    for start in range(0, len(points) - GRAM + 1, CHARS_AT_ONCE):
        some = points[start : start + CHARS_AT_ONCE + GRAM - 1]
        h = np.zeros(len(some) - GRAM + 1, np.uint64)
        for i in range(GRAM):
            h = h * np.uint64(0x100000001B3) + some[i : len(some) - GRAM + 1 + i]
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        yield h ^ (h >> np.uint64(32))


@dataclass
class Filter:
    """languages in order of name; slots[word, slot] holds the bits of 64 languages; chance: false positives of each."""

    languages: list[str]
    slots: np.ndarray
    chance: np.ndarray
    fallback: int

    @classmethod
    def build(cls, languages: list[str], fallback: int, hashes: np.ndarray, places: np.ndarray) -> Filter:
        """From pairs of an n-gram's hash and the place of a language that contains it.

        At least ``ROOM`` slots for every n-gram of the language that has most, which leaves under one false positive in 150.
        """
        most = int(np.bincount(places).max()) if len(places) else 0
        size = max(LEAST_SLOTS, 1 << (ROOM * most - 1).bit_length())
        slots = np.zeros((-(-max(1, len(languages)) // WORD_BITS), size), np.uint64)
        for at in _slots_of(hashes, size):
            np.bitwise_or.at(slots, (places // WORD_BITS, at), np.uint64(1) << (places % WORD_BITS).astype(np.uint64))
        filled = [float(np.count_nonzero(slots[i // WORD_BITS] >> np.uint64(i % WORD_BITS) & np.uint64(1))) / size for i in range(len(languages))]
        return cls(languages, slots, np.array(filled) ** HASHES, fallback)

    def votes(self, text: str) -> tuple[np.ndarray, int]:
        hits, total = np.zeros(len(self.languages)), 0
        for hashes in grams(text):
            total += len(hashes)
            for word, slots in enumerate(self.slots):
                masks = np.bitwise_and.reduce([slots[at] for at in _slots_of(hashes, slots.shape[0])])
                for bit in range(min(WORD_BITS, len(self.languages) - word * WORD_BITS)):
                    hits[word * WORD_BITS + bit] += np.count_nonzero(masks & np.uint64(1 << bit))
        return np.maximum(0, hits - self.chance * total) / np.maximum(1e-9, 1 - self.chance), total

    def predict(self, text: str | None) -> tuple[str, float]:
        votes, total = self.votes(text or "")
        if not total or not self.languages:
            return UNKNOWN, 0.0
        best = int(votes.argmax())
        if not votes[best]:
            return self.languages[self.fallback], 0.0
        return self.languages[best], min(1.0, float(votes[best]) / total)


def _slots_of(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    """Places in a filter of ``size``, a power of two: two halves of the hash, combined."""
    low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
    return [(low + np.uint64(i) * high & np.uint64(size - 1)).astype(np.int64) for i in range(HASHES)]


def _teaching(docs: DataFrame) -> DataFrame:
    """lang, text and half (0 or 1, by the id's hash) of every document to learn from."""
    half = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("calibrate")), F.lit(2)).cast("int")
    usable = only(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD_FOLD))
    return usable.select("lang", "text", half.alias("half"))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes and their summed counts."""
    hashes, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = hashes.argsort(kind="stable")
    hashes = hashes[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], np.add.reduceat(n[order], first)


@dataclass
class Counts:
    """Everything a filter is made from: documents and code points of each (lang, half), n-gram counts of each (place, half)."""

    sizes: dict[tuple[str, int], tuple[int, int]]
    grams: DataFrame

    @classmethod
    def of(cls, teaching: DataFrame) -> Counts:
        small_batches(teaching.sparkSession)
        found = teaching.groupBy("lang", "half").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size")).collect()
        sizes = {(r.lang, r.half): (r.n, r.size) for r in found}
        place = {k: i for i, k in enumerate(sorted({lang for lang, _ in sizes}))}

        def rows(held: dict[tuple[int, int], list]) -> Iterator[pa.RecordBatch]:
            for (at, half), parts in held.items():
                h, n = _summed(parts)
                same = [pa.array(np.full(len(h), x, np.int32)) for x in (at, half)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(h.view(np.int64)), pa.array(n)], names=["place", "half", "gram", "n"])

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list] = {}
            size = 0
            for batch in batches:
                for (lang, half), texts in batch.to_pandas().groupby(["lang", "half"])["text"]:
                    found = [h for t in texts for h in grams(t)]
                    if found:
                        some = np.unique(np.concatenate(found), return_counts=True)
                        held.setdefault((place[lang], int(half)), []).append(some)
                        size += len(some[0])
                if size >= COUNTS_AT_ONCE:
                    held = {k: [_summed(parts)] for k, parts in held.items()}
                    size = sum(len(parts[0][0]) for parts in held.values())
                    if size >= COUNTS_AT_ONCE // 2:
                        yield from rows(held)
                        held, size = {}, 0
            yield from rows(held)

        each = teaching.mapInArrow(count, "place int, half int, gram long, n long")
        return cls(sizes, cut(each.groupBy("gram", "place", "half").agg(F.sum("n").alias("n")), "gram-counts"))

    def filter(self, half: int | None = None) -> Filter:
        """Of all documents, or of those in one half."""
        languages = sorted({lang for lang, _ in self.sizes})
        if not languages:
            return Filter([], np.zeros((1, LEAST_SLOTS), np.uint64), np.zeros(0), 0)
        halves = [h for h in (0, 1) if half in (None, h)]
        total = [tuple(sum(self.sizes.get((k, h), (0, 0))[i] for h in halves) for i in (0, 1)) for k in languages]
        fallback = max(range(len(languages)), key=lambda i: (total[i][0], -i))
        each = self.grams.where(F.col("half").isin(halves)).groupBy("gram", "place").agg(F.sum("n").alias("n"))
        size_of = F.element_at(F.array(*[F.lit(float(max(1, size))) for _, size in total]), F.col("place") + 1)
        entry = F.struct((F.col("n") / size_of).alias("rate"), "place", "n")
        merged = each.where(F.col("n") >= SEEN).groupBy("gram").agg(F.collect_list(entry).alias("held"), F.max(F.col("n") / size_of).alias("most"))
        entries = merged.select("gram", F.explode("held").alias("e"), "most").where(F.col("e.rate") >= SHARE * F.col("most"))
        ranked = entries.select("gram", F.col("e.place").alias("place"), F.row_number().over(Window.partitionBy("e.place").orderBy(F.desc("e.rate"), "gram")).alias("rank"))
        kept: pd.DataFrame = ranked.where(F.col("rank") <= GRAMS).select("gram", "place").toPandas()
        return Filter.build(languages, fallback, kept["gram"].to_numpy(np.int64).view(np.uint64), kept["place"].to_numpy(np.int64))


def train(docs: DataFrame) -> Filter:
    return Counts.of(_teaching(docs)).filter()


def with_language(docs: DataFrame, known: Filter, name: str, score: str, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the predicted language and its score."""
    small_batches(docs.sparkSession)
    schema = docs.selectExpr("*", f"'' AS `{name}`", f"0D AS `{score}`").schema
    # plain arrays, at most 16 MB per 64 languages
    sent = docs.sparkSession.sparkContext.broadcast((known.languages, known.slots, known.chance, known.fallback))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(*sent.value)
        for batch in batches:
            found = [known.predict(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, name, score])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text, lang).

    Learns from rows with a lang and a text outside the held-out fold. ``und`` with score 0 goes to texts that are
    null or have no letter, and to all if there is nothing to learn from. A text none of whose n-grams any language
    contains gets the most frequent language with score 0. Very long texts are read whole, in steps; repeated rows
    stay and get the same answer.
    """
    found = with_language(only(docs, "doc_id", "text"), train(docs), "lang_pred", "score")
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "lang_pred", "score")


def least_scores(teaching: DataFrame, counts: Counts, least: float = MIN_SCORE) -> dict[str, float]:
    """The score that a text of each language needs: ``least``, or ``MIN_SHARE`` of its documents' median where that is less.

    The median is taken over all teaching documents; each half is scored by the filter of the other one. Documents whose
    language the other half lacks are left out. A language whose n-grams are spread wide (thousands of characters) scores
    low throughout, and keeps its documents.
    """
    scored = None
    for half in (0, 1):
        known = sorted(lang for lang, other in counts.sizes if other == 1 - half)
        if known:
            some = with_language(teaching.where((F.col("half") == half) & F.col("lang").isin(known)), counts.filter(1 - half), "__llm_lang", "__llm_lang_score")
            scored = some if scored is None else scored.unionByName(some)
    if scored is None:
        return {}
    middles = scored.groupBy("lang").agg(F.percentile_approx("__llm_lang_score", 0.5).alias("middle")).collect()
    return {r.lang: min(least, MIN_SHARE * r.middle) for r in middles}


def keep_known(docs: DataFrame, least: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` in a learned language, all columns: not ``und``, and a score of ``least_scores`` or more.

    Null, empty and letterless texts go; repeated rows get one answer, whatever their length; an empty table stays empty.
    """
    lang, score = "__llm_lang", "__llm_lang_score"
    teaching = _teaching(docs)
    counts = Counts.of(teaching)
    known = counts.filter()
    needed = least_scores(teaching, counts, least)
    enough = F.lit(least) if not needed else F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in needed.items() for x in pair]), F.col(lang)), F.lit(least))
    found = with_language(docs, known, lang, score)
    return only(found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= enough)), *docs.columns)
