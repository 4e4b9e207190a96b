"""Toxicity of texts by a factorization machine over hashed terms.

Terms are the distinct words of a text (lower case) and their first 4, 5 and 6 characters, hashed to
``BUCKETS``. score = sigmoid(w0 + sum w[i] + sum over i < j of <v[i], v[j]>), so that two terms together may
say more than each alone. The machine is fitted on at most ``SAMPLE`` labelled documents, those of smallest
hashed id, over all buckets that ``SUPPORT`` of them hold: a term that tells nothing alone may tell with another.
The more buckets a document has, the smaller the steps of v, and the more a bucket must deviate from the base rate
for full steps of w; without that, the many rare buckets would learn the sample by heart.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import held_out, only, small_batches

BUCKETS = 1 << 20
SAMPLE = 20_000
# Sampled documents that must hold a bucket.
SUPPORT = 3
PREFIXES = (4, 5, 6)
RANK = 4
EPOCHS = 40
BATCH = 64
RATE = 0.2
DECAY = 2e-4
# Buckets a document may have on average before steps shrink; squared deviation at which a step of w is halved at most.
CROWD, STEADY = 25, 100
THRESHOLD = 0.7
FOLDS, HELD_FOLD = 3, 1
WORDS = 200_000

_words = re.compile(r"\w+").findall


def buckets_of(word: str) -> list[int]:
    terms = [word, *[f"{word[:n]}\t{n}" for n in PREFIXES if len(word) >= n]]
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms]


@dataclass
class Machine:
    """buckets -> places in w and v; ``bias`` alone scores a text without any of them."""

    place: dict[int, int]
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, places: list[int]) -> float:
        x = self.bias
        if places:
            v = self.v[places]
            x += self.w[places].sum() + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))


class _Places(dict):
    """word -> the machine's places of its buckets, for the words seen of late."""

    def __init__(self, place: dict[int, int]):
        self.place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = tuple(self.place[b] for b in buckets_of(word) if b in self.place)
        return found


def _active(text: str, places: _Places) -> list[int]:
    return sorted(set().union(*map(places.__getitem__, set(_words(text.lower())))))


def fit(rows: list[list[int]] | list[np.ndarray], toxic: list[int], place: dict[int, int], epochs: int = EPOCHS) -> Machine:
    """AdaGrad on the logistic loss; rows hold the places of each document. The order of rows decides the batches."""
    n, size = len(rows), len(place)
    share = (sum(toxic) + 0.5) / (n + 1)
    bias = math.log(share / (1 - share))
    if not size or not 0 < sum(toxic) < n:
        return Machine({}, bias, np.zeros(0), np.zeros((0, RANK)))
    each = [np.asarray(r, np.int32) for r in rows]
    y = np.array(toxic, float)
    held, bad = np.zeros(size), np.zeros(size)  # documents that hold a bucket, and toxic ones
    for row, is_toxic in zip(each, toxic):
        held[row] += 1
        bad[row] += is_toxic
    room = min(1.0, CROWD * n / max(held.sum(), 1))
    evidence = (bad - held * share) ** 2 / (np.maximum(held, 1) * share * (1 - share)) + 1e-9
    step = RATE * evidence / (evidence + STEADY * (1 - room))
    rng = np.random.default_rng(7)
    # one row for w and one for each rank of v: numpy picks from such rows several times faster than from columns
    given = np.zeros((1 + RANK, size))
    given[1:] = rng.normal(0, 0.05 * math.sqrt(room), (size, RANK)).T
    squares, squares_0 = np.full((1 + RANK, size), 1e-3), 1e-3
    steps = [step, *[RATE / 4 * room] * RANK]
    at, marked = np.zeros(size, np.int64), np.zeros(size, bool)
    lengths = np.array([len(r) for r in each])
    for _ in range(epochs):
        order = rng.permutation(n)
        for start in range(0, n, BATCH):
            batch = order[start : start + BATCH]
            flat = np.concatenate([each[i] for i in batch])
            of = np.repeat(np.arange(len(batch)), lengths[batch])
            marked[flat] = True
            seen = np.flatnonzero(marked)
            marked[seen] = False
            at[seen] = np.arange(len(seen))
            local = at.take(flat)
            w, *v = now = [row.take(seen) for row in given]
            own = w - 0.5 * sum(k * k for k in v)
            sums = [np.bincount(of, k.take(local), len(batch)) for k in v]
            x = bias + np.bincount(of, own.take(local), len(batch)) + 0.5 * sum(k * k for k in sums)
            error = (1 / (1 + np.exp(-np.clip(x, -30, 30))) - y[batch]) / len(batch)
            gw = np.bincount(local, error.take(of), len(seen))
            gv = [np.bincount(local, (error * k).take(of), len(seen)) - mine * gw for k, mine in zip(sums, v)]
            for i, g in enumerate((gw, *gv)):
                g = g + DECAY * now[i]
                grown = squares[i].take(seen) + g * g
                squares[i][seen] = grown
                given[i][seen] = now[i] - (steps[i].take(seen) if i == 0 else steps[i]) * g / np.sqrt(grown)
            squares_0 += error.sum() ** 2
            bias -= RATE * error.sum() / math.sqrt(squares_0)
    return Machine(place, bias, given[0].copy(), given[1:].T.copy())


def sample(labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic) of at most ``size`` labelled ids outside the held-out fold; any toxic label of an id counts."""
    usable = only(labels, "doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), FOLDS, HELD_FOLD))
    each = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Machine:
    small_batches(docs.sparkSession)
    chosen = cut(sample(labels, size), "labels")
    # at most ``size`` rows of 12 bytes
    texts = only(docs, "doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")

    def all_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted({b for w in set(_words(t.lower())) for b in buckets_of(w)}) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["buckets"])

    spread = texts.mapInArrow(all_buckets, "buckets array<int>")
    counts = spread.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    supported = counts.where(F.col("n") >= SUPPORT).select("bucket").toArrow()["bucket"].to_numpy()  # at most BUCKETS
    place = {b: i for i, b in enumerate(np.sort(supported).tolist())}
    sent = docs.sparkSession.sparkContext.broadcast(place)

    def only_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(sent.value)
        for batch in batches:
            found = [np.array(_active(t, places), np.int32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "toxic", "places"])

    # columns, not rows of Python objects: the driver holds each sampled text's places once
    rows = texts.mapInArrow(only_places, "doc_id long, toxic int, places binary").toArrow()
    if not rows.num_rows:
        return Machine({}, -30.0, np.zeros(0), np.zeros((0, RANK)))
    ids, toxic = rows["doc_id"].to_pylist(), rows["toxic"].to_pylist()
    places = [np.frombuffer(x.as_buffer(), np.int32) for x in rows["places"]]
    by_id = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))
    order = [i for _, same in groupby(by_id, key=ids.__getitem__) for i in sorted(same, key=lambda i: places[i].tobytes())]
    return fit([places[i] for i in order], [toxic[i] for i in order], place)


def with_score(docs: DataFrame, machine: Machine, name: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score of every whole text; null counts as empty."""
    small_batches(docs.sparkSession)
    schema = docs.selectExpr("*", f"0D AS `{name}`").schema
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        places = _Places(machine.place)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            scores = pa.array([machine.score(_active(t or "", places)) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, toxic 0/1) outside the held-out fold teach; nulls and other values are ignored. Without
    any usable label every score is next to zero; with labels of one kind only it is their share, smoothed.
    """
    scored = with_score(only(docs, "doc_id", "text"), train(docs, labels), "score")
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_FOLD).alias("held_out"), "score", flagged(F.col("score")).cast("int").alias("predicted"))


def flagged(score: Column) -> Column:
    return score >= THRESHOLD


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text isn't flagged, all columns."""
    mark = "__llm_toxicity"
    scored = with_score(docs, train(docs, labels), mark)
    return only(scored.where(~flagged(F.col(mark))), *docs.columns)
