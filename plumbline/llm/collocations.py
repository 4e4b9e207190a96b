"""Collocations by weighted acyclic automata.

Texts, lower-cased in A-Z, fall into pieces and words; a phrase is 1 to ``LONGEST`` words of a piece. Every word starts one
window, the words up to ``LONGEST`` of its piece, so a phrase occurs as often as windows start with it and the counts of all
lengths come from windows alone.

1. A task sorts the windows of each chunk of words and builds one count automaton per language and prefix range: paths of
   words, the count on the last arc, equal continuations held once. Ranges are cut between sampled windows, not between
   words, so a word or pair that starts a large share of them is spread. The cuts balance work and never affect results.
2. The automata of a range are united and their weights summed. Phrases with enough occurrences come out with their weight;
   those at a range's edges, which may go on in the next one, come out in parts that are added up. What is too rare is
   folded into the end of its longest frequent prefix and the automaton of the range is written.
3. The parts of the candidates are composed with the automata of all ranges that their prefix touches; a part's count is the
   weight of all paths below the state it leads to, added up over those ranges.

Scores, containment and ranks are joins and windows over the candidates.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .common import small_batches, text_of

LONGEST = 4
LEAST = 30
TOP = 2000
COVERED = 80  # a candidate goes if a longer one around it has this share of its occurrences, in percent
SCALE = 2_000_000
UNKNOWN = "und"
CHUNK = 1 << 20
RANGE = 1 << 21  # windows of a range, about
PER_RANGE = 128  # windows sampled for each range
PER_TEXT = 32
AT_ONCE = 1 << 20  # words of a long text taken at a time
SALTS = 64

BREAK = b"."
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\n" * 10)
Cuts = dict[str, list[tuple[bytes, ...]]]


def ids_of(raw: bytes, index: defaultdict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers that ``index`` deals out; a break between pieces is ``index[BREAK]``."""
    spaced = raw.lower().translate(_BREAKS).replace(b"\n", b" . ")
    if len(spaced) < 8 * AT_ONCE:
        return np.array([index[w] for w in spaced.split()], np.int64)
    parts, at = [], 0
    while at < len(spaced):  # cut a long text after white space
        end = at + 8 * AT_ONCE
        while end < len(spaced) and spaced[end] not in b" \t":
            end += 1
        parts.append(np.array([index[w] for w in spaced[at:end].split()], np.int64))
        at = end
    return np.concatenate(parts)


def windows_of(sequence: np.ndarray, begins: np.ndarray | bool = True) -> np.ndarray:
    """One row of LONGEST numbers per word that ``begins``; 0, which stands for breaks, ends a window."""
    padded = np.r_[sequence, np.zeros(LONGEST, sequence.dtype)]
    starts = np.flatnonzero((sequence > 0) & begins)
    columns = [padded[starts]]
    for k in range(1, LONGEST):
        columns.append(np.where(columns[-1] == 0, 0, padded[starts + k]))
    return np.stack(columns, 1) if len(starts) else np.empty((0, LONGEST), sequence.dtype)


def summed(windows: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in order, and the sum of the weights of each."""
    if not len(windows):
        return windows, np.empty(0, np.int64)
    bits = int(windows.max()).bit_length()
    if bits * LONGEST <= 64:
        key = np.zeros(len(windows), np.uint64)
        for k in range(LONGEST):
            key = key << np.uint64(bits) | windows[:, k].astype(np.uint64)
        if weights is None:
            key, weights = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key)
            key, weights = key[order], weights[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, weights = key[first], np.add.reduceat(weights, first)
        mask = np.uint64((1 << bits) - 1)
        rows = np.stack([(key >> np.uint64(bits * (LONGEST - 1 - k)) & mask).astype(np.int64) for k in range(LONGEST)], 1)
        return rows, weights.astype(np.int64)
    order = np.lexsort(windows.T[::-1])
    windows = windows[order]
    first = np.flatnonzero(np.r_[True, (windows[1:] != windows[:-1]).any(1)])
    weights = np.ones(len(windows), np.int64) if weights is None else weights[order]
    return windows[first], np.add.reduceat(weights, first)


def _share(sizes: np.ndarray, labels: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of each state, first state of each class): states with the same arcs, label by label and end by end, are one.

    Likeness is found by a hash of the arcs and then compared arc by arc; a state unlike the first of its hash stays alone.
    """
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(labels)) - np.repeat(first, sizes)
    mixed = labels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ ends.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) * (2 * place + 1).astype(np.uint64)
    _, chosen, of = np.unique(np.add.reduceat(mixed ^ mixed >> np.uint64(31), first), return_index=True, return_inverse=True)
    model = chosen[of]
    same = sizes == sizes[model]
    state = np.repeat(np.arange(len(sizes)), sizes)
    other = np.where(same[state], first[model[state]] + place, np.arange(len(labels)))
    same &= np.logical_and.reduceat((labels == labels[other]) & (ends == ends[other]), first)
    model = np.where(same, model, np.arange(len(sizes)))
    firsts, of = np.unique(model, return_inverse=True)
    return of, firsts


@dataclass
class CountAutomaton:
    """Paths of LONGEST words with a weight each. Level k holds the arcs of its states one after the other.

    ``sizes[k]``: arcs of each state; ``labels[k]``: 0 (end) or a word's place in ``words`` plus one, ascending within a
    state; ``ends[k]``: the state of the next level, on the last level the weight.
    """

    words: list[bytes]
    sizes: list[np.ndarray]
    labels: list[np.ndarray]
    ends: list[np.ndarray]

    @classmethod
    def of_sorted(cls, words: list[bytes], windows: np.ndarray, weights: np.ndarray) -> CountAutomaton:
        """From different windows in order, over all of ``words`` (sorted); words that do not occur are left out."""
        used = np.unique(windows)
        used = used[used > 0]
        place = np.zeros(len(words) + 1, np.int64)
        place[used] = np.arange(1, len(used) + 1)
        windows = place[windows]
        fresh, new = [], np.zeros(len(windows), bool)
        new[:1] = True
        for k in range(LONGEST):  # where a prefix of k + 1 words begins
            new = new | np.r_[True, windows[1:, k] != windows[:-1, k]][: len(windows)]
            fresh.append(np.flatnonzero(new))
        sizes: list = [None] * LONGEST
        labels: list = [None] * LONGEST
        ends: list = [None] * LONGEST
        below = weights.astype(np.int64)  # what each arc of the level leads to
        for k in range(LONGEST - 1, -1, -1):
            label = windows[fresh[k], k]
            above = fresh[k - 1] if k else np.zeros(1, np.int64)
            size = np.diff(np.r_[np.searchsorted(fresh[k], above), len(label)])
            of, firsts = _share(size, label, below)
            begin = (np.cumsum(size) - size)[firsts]
            keep = np.repeat(begin - np.r_[0, np.cumsum(size[firsts])[:-1]], size[firsts]) + np.arange(size[firsts].sum())
            sizes[k], labels[k], ends[k] = size[firsts], label[keep], below[keep]
            below = of
        return cls([words[i - 1] for i in used.tolist()], sizes, labels, ends)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All windows in order, over this automaton's words, and their weights."""
        states, trail = np.zeros(1, np.int64), []
        for k in range(LONGEST):
            size = self.sizes[k]
            first = np.cumsum(size) - size
            many = size[states]
            arcs = np.repeat(first[states] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            trail = [t.repeat(many) for t in trail]
            trail.append(self.labels[k][arcs])
            states = self.ends[k][arcs]
        return np.stack(trail, 1), states

    def compose(self, phrases: list[tuple[bytes, ...]]) -> np.ndarray:
        """The weight of all paths that begin with each phrase: every phrase is a path of one automaton, walked in the other."""
        below = self.ends[-1]  # the weight below every arc, from the last level up
        weights = [below]
        for k in range(LONGEST - 1, 0, -1):
            size = self.sizes[k]
            below = np.add.reduceat(weights[0], np.cumsum(size) - size)[self.ends[k - 1]]
            weights.insert(0, below)
        index = {w: i + 1 for i, w in enumerate(self.words)}
        state = np.zeros(len(phrases), np.int64)
        found = np.zeros(len(phrases), np.int64)
        alive = np.ones(len(phrases), bool)
        for k in range(LONGEST):
            label = np.array([index.get(p[k], -1) if len(p) > k else -1 for p in phrases], np.int64)
            going = alive & np.array([len(p) > k for p in phrases], bool)
            size = self.sizes[k]
            key = np.repeat(np.arange(len(size)), size) << 32 | self.labels[k]
            wanted = state << 32 | np.maximum(label, 0)
            arc = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            hit = going & (label > 0) & (key[arc] == wanted)
            found = np.where(going, np.where(hit, weights[k][arc], 0), found)
            alive = hit
            if k + 1 < LONGEST:
                state = np.where(hit, self.ends[k][arc], 0)
        return found

    def to_bytes(self) -> bytes:
        arrays = [a.astype("<i4" if a.max(initial=0) < 1 << 31 else "<i8") for part in (self.sizes, self.labels, self.ends) for a in part]
        words = b" ".join(self.words)
        head = np.array([len(words), *[x for a in arrays for x in (len(a), a.itemsize)]], "<i8").tobytes()
        raw = head + words + b"".join(a.tobytes() for a in arrays)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def from_bytes(cls, packed: bytes) -> CountAutomaton:
        raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
        head = np.frombuffer(raw, "<i8", 1 + 6 * LONGEST).tolist()
        at = 8 * len(head) + head[0]
        words = raw[8 * len(head) : at].split()
        arrays = []
        for size, item in zip(head[1::2], head[2::2]):
            arrays.append(np.frombuffer(raw, f"<i{item}", size, at).astype(np.int64))
            at += size * item
        return cls(words, arrays[:LONGEST], arrays[LONGEST : 2 * LONGEST], arrays[2 * LONGEST :])


def united(automata: list[CountAutomaton]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, windows, weights) of the union: every path of any of them, with the sum of its weights. Empties the list."""
    words = sorted(set().union(*[a.words for a in automata]))
    index = {w: i + 1 for i, w in enumerate(words)}
    windows, weights = [], []
    waiting = list(automata)
    automata.clear()  # each is let go as soon as its paths are taken
    while waiting:
        a = waiting.pop()
        place = np.array([0, *[index[w] for w in a.words]], np.int32)
        paths, weight = a.paths()
        windows.append(place[paths])
        weights.append(weight)
    joined = np.concatenate(windows)
    del windows[:], paths
    return words, *summed(joined, np.concatenate(weights))


def _before(words: list[bytes], windows: np.ndarray, cut_at: tuple[bytes, ...]) -> int:
    """How many of the ordered windows come before ``cut_at``, whose missing words count as the end."""
    low, high = 0, len(windows)
    for k in range(LONGEST):
        word = cut_at[k] if k < len(cut_at) else b""
        place = bisect_left(words, word) + 1 if word else 0
        known = not word or (place <= len(words) and words[place - 1] == word)
        column = windows[low:high, k]
        left = low + int(np.searchsorted(column, place))
        if not known:
            return left
        low, high = left, low + int(np.searchsorted(column, place, "right"))
    return low


def _chunk(held: dict[str, list[np.ndarray]], index: defaultdict[bytes, int], cuts: Cuts) -> pa.RecordBatch:
    """One automaton per language and range of the words gathered."""
    words = sorted(w for w in index if w != BREAK)
    place = np.zeros(len(index), np.int64)
    place[[index[w] for w in words]] = np.arange(1, len(words) + 1)
    langs, ranges, automata = [], [], []
    for lang, sequences in held.items():
        joined = np.concatenate(sequences)
        windows, weights = summed(windows_of(place[np.where(joined < 0, ~joined, joined)], joined >= 0))
        marks = [0, *[_before(words, windows, c) for c in cuts.get(lang, [])], len(windows)]
        for i, (a, b) in enumerate(zip(marks[:-1], marks[1:])):
            if a < b:
                langs.append(lang)
                ranges.append(i)
                automata.append(CountAutomaton.of_sorted(words, windows[a:b], weights[a:b]).to_bytes())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ranges, pa.int32()), pa.array(automata, pa.binary())], names=["lang", "range", "automaton"])


def _new_index() -> defaultdict[bytes, int]:
    index: defaultdict[bytes, int] = defaultdict(count().__next__)
    index[BREAK]
    return index


def _automata(cuts: Cuts, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, index, size = defaultdict(list), _new_index(), 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            ids = ids_of(text.as_buffer().to_pybytes(), index)
            for at in range(0, len(ids), CHUNK):
                part = ids[at : at + CHUNK]
                tail = ids[at + CHUNK : at + CHUNK + LONGEST - 1]  # seen by the part's last windows, where none begins
                held[lang] += [part, ~tail, np.zeros(1, np.int64)]
                size += len(part)
                if size >= CHUNK:
                    yield _chunk(held, index, cuts)
                    held, size = defaultdict(list), 0
            if size == 0:
                index = _new_index()
    if held:
        yield _chunk(held, index, cuts)


def _sampled(rate: float, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some windows of the sampled texts, as words; the choice hangs on the text alone."""
    for batch in batches:
        langs, windows = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            raw = text.as_buffer().to_pybytes()
            index = _new_index()
            found = windows_of(ids_of(raw, index))
            chosen = np.random.default_rng(zlib.crc32(raw)).permutation(len(found))[: -int(-len(found) * rate // 1)]
            names = list(index)
            for window in found[chosen].tolist():
                langs.append(lang)
                windows.append(b" ".join(names[i] for i in window if i))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(windows, pa.binary())], names=["lang", "sample"])


def _cuts(docs: DataFrame, window_range: int) -> Cuts:
    """Where each language's windows are divided: quantiles of about PER_RANGE sampled windows a range."""
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    words = (size.bytes or 0) / 6
    ranges = max(16, int(words / window_range) + 1)
    wanted = ranges * PER_RANGE
    share = min(1.0, 2 * wanted / PER_TEXT / max(size.n, 1))
    rate = min(1.0, wanted / max(words * share, 1))
    chosen = docs.sample(share, 7).mapInArrow(partial(_sampled, rate), "lang string, sample binary").collect()
    by_lang: dict[str, list[tuple[bytes, ...]]] = defaultdict(list)
    for row in chosen:
        by_lang[row.lang].append(tuple(bytes(row.sample).split()))
    cuts = {}
    for lang, some in by_lang.items():
        some.sort()
        parts = -(-ranges * len(some) // len(chosen))
        cuts[lang] = sorted({some[len(some) * i // parts] for i in range(1, parts)})
    return cuts


def _unite(least: int, table: pa.Table) -> pa.Table:
    """The phrases of one range that are frequent or lie at its edges, and its folded automaton in a row without phrase."""
    lang, number = table.column("lang")[0].as_py(), table.column("range")[0].as_py()
    words, windows, weights = united([CountAutomaton.from_bytes(a.as_py()) for a in table.column("automaton")])
    phrases: list[bytes] = [b""]
    lengths, counts = [0], [int(weights.sum())]
    kept = np.zeros(len(windows), np.int64)  # words of each window's longest prefix that stays
    new = np.zeros(len(windows), bool)
    new[0] = True
    for k in range(LONGEST):
        new = new | np.r_[True, windows[1:, k] != windows[:-1, k]]
        first = np.flatnonzero(new)
        total = np.add.reduceat(weights, first)
        stays = ((total >= least) | (np.arange(len(first)) == 0) | (np.arange(len(first)) == len(first) - 1)) & (windows[first, k] > 0)
        kept = np.where(np.repeat(stays, np.diff(np.r_[first, len(windows)])), k + 1, kept)
        for row, n in zip(windows[first[stays], : k + 1].tolist(), total[stays].tolist()):
            phrases.append(b" ".join(words[i - 1] for i in row))
            lengths.append(k + 1)
            counts.append(n)
    folded, weights = summed(np.where(np.arange(LONGEST) < kept[:, None], windows, 0), weights)
    some = folded[:, 0] > 0
    packed = CountAutomaton.of_sorted(words, folded[some], weights[some]).to_bytes()
    n = len(phrases)
    return pa.table(
        {
            "lang": pa.array([lang] * (n + 1), pa.string()),
            "range": pa.array([number] * (n + 1), pa.int32()),
            "phrase": pa.array([p.decode() for p in phrases] + [None], pa.string()),
            "words": pa.array(lengths + [None], pa.int32()),
            "total": pa.array(counts + [None], pa.int64()),
            "automaton": pa.array([None] * n + [packed], pa.binary()),
        }
    )


def _routed(cuts: Cuts, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part with every range in which windows may begin with it."""
    for batch in batches:
        rows = []
        for lang, part in zip(batch.column("lang").to_pylist(), batch.column("part").to_pylist()):
            path, edges = tuple(part.encode().split()), cuts.get(lang, [])
            low = bisect_right(edges, path)
            high = bisect_right(edges, path, key=lambda c: c[: len(path)])
            rows += [{"lang": lang, "range": i, "part": part} for i in range(low, high + 1)]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("lang", pa.string()), ("range", pa.int32()), ("part", pa.string())]))


def _composed(automata: pa.Table, requests: pa.Table) -> pa.Table:
    parts = requests.column("part").to_pylist()
    total = np.zeros(len(parts), np.int64)
    for packed in automata.column("automaton"):
        total += CountAutomaton.from_bytes(packed.as_py()).compose([tuple(p.encode().split()) for p in parts])
    return pa.table({"lang": requests.column("lang"), "part": requests.column("part"), "total": pa.array(total)})


def _pieces(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("path", first, length), " ")


def phrases(docs: DataFrame, least: int = LEAST, window_range: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, l, r, score) of every phrase of 2 to LONGEST words with ``least`` occurrences that no longer one
    covers, and (lang, n), the words of each language.

    ``docs``: text and lang. A null text is empty, a null lang is UNKNOWN. Repeated rows count as often as they occur, texts
    of any length whole. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.coalesce(F.col("lang"), F.lit(UNKNOWN)).alias("lang"), text_of().alias("text"))
    cuts = _cuts(given, window_range)
    automata = given.mapInArrow(partial(_automata, cuts), "lang string, range int, automaton binary")
    columns = "lang string, range int, phrase string, words int, total long, automaton binary"
    found = cut(automata.groupBy("lang", "range").applyInArrow(lambda part: _unite(least, part), columns), "ranges")

    counted = found.where("phrase IS NOT NULL").groupBy("lang", "phrase", "words").agg(F.sum("total").alias("a"))
    counted = cut(counted.where((F.col("a") >= least) & (F.col("words") != 1) | (F.col("words") == 0)), "phrases")
    candidates = counted.where("words > 1").select("lang", "phrase", "a", "words", F.split("phrase", " ").alias("path"))

    one = F.lit(1)
    at_k = candidates.select("lang", "phrase", "a", "words", "path", F.explode(F.sequence(one, F.col("words") - 1)).alias("k"))
    halves = at_k.select("lang", "phrase", "a", "k", _pieces(one, F.col("k")).alias("head"), _pieces(F.col("k") + 1, F.col("words")).alias("rest"))
    parts = halves.select("lang", F.explode(F.array("head", "rest")).alias("part")).distinct()
    routed = parts.mapInArrow(partial(_routed, cuts), "lang string, range int, part string")
    built = found.where("automaton IS NOT NULL").select("lang", "range", "automaton")
    looked_up = built.groupBy("lang", "range").cogroup(routed.groupBy("lang", "range")).applyInArrow(lambda a, b: _composed(a, b), "lang string, part string, total long")
    sizes = cut(looked_up.groupBy("lang", "part").agg(F.sum("total").alias("size")), "parts")

    head = sizes.select("lang", F.col("part").alias("head"), F.col("size").alias("l"))
    rest = sizes.select("lang", F.col("part").alias("rest"), F.col("size").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.call_function("div", F.lit(SCALE).cast("decimal(7,0)") * wide("a"), wide("l") + wide("r"))
    cut_up = halves.join(head, ["lang", "head"]).join(rest, ["lang", "rest"]).select("lang", "phrase", "a", "l", "r", "k", score.alias("score"))
    best = cut_up.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("best"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(one, F.col("words") - m + 1), lambda i: _pieces(i, m))))
    around = candidates.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    covered = (wide("longer") * 100) >= (wide("a") * COVERED)
    kept = best.select("lang", "phrase", "best.*").join(around, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    n = counted.where("words = 0").select("lang", F.col("a").alias("n"))
    return kept.select("lang", "phrase", "a", "l", "r", "score"), n


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, window_range: int = RANGE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the first ``top`` phrases of each language; see ``phrases``.

    Order: score and occurrences descending, then the phrase's UTF-8 bytes. Each language is ranked in parts first.
    """
    order = [F.desc("score"), F.desc("a"), F.asc(F.col("phrase").cast("binary"))]
    found, sizes = phrases(docs, least, window_range)
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    rank = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    ranked = rank(rank(salted, "lang", "salt").drop("rank"), "lang")
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents) AS p
), grams AS (
  SELECT lang, k, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(words) >= k) AS g
  GROUP BY ALL
), sizes AS (
  SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, phrase, k AS m, a, string_split(phrase, ' ') AS path FROM grams WHERE k > 1 AND a >= 30
), halves AS (
  SELECT lang, phrase, a, k, array_to_string(path[:k], ' ') AS head, array_to_string(path[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates) AS c
), scored AS (
  SELECT h.lang, h.phrase, h.a, x.a AS l, y.a AS r,
         CAST(CAST(2000000 AS HUGEINT) * h.a // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score, h.k
  FROM halves AS h JOIN grams AS x ON x.lang = h.lang AND x.phrase = h.head JOIN grams AS y ON y.lang = h.lang AND y.phrase = h.rest
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), around AS (
  SELECT lang, array_to_string(list_slice(path, i, i + k - 1), ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, path, a, k, unnest(range(1, m - k + 2)) AS i FROM candidates, (VALUES (2), (3)) AS v(k) WHERE k < m) AS c
  GROUP BY ALL
), kept AS (
  SELECT best.*, n FROM best LEFT JOIN around USING (lang, phrase) JOIN sizes USING (lang)
  WHERE longer IS NULL OR CAST(longer AS HUGEINT) * 100 < CAST(a AS HUGEINT) * 80
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
