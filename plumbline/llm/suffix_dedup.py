"""Repeated passages by deep-shallow suffix sorting.

A byte goes if a string of ``LENGTH`` = 100 bytes that covers it also starts earlier: in a document with a smaller doc_id,
or earlier in the same one. All decisions are made on the texts as given.

Equal texts collapse to the one with the smallest doc_id; the others lose all they hold (below 100 bytes: nothing).

Suffixes that start with equal 100 bytes must meet in one task. The least hash among a window's ``GRAM``-byte substrings
depends on the window alone, so it names the bucket; neighbouring windows mostly share it, and such a run of windows is
handled as one stretch of text. First only the runs' hashes are counted: windows whose hash has no second run cannot
repeat. The stretches of the other runs are then taken from the texts, equal ones are combined before they move, and each
bucket orders the suffixes of what is left:

* shallow: multikey quicksort, eight bytes a symbol, down to ``SHALLOW`` bytes; a group of one is finished at once;
* deep: each group that still shares those bytes goes into a blind trie, which branches on single bytes, finds the leaf to
  compare with without looking at what lies between, and compares once. Suffixes equal in all 100 bytes share a leaf.

Every leaf keeps its earliest suffix; the windows of the others are removed. Where a hash has more than ``CROWDED`` runs,
they are dealt anew by whole windows, so that no bucket grows with one frequent passage and its many surroundings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import only, small_batches, text_of

LENGTH = 100
GRAM = 40
SHALLOW = 64
CROWDED = 100_000
# Text that one bucket stands for on average.
BUCKET_BYTES = 24 << 20
# Suffixes that a bucket sorts at a time, but for a larger group.
AT_ONCE = 1 << 19
# Windows of one text that are hashed at a time.
STEP = 1 << 21
NO_ID = (1 << 63) - 1
DIGEST = 16

_RUN = np.dtype([("key", "<u8"), ("start", "<i4"), ("n", "<i4")])
_MARK = np.dtype([("start", "<i4"), ("n", "<i4")])
_GRAM_FACTOR = 0xD6E8FEB86659FD93  # any odd number


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes at every place."""
    found = data.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < GRAM:
        more = min(width, GRAM - width)
        found = found[:-more] * np.uint64(pow(_GRAM_FACTOR, more, 1 << 64)) + found[more:]
        width += more
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    return found ^ found >> np.uint64(32)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    done = 1
    while done < width:
        more = min(done, width - done)
        values = np.minimum(values[:-more], values[more:])
        done += more
    return values


def runs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, number of windows) of every run; the number is negative where windows of it may be equal.

    Two equal windows of one run make its key's gram occur at two neighbouring places that are least in a window that
    starts or ends there, and no other such place lies between them.
    """
    keys, starts, counts = [], [], []
    width = LENGTH - GRAM + 1
    data = np.frombuffer(text, np.uint8)
    for begin in range(0, len(data) - LENGTH + 1, STEP):
        hashes = _gram_hashes(data[begin : begin + STEP + LENGTH - 1])
        key = _least(hashes, width)
        least = np.zeros(len(hashes), bool)
        least[: len(key)] = hashes[: len(key)] == key
        least[width - 1 :] |= hashes[width - 1 :] == key
        places = hashes[least]
        twice = np.unique(places[1:][places[1:] == places[:-1]])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[first, len(key)])
        keys.append(key[first])
        starts.append(first + begin)
        counts.append(np.where(np.isin(key[first], twice), -n, n) if len(twice) else n)
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, id, digest, n_bytes, text) of every row, and (digest, id, text) of every different text with its smallest id."""
    digest = F.unhex(F.substring(F.sha2(text_of(), 256), 1, 2 * DIGEST))
    size = F.octet_length(text_of())
    rows = only(docs, "doc_id", "text").select(
        "doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), digest.alias("digest"), size.alias("n_bytes"), text_of().alias("text")
    )
    return rows, rows.groupBy("digest").agg(F.min("id").alias("id"), F.min("text").alias("text"))


def _runs_by_bucket(buckets: int, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket of each batch; equal texts once.

    Of a key's several runs in a batch the first speaks for all; the others go to any bucket, as they are known to repeat.
    """
    for batch in batches:
        digests, found, seen = batch.column("digest"), [], set()
        for i, (digest, text) in enumerate(zip(digests.to_pylist(), batch.column("text"))):
            raw = text.as_buffer().to_pybytes()
            if len(raw) >= LENGTH and digest not in seen:
                seen.add(digest)
                key, start, n = runs(raw)
                found.append((key, np.full(len(key), i, np.int32), start, n))
        if not found:
            continue
        key, doc, start, n = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(key, kind="stable")
        key, doc, start, n = key[order], doc[order], start[order], n[order]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        many = np.zeros(len(key), np.int32)
        many[cuts[:-1]] = np.diff(cuts)
        again = many == 0
        target = np.where(again, doc, (key % np.uint64(buckets)).astype(np.int64)) % buckets
        yield from _by_bucket(target, digests, doc, {"key": key, "start": start.astype(np.int32), "n": n.astype(np.int32), "many": many})


def _by_bucket(target: np.ndarray, digests: pa.Array, doc: np.ndarray, values: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(target, kind="stable")
    target = target[order]
    cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1], True])
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = order[a:b]
        used, local = np.unique(doc[part], return_inverse=True)
        held = {k: v[part].tobytes() for k, v in values.items()}
        rows.append({"bucket": int(target[a]), "digests": b"".join(digests[int(i)].as_py() for i in used), "doc": local.astype(np.int32).tobytes(), **held})
    if rows:
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in rows[0] if k != "bucket"]]))


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), f"V{DIGEST}")


def _joined(table: pa.Table, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), dtype)


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All digests of a bucket's rows, and each entry's place among them."""
    digests = _digests(table.column("digests"))
    sizes = np.array([len(x.as_py()) // DIGEST for x in table.column("digests")], np.int64)
    entries = [len(x.as_py()) // 4 for x in table.column("doc")]
    return digests, _joined(table, "doc", "<i4") + np.repeat(np.cumsum(sizes) - sizes, entries)


def _per_document(digests: np.ndarray, doc: np.ndarray, values: np.ndarray, name: str) -> pa.Table:
    """One row per document: its digest and its values as bytes."""
    names, of = np.unique(digests, return_inverse=True) if len(digests) else (digests, np.empty(0, np.int64))
    owner = of[doc]
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
    rows = [(names[owner[order[a]]].tobytes(), values[order[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.table({"digest": pa.array([r[0] for r in rows], pa.binary()), name: pa.array([r[1] for r in rows], pa.binary())})


def _repeated(crowded: int, table: pa.Table) -> pa.Table:
    """The runs whose key occurs twice or may repeat in itself, by document, and the crowded keys under an empty digest."""
    digests, doc = _documents(table)
    found = np.empty(len(doc), _RUN)
    for name, dtype in (("key", "<u8"), ("start", "<i4"), ("n", "<i4")):
        found[name] = _joined(table, name, dtype)
    many = _joined(table, "many", "<i4")
    names, of = np.unique(digests, return_inverse=True)
    text = of[doc]
    order = np.lexsort((found["start"], text, found["key"]))
    key, text, start = found["key"][order], text[order], found["start"][order]
    fresh = np.r_[True, key[1:] != key[:-1]]
    other = fresh | np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1])]  # not the same text from another batch
    first = np.flatnonzero(fresh)
    key_of = np.cumsum(fresh) - 1
    different = np.add.reduceat(other.astype(np.int64), first)
    runs_of = np.add.reduceat(many[order].astype(np.int64), first)
    kept = other & ((different[key_of] > 1) | (found["n"][order] < 0) | (many[order] != 1))
    out = _per_document(digests, doc[order][kept], found[order][kept], "runs")
    hot = key[first][runs_of > crowded]
    return pa.concat_tables([out, pa.table({"digest": pa.array([b""], pa.binary()), "runs": pa.array([hot.tobytes()], pa.binary())})])


def _stretches(buckets: int, crowded: frozenset[int], batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of every repeated run, by bucket; equal stretches of a batch once, the later ones as windows to remove."""
    turn = 0
    for batch in batches:
        first: dict[tuple[int, bytes], tuple[int, int, int, int]] = {}
        more: list[tuple[int, int, int, int, int, bytes]] = []
        done: list[tuple[int, int, int]] = []
        for i, (at, text, parts) in enumerate(zip(batch.column("id").to_pylist(), batch.column("text"), batch.column("runs"))):
            if not text.is_valid:
                continue
            raw = text.as_buffer().to_pybytes()
            found = np.frombuffer(b"".join(parts.as_py()), _RUN)
            for run in found[np.unique(found[["key", "start"]], return_index=True)[1]].tolist():
                for key, start, n in _split(raw, *run) if run[0] in crowded else (run,):
                    stretch = raw[start : start + abs(n) + LENGTH - 1]
                    known = first.setdefault((key, stretch), (at, start, n, i))
                    if known[3] == i and known[1] == start:
                        continue
                    if (at, start) == known[:2]:  # another text of the same id: neither is the earlier one
                        more.append((at, start, n, i, key, stretch))
                        continue
                    if (at, start) < known[:2]:
                        first[key, stretch] = (at, start, min(n, known[2]), i)
                        (_, start, n, i_late) = known
                    else:
                        i_late = i
                    done.append((i_late, start, abs(n)))
        entries = [(*place, key, stretch) for (key, stretch), place in first.items()] + more
        digests = batch.column("digest")
        rows = []
        dealt: dict[int, list] = {}
        for entry in entries:
            dealt.setdefault(entry[4] % buckets, []).append(entry)
        for bucket, some in dealt.items():
            at, start, n, doc, key, stretch = zip(*some)
            rows.append(_row(bucket, digests, doc, at, start, n, key, b"".join(stretch)))
        if done:  # known already: any task may hand these on
            turn += 1
            doc, start, n = zip(*done)
            rows.append(_row((turn + done[0][0]) % buckets, digests, doc, [0] * len(doc), start, n, [0] * len(doc), b""))
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _STRETCHES)


_STRETCHES = pa.schema([("bucket", pa.int32()), *[(k, pa.binary()) for k in ("digests", "doc", "id", "start", "n", "key", "data")]])


def _row(bucket: int, digests: pa.Array, doc: Iterable[int], at: Iterable[int], start: Iterable[int], n: Iterable[int], key: Iterable[int], data: bytes) -> dict:
    used, local = np.unique(np.array(doc, np.int64), return_inverse=True)
    held = {"doc": (local, "<i4"), "id": (at, "<i8"), "start": (start, "<i4"), "n": (n, "<i4"), "key": (key, "<u8")}
    return {"bucket": bucket, "digests": b"".join(digests[int(i)].as_py() for i in used), **{k: np.array(v, t).tobytes() for k, (v, t) in held.items()}, "data": data}


def _split(raw: bytes, key: int, start: int, n: int) -> Iterator[tuple[int, int, int]]:
    """The single windows of a run under hashes of their own."""
    for at in range(start, start + abs(n)):
        yield xxhash.xxh64_intdigest(raw[at : at + LENGTH]), at, 1


def _later_windows(table: pa.Table) -> pa.Table:
    """The windows of a bucket that start earlier elsewhere, by document."""
    digests, doc = _documents(table)
    ids, start, n, key = (_joined(table, k, t) for k, t in (("id", "<i8"), ("start", "<i4"), ("n", "<i4"), ("key", "<u8")))
    told = np.concatenate([np.full(len(d.as_py()) // 4, not len(x.as_py())) for d, x in zip(table.column("doc"), table.column("data"))])
    marks = [(doc[told], start[told].astype(np.int64), np.abs(n[told]).astype(np.int64))]
    doc, ids, start, n, key = (x[~told] for x in (doc, ids, start, n, key))
    data = b"".join(x.as_py() for x in table.column("data"))
    size = np.abs(n).astype(np.int64) + LENGTH - 1
    begin = np.cumsum(size) - size

    earliest: dict[tuple[int, bytes], int] = {}
    sure = np.zeros(len(doc), bool)
    for i in np.lexsort((start, ids)).tolist():
        j = earliest.setdefault((int(key[i]), data[begin[i] : begin[i] + size[i]]), i)
        sure[i] = ids[j] != ids[i] or start[j] != start[i]
    del earliest
    marks.append((doc[sure], start[sure].astype(np.int64), np.abs(n[sure]).astype(np.int64)))

    left = np.flatnonzero(~sure)
    names, of, many = np.unique(key[left], return_inverse=True, return_counts=True)
    searched = (many[of] > 1) | (n[left] < 0)
    by_group = np.argsort(of[searched], kind="stable")
    entry, group = left[searched][by_group], of[searched][by_group]
    windows = np.abs(n[entry]).astype(np.int64)
    for a, b in _slices(group, windows):
        some = entry[a:b]
        offset = np.arange(windows[a:b].sum()) - np.repeat(np.cumsum(windows[a:b]) - windows[a:b], windows[a:b])
        owner = np.repeat(some, windows[a:b])
        later = _not_first(data, begin[owner] + offset, np.repeat(group[a:b], windows[a:b]), ids[owner], start[owner] + offset)
        marks.append((doc[owner[later]], start[owner[later]] + offset[later], np.ones(len(later), np.int64)))

    doc, start, n = (np.concatenate(x) for x in zip(*marks))
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    if len(doc):  # windows in a row become one entry
        fresh = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + n[:-1])]
        first = np.flatnonzero(fresh)
        doc, start, n = doc[first], start[first], np.add.reduceat(n, first)
    out = np.empty(len(doc), _MARK)
    out["start"], out["n"] = start, n
    return _per_document(digests, doc, out, "marks")


def _slices(group: np.ndarray, windows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of the sorted groups with about ``AT_ONCE`` windows; no group is cut."""
    if not len(group):
        return
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    part = np.add.reduceat(windows, first).cumsum() // AT_ONCE
    cuts = [*first[np.flatnonzero(np.r_[True, part[1:] != part[:-1]])].tolist(), len(group)]
    yield from zip(cuts[:-1], cuts[1:])


def _not_first(data: bytes, place: np.ndarray, group: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The suffixes that equal an earlier one of their group in all of LENGTH bytes.

    ``place``: where they begin in ``data``; ``ids`` and ``start`` say which is the earlier.
    """
    if not len(place):
        return np.empty(0, np.int64)
    symbols = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    active, group = np.arange(len(place)), group.astype(np.int64)
    for depth in range(0, SHALLOW, 8):
        symbol = symbols[place[active] + depth].astype(np.uint64)
        order = np.lexsort((symbol, group))
        active, group, symbol = active[order], group[order], symbol[order]
        fresh = np.r_[True, (group[1:] != group[:-1]) | (symbol[1:] != symbol[:-1])]
        alone = fresh & np.r_[fresh[1:], True]
        active, group = active[~alone], (np.cumsum(fresh) - 1)[~alone]
        if not len(active):
            return active
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    found = []
    at = place[active].tolist()
    order = np.lexsort((start[active], ids[active]))
    fresh = np.r_[True, (np.diff(ids[active][order]) != 0) | (np.diff(start[active][order]) != 0)]
    rank = np.empty(len(active), np.int64)
    rank[order] = np.cumsum(fresh)
    rank = rank.tolist()
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        trie = BlindTrie()
        for i in range(a, b):
            p = at[i]
            trie.add(data[p + SHALLOW : p + LENGTH], i)
        for same in trie.ordered():
            if len(same) > 1:
                least = min(rank[i] for i in same)
                found.extend(i for i in same if rank[i] != least)
    return active[np.array(found, np.int64)]


class BlindTrie:
    """Strings of one length in order. A branch holds the place where its strings differ first and the bytes found there."""

    def __init__(self) -> None:
        self._root: list | tuple | None = None

    def add(self, string: bytes, value: object) -> None:
        node = self._root
        if node is None:
            self._root = (string, [value])
            return
        while type(node) is list:  # down by single bytes, without a look at those between
            branches = node[1]
            node = branches.get(string[node[0]]) or next(iter(branches.values()))
        leaf = node[0]
        if leaf == string:
            node[1].append(value)
            return
        depth = next(i for i, (x, y) in enumerate(zip(leaf, string)) if x != y)
        above, node = None, self._root
        while type(node) is list and node[0] < depth:
            above, node = node, node[1][string[node[0]]]
        fresh = (string, [value])
        if type(node) is list and node[0] == depth:
            node[1][string[depth]] = fresh
            return
        branch = [depth, {leaf[depth]: node, string[depth]: fresh}]
        if above is None:
            self._root = branch
        else:
            above[1][string[above[0]]] = branch

    def ordered(self) -> Iterator[list]:
        """The values of each different string, smallest string first."""
        todo = [self._root] if self._root is not None else []
        while todo:
            node = todo.pop()
            if type(node) is list:
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                yield node[1]


def _cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans and what is left of every text."""
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans, kept = [], []
        for text, parts in zip(batch.column("text"), batch.column("marks")):
            raw = text.as_buffer().to_pybytes()
            marks = np.sort(np.frombuffer(b"".join(parts.as_py() or []), _MARK), order="start")
            begin = marks["start"].astype(np.int64)
            end = np.maximum.accumulate(begin + marks["n"] + LENGTH - 1) if len(begin) else begin
            fresh = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]]) if len(begin) else np.empty(0, np.int64)
            some = list(zip(begin[fresh].tolist(), end[np.r_[fresh[1:] - 1, len(begin) - 1]].tolist() if len(begin) else []))
            edges = [0, *[x for span in some for x in span], len(raw)]
            spans.append([{"start": a, "end": b} for a, b in some])
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("digest"), pa.array(spans, spans_type), pa.array(kept, pa.binary())], names=["id", "digest", "spans", "kept"]
        )


def remove_repeats(docs: DataFrame, kept: Column | None = None, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, spans (start and end of every maximal removed run, in bytes) and kept (the bytes left) of every row.

    ``kept``, an expression over the column of that name, is returned in its place, before rows move.
    A null text is empty. A null doc_id counts as larger than any other. Rows that share a doc_id count as one document:
    of two equal strings that start at the same place in such rows neither is the earlier, so repeated rows have equal
    results. Texts of any length are hashed in steps. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = F.col("kept") if kept is None else kept
    rows, texts = _texts(docs)
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(64, -(-int(total) // BUCKET_BYTES))

    columns = "bucket int, digests binary, doc binary, key binary, start binary, n binary, many binary"
    counted = rows.select("digest", "text").mapInArrow(partial(_runs_by_bucket, buckets), columns)
    repeated = cut(counted.groupBy("bucket").applyInArrow(lambda part: _repeated(crowded, part), "digest binary, runs binary"), "runs")
    # at most one key per ``crowded`` runs of the corpus
    hot = frozenset(np.frombuffer(b"".join(bytes(r.runs) for r in repeated.where("digest = X''").collect()), "<u8").tolist())
    wanted = repeated.where("digest <> X''").groupBy("digest").agg(F.collect_list("runs").alias("runs"))
    columns = "bucket int, digests binary, doc binary, id binary, start binary, n binary, key binary, data binary"
    # left joins both times, so that one exchange of the texts serves both
    held = F.when(F.col("runs").isNotNull(), F.col("text")).alias("text")
    stretches = texts.join(wanted, "digest", "left").select("id", "digest", held, "runs").mapInArrow(partial(_stretches, buckets, hot), columns)
    later = stretches.groupBy("bucket").applyInArrow(lambda part: _later_windows(part), "digest binary, marks binary")
    marked = later.groupBy("digest").agg(F.collect_list("marks").alias("marks"))
    done = texts.join(marked, "digest", "left").select("id", "digest", "text", "marks").mapInArrow(
        _cut_out, "id long, digest binary, spans array<struct<start: long, end: long>>, kept binary"
    )
    found = done.select("id", "digest", "spans", kept.alias("kept"))

    rest = F.when(F.col("n_bytes") < LENGTH, F.col("text").cast("binary")).otherwise(F.lit(b""))
    size = F.col("n_bytes").cast("long")
    whole = F.when(size >= LENGTH, F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))).otherwise(F.array().cast("array<struct<start: bigint, end: bigint>>"))
    alone = rows.withColumn("kept", rest).select("doc_id", "id", "digest", size.alias("n_bytes"), whole.alias("whole"), kept.alias("copy"))
    both = alone.join(found, ["id", "digest"], "left")
    return both.select("doc_id", "n_bytes", F.coalesce("spans", "whole").alias("spans"), F.coalesce("kept", "copy").alias("kept"))
