"""Near-duplicate groups by SimHash fingerprints.

Fingerprint: a document's words (ASCII white space separates them, A-Z lower-cased) give 3-word shingles,
repeats included; a bit is 1 if it is set in more than half of the shingles' XXH64 values (seed 42).

Search: the 64 bits are cut into 32 segments of two bits and each segment is mapped to its bit count.
The Manhattan distance of two such count vectors never exceeds the Hamming distance of the fingerprints.
Within ``RADIUS`` = 3 the two halves of the vector (16 segments each) cannot both differ by 2 or more, so
in one half the vectors are equal or one unit apart in one segment. Every distinct fingerprint is filed
under the cell of each half and asks its own cell and those one unit up; the unit down is asked by the
other side. What meets in a cell is verified on all 64 bits.

Copies collapse to one fingerprint first. A cell returns only links that join two groups not yet joined in
that task, so m fingerprints of a dense cell give at most m - 1 links although every one is compared. Cells
with more than ``TILE`` fingerprints are split into tiles, each of which gets all the askers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import only, small_batches

RADIUS = 3
SEED = 42
TILE = 20_000
# Fixed value: the lower bit of every two-bit segment of a 32-bit half.
LOW_BITS = 0x55555555
SEGMENTS = 16
SHINGLES_AT_ONCE = 1 << 16
ROWS_AT_ONCE = 1 << 18

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint; zero for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    total = max(1, len(words) - 2)
    shingles = map(b" ".join, zip(words, words[1:], words[2:]) if len(words) > 2 else [words])
    votes = np.zeros(64, np.int64)
    for start in range(0, total, SHINGLES_AT_ONCE):
        some = min(SHINGLES_AT_ONCE, total - start)
        hashes = np.fromiter(map(_hash, islice(shingles, some)), np.uint64, some)
        votes += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    bits = np.packbits(2 * votes > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, name: str = "fp", text: str = "text") -> DataFrame:
    """All columns of ``docs`` and the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    schema = docs.select("*", F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            prints = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
            columns = [*batch.columns, pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def _cells(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Filed rows and asking rows: (half, cell, fp)."""
    halves = F.array(
        *[F.struct(F.lit(h).cast("byte").alias("half"), half.alias("bits")) for h, half in enumerate(_halves(F.col("fp")))]
    )
    rows = prints.select("fp", F.inline(halves))
    low = F.lit(LOW_BITS).cast("long")
    filed = rows.select("half", (F.col("bits").bitwiseAND(low) + F.shiftright("bits", 1).bitwiseAND(low)).alias("cell"), "fp")
    steps = [F.when(F.shiftright("cell", 2 * s).bitwiseAND(F.lit(3)) < 2, F.col("cell") + F.lit(1 << 2 * s)) for s in range(SEGMENTS)]
    asked = filed.select("half", "fp", F.explode(F.array(F.col("cell"), *steps)).alias("cell")).where("cell IS NOT NULL")
    return filed, asked.select("half", "cell", "fp")


def _halves(fp: Column) -> tuple[Column, Column]:
    mask = F.lit((1 << 32) - 1)
    return fp.bitwiseAND(mask), F.shiftrightunsigned(fp, 32)


def _links_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links of a partition sorted by (half, cell, tile, asks); a cell is never cut in two."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        place = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
        held.append((place[0] << 60 | place[1] << 24 | place[2], place[3], batch.column(4).to_numpy().view(np.uint64)))
        size += batch.num_rows
        if size >= ROWS_AT_ONCE:
            cell, asks, fp = (np.concatenate(x) for x in zip(*held))
            whole = int(np.searchsorted(cell, cell[-1]))
            if whole:
                yield from _link(cell[:whole], asks[:whole], fp[:whole])
            held = [(cell[whole:], asks[whole:], fp[whole:])]
            size = len(cell) - whole
    if size:
        yield from _link(*(np.concatenate(x) for x in zip(*held)))


def _link(cell: np.ndarray, asks: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(cell)]))
    filed = np.bincount(of, weights=asks == 0, minlength=len(starts)).astype(np.int64)
    asker = np.flatnonzero((asks == 1) & (filed[of] > 0))
    if not len(asker):
        return
    names, node = np.unique(fp, return_inverse=True)
    root = np.arange(len(names))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    group = root.copy()  # every node's root as of the last step: pairs within a group need no further look
    left, right, step = [], [], 0
    while len(asker):
        other = starts[of[asker]] + step
        a, b = node[asker], node[other]
        near = np.flatnonzero((np.bitwise_count(fp[asker] ^ fp[other]) <= RADIUS) & (group[a] != group[b]))
        for i, j in zip(a[near].tolist(), b[near].tolist()):
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(names[i])
                right.append(names[j])
        if len(near):
            group = root.copy()
            while (root[group] != group).any():
                group = root[group]
        step += 1
        asker = asker[filed[of[asker]] > step]
    if left:
        pairs = [pa.array(np.array(side, np.uint64).view(np.int64)) for side in (left, right)]
        yield pa.RecordBatch.from_arrays(pairs, names=["a", "b"])


def links(prints: DataFrame, tile: int = TILE) -> DataFrame:
    """Verified pairs (a, b) that span every group of fingerprints chained within ``RADIUS`` bits.

    ``prints`` holds distinct fingerprints in ``fp``.
    """
    filed, asked = _cells(prints)
    crowded = filed.groupBy("half", "cell").count().where(F.col("count") > tile)
    tiles = crowded.select("half", "cell", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    both = filed.select("*", F.lit(0).alias("asks")).unionByName(asked.select("*", F.lit(1).alias("asks")))
    dealt = both.join(tiles, ["half", "cell"], "left")
    count = F.coalesce("tiles", F.lit(1))
    own = F.when(F.col("asks") == 1, F.sequence(F.lit(0), count - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), count).cast("int")))
    placed = dealt.select("half", "cell", F.explode(own).alias("tile"), "asks", "fp")
    keys = ["half", "cell", "tile"]
    return placed.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(_links_in, "a long, b long")


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node in ``pairs`` (a, b): the smallest node reachable.

    Alternates large-star and small-star rounds, each written to the shared folder, until every node hangs
    directly below its root. A hub's neighbours only ever meet its minimum, never each other.
    """
    edges = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(below, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(joined.unionByName(below.select("a", F.col("m").alias("b"))).distinct(), "links")
        ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))))
        # every node either has one root or is one
        mixed = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR ups = 1 AND least = 0")
        if mixed.isEmpty():
            rooted = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))
            return edges.select(F.inline(rooted)).distinct()


def groups(prints: DataFrame) -> DataFrame:
    """(fp, root, component_id): the smallest doc_id among all documents chained to a fingerprint.

    ``prints`` has doc_id and fp and is read several times; root names the group by its smallest fingerprint.
    A null doc_id names a group only if there is no other id in it.
    """
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    linked = components(links(nodes.select("fp"))).withColumnRenamed("node", "fp")
    named = nodes.join(linked, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return named.join(smallest, "root").select("fp", "root", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text).

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay.
    An empty table gives no rows.
    """
    prints = cut(with_fingerprint(only(docs, "doc_id", "text")).select("doc_id", "fp"), "prints")
    found = prints.join(groups(prints), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest doc_id.

    A null doc_id comes last. Rows of one group that share this doc_id are told apart by fingerprint; of
    those with the same fingerprint too a single one stays.
    """
    mark, names = "__llm_fp", docs.columns
    marked = cut(with_fingerprint(docs, mark), "marked")
    prints = marked.select("doc_id", F.col(mark).alias("fp"))
    rows = prints.groupBy("doc_id", "fp").agg(F.count(F.lit(1)).alias("n"))
    member = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "n")
    best = rows.join(groups(prints), "fp").groupBy("root").agg(F.min(member).alias("best"))
    chosen = cut(best.select(F.col("best.doc_id").alias("__llm_id"), F.col("best.fp").alias("__llm_f"), F.col("best.n").alias("__llm_n")), "chosen")
    same = F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col(mark) == F.col("__llm_f"))
    found = marked.join(chosen, same)
    alone = found.where("__llm_n = 1").select(*marked.columns)
    repeated = found.where("__llm_n > 1").select(*marked.columns).dropDuplicates(["doc_id", mark])
    return only(alone.unionByName(repeated), *names)
