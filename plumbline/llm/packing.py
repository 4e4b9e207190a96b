"""Packing of tokenised documents into sequences of a fixed length.

Documents are encoded, closed with an end id and cut only where they are longer than a sequence: the
remainder comes first, the other pieces fill a sequence each. Pieces are packed in three steps.

1. Each block of at most ``BLOCK`` pieces of a partition is packed best fit, longest first.
2. Sequences with at most ``SLACK`` free places are done. The others become items of a tree: groups of blocks
   merge, about ``FAN`` at a time, and pack the items best fit again. Within a group any two sequences left
   over hold more than one sequence, so at most one of them is half empty; a merge joins a half-empty one to
   another, so a group hands on its ``KEEP`` emptiest and the rest are done. No piece is ever left out.
3. Each piece adds up the shifts of the sequences that it moved with.

Only ids and lengths take part from step 2 on, and only pieces from step 1 on; texts are read once.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..session import cut
from .common import only, per_worker, small_batches

LENGTH = 2048
END_ID = 0
BLOCK = 1 << 16
SLACK = 16
FAN = 8
KEEP = 1024
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Ids:
    """The ids that a byte-level BPE file of the tokenizers library gives, as little-endian 32-bit integers.

    Where every character is of a kind on which the split patterns of all libraries agree, the file's vocabulary is run
    by tiktoken, which takes a fourth of the time; all other texts, and those in which the file's added tokens are spelled
    out (one id each), go to the tokenizers library itself. In such a vocabulary a token's id is its rank among the merges,
    which is what tiktoken needs.
    """

    def __init__(self, path: str):
        self.exact = Tokenizer.from_file(path)
        special = sorted(t.content for t in self.exact.get_added_tokens_decoder().values())
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        spelled = dict(zip(_byte_letters(), range(256)))
        ranks = {bytes(spelled[c] for c in t): i for t, i in self.exact.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if _UNUSUAL.search(text) or self.special.search(text) or len(text) > LONG and _LONG_RUN.search(text):
            ids = self.exact.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


# Characters beyond Latin; a run of white space long enough to exhaust a backtracking pattern.
_UNUSUAL, _LONG_RUN = re.compile(r"[^\x00-\u024F]"), re.compile(r"\s{10000}")
LONG = 100_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in such a file: itself if it can be printed, else the next free one from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printed else chr(next(free)) for b in range(256)]


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every document's ids and the end id, cut where longer than ``length``."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        ids_of = per_worker(("ids", path), lambda: Ids(path))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = ids_of(text or "") + end
                total = len(ids) // 4
                cuts = [0, *range(total % length or length, total, length), total]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])))
            columns = zip(*rows) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, "doc_id", "text").mapInArrow(run, PIECE)


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and fill of the bin for each size, packed longest first into the fullest bin that has room.

    Equal sizes go by position. ``rooms`` has bit r set while some open bin has exactly r places left.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    fills: list[int] = []
    rooms = 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = length, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        room -= size
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(fills, np.int64)[bins]


def _pack_blocks(length: int, block: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, done, held, size = TaskContext.get().partitionId(), 0, [], 0

        def pack(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal done
            bins, offsets, fills = best_fit(rows["length"].to_numpy(), length)
            packed = rows.assign(bin=(part << 40) + done + bins, offset=offsets, fill=fills, block=(part << 40) + done)
            done += len(rows)
            return packed

        for frame in frames:
            held.append(frame)
            size += len(frame)
            while size >= block:
                rows = pd.concat(held, ignore_index=True)
                yield pack(rows.iloc[:block])
                held, size = [rows.iloc[block:]], size - block
        if size:
            yield pack(pd.concat(held, ignore_index=True))

    return run


def _merge(length: int, slack: int, keep: int):
    def run(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["fill", "bin"], ascending=[False, True], ignore_index=True)
        bins, offsets, fills = best_fit(items["fill"].to_numpy(), length)
        first = items["bin"].to_numpy()[np.unique(bins, return_index=True)[1]]
        host = first[bins]
        moved = items.assign(host=host, shift=offsets, full=fills)
        open_hosts = moved[(moved["shift"] == 0) & (moved["full"] < length - slack)].nsmallest(keep, "full")["bin"]
        return moved.assign(stays=moved["bin"].isin(open_hosts))[["group", "bin", "host", "shift", "full", "stays"]]

    return run


def pack(items: DataFrame, length: int = LENGTH, block: int = BLOCK, slack: int = SLACK, fan: int = FAN, keep: int = KEEP) -> DataFrame:
    """All columns of ``items`` (a table that can be reread, with ``length`` of 1 to the sequence length), sequence_id and offset."""
    given = items.columns
    schema = items.selectExpr("*", "0L AS bin", "0L AS offset", "0L AS fill", "0L AS block").schema
    packed = cut(items.mapInPandas(_pack_blocks(length, block), schema), "packed")
    state = packed.where((F.col("offset") == 0) & (F.col("fill") < length - slack)).select(F.col("block").alias("group"), "bin", "fill")
    groups = state.agg(F.count_distinct("group")).first()[0]
    moves: DataFrame | None = None
    while groups > 1:
        groups = -(-groups // fan)
        dealt = state.withColumn("group", F.pmod(F.xxhash64("group"), F.lit(groups)))
        merged = cut(dealt.groupBy("group").applyInPandas(_merge(length, slack, keep), "group long, bin long, host long, shift long, full long, stays boolean"), "merged")
        state = merged.where("stays").select("group", "bin", F.col("full").alias("fill"))
        step = merged.where("shift > 0").select("bin", "host", "shift")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("host"), F.col("host").alias("next"), F.col("shift").alias("more"))
            carried = moves.join(later, "host", "left").select("bin", F.coalesce("next", "host").alias("host"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            moves = carried.unionByName(step)
    if moves is None:
        return packed.select(*given, F.col("bin").alias("sequence_id"), "offset")
    placed = packed.join(moves, "bin", "left")
    return placed.select(*given, F.coalesce("host", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of ``docs`` (doc_id, text).

    A null or empty text is one piece that holds the end id. Repeated rows are packed as often as they occur.
    An empty table gives no rows.
    """
    return pack(cut(pieces(docs, path, length), "pieces"), length)
