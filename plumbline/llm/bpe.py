"""Byte-level BPE: texts to token ids and back.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over strings finds the longest
token at every byte of a split piece. From there the encoding goes left to right: the longest token that
is compatible with the one before it is taken, shorter prefixes are tried next, and a dead end is marked
and left by dropping the last token. Two neighbours are compatible if BPE, run on both together, would not
have merged across their seam; such answers are remembered. Every position is entered a bounded number of
times, so a piece takes linear time, and the result is that of the merges in order of rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from .common import per_worker, small_batches
from .memo import ChunkMemo

SEAMS = 2_000_000


class Coder:
    """The vocabulary of a rank file: a base64 token and its rank on each line; ids are ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(t).decode("latin-1"): int(r) for t, r in pairs}
        size = max(self.rank.values()) + 1
        self.text: list[str] = [""] * size
        for t, r in self.rank.items():
            self.text[r] = t
        self.spelling = [t.encode("latin-1") for t in self.text]
        self.pieces = regex.compile(pattern).findall
        self.halves: list[tuple[int, int] | None] = [None] * size
        reachable = {}
        for t, r in sorted(self.rank.items(), key=lambda x: x[1]):
            parts = self._merged(t, r)
            if len(parts) == 2:
                self.halves[r] = (self.rank[parts[0]], self.rank[parts[1]])
            if len(parts) == 2 or len(t) == 1:
                reachable[t] = r
        self.automaton = ahocorasick.Automaton()
        self.shorter: list[int] = [-1] * size
        for t, r in reachable.items():
            self.automaton.add_word(t, (r, len(t) - 1))
            self.shorter[r] = next((reachable[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in reachable), -1)
        self.automaton.make_automaton()
        self.seams: dict[tuple[int, int], bool] = {}
        self.memo = ChunkMemo(lambda chunks: [self._packed(c) for c in chunks])

    def _merged(self, token: str, below: int) -> list[str]:
        """The parts of a token once all merges of rank under ``below`` are done."""
        parts = list(token)
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, below) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least >= below:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        """Undo the merges on both sides of a seam, the latest first; none may have come too late to stop one across it."""
        limit = len(self.text)
        while True:
            if self.rank.get(self.text[left] + self.text[right], limit) < limit:
                return False
            undo_left, undo_right = self.halves[left], self.halves[right]
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or undo_left is not None and left > right:
                limit, left = left, undo_left[1]
            else:
                # of two merges of one rank the one further left comes first, and that is the one across the seam
                limit, right = right + 1, undo_right[0]

    def _fits(self, left: int, right: int) -> bool:
        known = self.seams.get((left, right))
        if known is None:
            if len(self.seams) >= SEAMS:
                self.seams.clear()
            known = self.seams[left, right] = self._compatible(left, right)
        return known

    def piece(self, word: str) -> list[int]:
        """The ids of one match of the split pattern."""
        s = word.encode().decode("latin-1")
        whole = self.rank.get(s)
        if whole is not None:
            return [whole]
        longest = [0] * len(s)
        for end, (token, back) in self.automaton.iter(s):
            longest[end - back] = token
        out: list[int] = []
        dead: set[int] = set()
        at, token, text, shorter, fits = 0, longest[0], self.text, self.shorter, self._fits
        while at < len(s):
            end = at + len(text[token])
            if end not in dead and (not out or fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(s) else token
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = out.pop()
                at -= len(text[token])
        return out

    def _packed(self, chunk: str) -> bytes:
        return np.array([i for word in self.pieces(chunk) for i in self.piece(word)], "<i4").tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        return self.memo.ids(texts)

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))


def coder(path: str) -> Coder:
    """One per Python worker."""
    return per_worker(("bpe", path), lambda: Coder(path))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` (a column named ``ids`` is replaced) and each whole text's ids as array<int>. Null text: no ids."""
    small_batches(docs.sparkSession)
    docs = docs.drop(ids)
    schema = docs.selectExpr("*", f"array(0) AS `{ids}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            found = coder(path).encode(texts)
            offsets = np.cumsum([0, *map(len, found)]) // 4
            values = pa.array(np.frombuffer(b"".join(found), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, ids])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of ``tokens`` (a column named ``decoded`` is replaced) and the bytes that the ids spell. Null ids: no bytes."""
    small_batches(tokens.sparkSession)
    tokens = tokens.drop(decoded)
    schema = tokens.selectExpr("*", f"CAST('' AS BINARY) AS `{decoded}`").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spell = coder(path).decode
            found = [spell(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in batch.column(batch.schema.get_field_index(ids))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, decoded])

    return tokens.mapInArrow(run, schema)
