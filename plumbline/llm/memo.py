"""Token ids of texts, space-delimited chunk by chunk, with a bounded memory of chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

# Chunks in each of the two generations of the memory.
CHUNKS = 300_000
LONGEST = 64
# A space followed by white space or the end belongs to a longer run, so such a text isn't cut at spaces.
_RUN = re.compile(r" (?:\s|$)")


class ChunkMemo:
    """Ids as little-endian 32-bit integers.

    A space before a character that isn't white space always begins a match of the byte-level split pattern,
    and merges never cross matches: so texts may be encoded between such spaces, and equal chunks once.
    ``encode(pieces)`` gives the ids of each piece as bytes. Long chunks are never kept.
    """

    def __init__(self, encode: Callable[[Sequence[str]], Iterable[bytes]]):
        self.encode = encode
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        cut = [None if _RUN.search(t) else t.split(" ") for t in texts]
        whole = [t if c is None else c[0] for t, c in zip(texts, cut)]
        heads = self.encode(whole)
        tails = [c[1:] if c else [] for c in cut]
        wanted = set().union(*tails).difference(self.new)
        for c in wanted.intersection(self.old):
            self.new[c] = self.old[c]
        unknown = list(wanted.difference(self.old))
        known = self.new
        passing = {}
        for c, ids in zip(unknown, self.encode([" " + c for c in unknown])):
            (known if len(c) <= LONGEST else passing)[c] = ids
        if passing:
            known = _Either(known, passing)
        out = [head + b"".join(map(known.__getitem__, tail)) for head, tail in zip(heads, tails)]
        if len(self.new) > CHUNKS:
            self.old, self.new = self.new, {}
        return out


class _Either:
    def __init__(self, first: dict, second: dict):
        self.first, self.second = first, second

    def __getitem__(self, key: str) -> bytes:
        return self.first[key] if key in self.first else self.second[key]
