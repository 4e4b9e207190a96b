"""Document fingerprints: weighted SimHash of 128 bits, and the search for fingerprints within a radius.

Terms are the runs of ``TERM`` words (white space separates them, lower case), shorter at the end of a text. A term
weighs its bytes, ``HEAVIEST`` at most, and votes with that weight for or against every bit of its two XXH64 hashes;
a bit is 1 if more than half of the weight is for it. A text without words has the fingerprint zero.

Votes are counted four bits to a long, in lanes of 16 bits that a part of ``PART`` terms cannot overflow, then widened
to 32 bits: a text of any length is split into parts, each a row of a partial aggregate. All of it is generated JVM code.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import count_below
from ..session import cut
from .common import only, shuffle_width, text_of

TERM = 3
HEAVIEST = 16
# PART * HEAVIEST stays below the 15 bits that a lane may use without touching a long's sign.
PART = 2047
SEEDS = (0, 1)
BITS = 64 * len(SEEDS)
RADIUS, BLOCKS, EVERY, HOT_KEY = 3, 4, 100, 20_000
LANE, WIDE = 0x0001000100010001, 0x0000FFFF0000FFFF
SPACE = r"[\x09-\x0D\x20]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), SPACE), "")


def _votes(h: Column, k: int, weight: Column) -> Column:
    return F.sum(weight * F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANE)))


def simhash(texts: DataFrame, keys: Sequence[str], text: str = "text", name: str = "fp") -> DataFrame:
    """``keys``, which tell the rows of ``texts`` apart, and ``name``: an array of two longs.

    If ``texts`` is already hash-partitioned by some of ``keys``, nothing is shuffled.
    """
    words = texts.select(*keys, _words(text_of(text)).alias("__words"))
    shifted = [F.slice("__words", i + 1, F.greatest(F.size("__words"), F.lit(1))) for i in range(TERM)]
    named = words.select(*keys, F.posexplode_outer(F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])).alias("__pos", "__term"))
    parts = [F.col("__term")[f"w{i}"] for i in range(TERM)]
    letters = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(p), F.lit(0)) for p in parts])
    hashes = [F.xxhash64(F.lit(seed), *parts).alias(f"__h{seed}") for seed in SEEDS]
    part = F.floor(F.coalesce("__pos", F.lit(0)) / PART).cast("int").alias("__part")
    terms = named.select(*keys, part, F.least(letters, F.lit(HEAVIEST)).cast("long").alias("__weight"), *hashes)
    packed = [_votes(F.col(f"__h{s}"), k, F.col("__weight")).alias(f"__s{s}_{k}") for s in SEEDS for k in range(16)]
    partial = terms.groupBy(*keys, "__part").agg(F.sum("__weight").alias("__weight"), *packed)
    wide = []
    for s in SEEDS:
        for k in range(16):
            lanes = F.col(f"__s{s}_{k}")
            wide.append(F.sum(lanes.bitwiseAND(F.lit(WIDE))).alias(f"__e{s}_{k}"))
            wide.append(F.sum(F.shiftrightunsigned(lanes, 16).bitwiseAND(F.lit(WIDE))).alias(f"__o{s}_{k}"))
    total = partial.groupBy(*keys).agg(F.sum("__weight").alias("__weight"), *wide)
    return total.select(*keys, F.array(*[_majority(s) for s in SEEDS]).alias(name))


def _majority(seed: int) -> Column:
    def bit(k: int, lane: int) -> Column:
        source = F.col(f"__{'eo'[lane % 2]}{seed}_{k}")
        votes = F.shiftrightunsigned(source, 32 * (lane // 2)).bitwiseAND(F.lit(0xFFFFFFFF))
        place = 16 * lane + k
        return F.when(votes * 2 > F.col("__weight"), F.lit((1 << place) - (1 << 64 if place == 63 else 0))).otherwise(F.lit(0)).cast("long")

    bits = [bit(k, lane) for k in range(16) for lane in range(4)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return bits[0]


def as_text(fp: Column) -> Column:
    """32 lowercase hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.get(fp, F.lit(i))), 16, "0") for i in range(len(SEEDS))]))


def distance(a: Column, b: Column) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(len(SEEDS))])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = 8, hot: int = HOT_KEY) -> DataFrame:
    """(query, found, distance): every fingerprint of ``prints`` within ``radius`` of one of ``queries``, both distinct in ``fp``.

    The bits form ``blocks`` blocks, a divisor of 128 above ``radius``. Two fingerprints within the radius agree on
    some choice of blocks - radius blocks; there is one permuted table per choice, keyed by these blocks' bits. What
    agrees on a key is verified, and a pair counts only in the first table in which it agrees. Keys of more than ``hot``
    fingerprints are dealt over several parts. Either side may be empty.
    """
    if not 0 <= radius < blocks or BITS % blocks or blocks < len(SEEDS):
        raise ValueError("blocks must divide 128 and exceed the radius")
    width, per_long = BITS // blocks, blocks // len(SEEDS)
    choices = list(combinations(range(blocks), blocks - radius))

    def block(fp: Column, i: int) -> Column:
        low = F.shiftrightunsigned(F.get(fp, F.lit(i // per_long)), width * (i % per_long))
        return low if width == 64 else low.bitwiseAND(F.lit((1 << width) - 1))

    def keyed(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(t).alias("permuted"), F.array(*[block(F.col("fp"), i) for i in c]).alias("key")) for t, c in enumerate(choices)]
        return df.select(F.col("fp").alias(name), F.inline(F.array(*keys)))

    filed, asked = keyed(prints, "found"), keyed(queries, "query")
    # a key of very many fingerprints is dealt over parts, each of which sees all that ask for it
    crowded = filed.groupBy("permuted", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    parts = crowded.select("permuted", "key", F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    dealt = lambda df: df.join(parts, ["permuted", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    filed = dealt(filed).withColumn("part", F.pmod(F.xxhash64("found"), F.col("parts")).cast("int"))
    asked = dealt(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = filed.join(asked, ["permuted", "key", "part"])
    agree = [block(F.col("query"), i) == block(F.col("found"), i) for i in range(blocks)]
    first = F.coalesce(*[F.when(reduce(lambda a, b: a & b, [agree[i] for i in c]), F.lit(t)) for t, c in enumerate(choices)])
    found = met.where((distance(F.col("query"), F.col("found")) <= radius) & (first == F.col("permuted")))
    return found.select("query", "found", distance(F.col("query"), F.col("found")).alias("distance"))


def with_near(found: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, every: int = EVERY) -> DataFrame:
    """All columns of ``found`` (doc_id, fingerprint as text) and n_near: how many other rows lie within ``radius`` bits.

    Asked by the rows whose doc_id is divisible by ``every``, against all rows; null for the others. Equal fingerprints
    are one entry of the tables, with their number.
    """
    halves = [F.conv(F.substring("fingerprint", 16 * i + 1, 16), 16, -10).cast("bigint") for i in range(len(SEEDS))]
    asks = F.coalesce(F.pmod("doc_id", F.lit(every)) == 0, F.lit(False))
    rows = cut(found, "prints")
    prints = cut(rows.select(F.array(*halves).alias("fp"), asks.alias("asks")).groupBy("fp").agg(F.count("*").alias("n"), F.bool_or("asks").alias("asks")), "distinct")
    pairs = near(prints.select("fp"), prints.where("asks").select("fp"), radius, blocks)
    counts = pairs.join(prints.select(F.col("fp").alias("found"), "n"), "found").groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    counts = counts.select(as_text(F.col("query")).alias("fingerprint"), "n_near")
    return rows.join(counts, "fingerprint", "left").select(*found.columns, F.when(asks, F.col("n_near")).alias("n_near"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs`` (doc_id, text) and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next
    document's: the next lower doc_id, after the last the first. Equal ids go by text, a null id comes last, a null
    text is empty. near_edited and near_next are the likeness to the edited text's and the next document's fingerprint.

    Texts move once: to ranges of doc_id, in which a window sees the next row. The first row of every range, one
    for each shuffle task, is handed to the range before it.
    """
    spark = docs.sparkSession
    given = only(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    ranges = max(2, shuffle_width(spark))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = only(docs, "doc_id").agg(F.array_distinct(F.percentile_approx("doc_id", shares, 10 * ranges))).first()[0] or []
    place = F.coalesce(count_below(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), len(cuts), F.col("doc_id")), F.lit(-1))
    placed = given.withColumn("range", place)

    # the first row of each range and the range before it (the next lower one; after the lowest the highest)
    tops = only(docs, "doc_id").withColumn("range", place).groupBy("range").agg(F.max("doc_id").alias("doc_id"))
    tops = cut(tops, "tops")
    around = Window.orderBy(F.desc("range"))
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    handed = tops.select("doc_id", F.col("range").alias("top"), F.coalesce(F.lag("range").over(around), F.last("range").over(whole)).alias("to"))
    same = F.col("g.doc_id").eqNullSafe(F.col("h.doc_id"))
    first = given.alias("g").join(F.broadcast(handed.alias("h")), same).groupBy("to").agg(F.min("g.text").alias("handed"))
    first = cut(first.withColumnRenamed("to", "range"), "firsts")

    order = Window.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = placed.select("*", F.row_number().over(order).alias("row"), F.lead("text").over(order).alias("after"))
    joined = rows.join(first, "range")
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    following = F.coalesce("after", "handed")
    edited = F.concat(F.substring("text", 1, n - half), F.substring(following, F.lit(1), half))
    made = joined.select("range", "row", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), F.when(F.col("after").isNull(), F.col("handed")).alias("handed"))
    kinds = F.array(*[F.struct(F.lit(i).alias("kind"), F.col(c).alias("one")) for i, c in enumerate(("text", "edited", "handed"))])
    spread = made.select("range", "row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.inline(F.filter(kinds, lambda x: x["one"].isNotNull())))
    keys = ["range", "row", "doc_id", "n_chars", "edited_sha256"]
    prints = simhash(spread, [*keys, "kind"], "one")
    halves = [[F.max(F.when(F.col("kind") == k, F.get("fp", F.lit(i)))).alias(f"p{k}_{i}") for i in range(len(SEEDS))] for k in range(3)]
    side = prints.groupBy(*keys).agg(*[c for h in halves for c in h])
    fp, changed, given_on = (F.array(*[F.col(f"p{k}_{i}") for i in range(len(SEEDS))]) for k in range(3))
    side = side.select(*keys, fp.alias("fp"), changed.alias("changed"), F.when(F.col("p2_0").isNotNull(), given_on).alias("handed"))
    after = F.coalesce(F.lead("fp").over(Window.partitionBy("range").orderBy("row")), "handed")
    return side.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("changed")).alias("near_edited"), likeness(F.col("fp"), after).alias("near_next"),
    )
