"""Near-duplicate detection on 64-bit hashes and the leakage it implies across splits.

Two hashes within k bits agree exactly on at least m - k of m bands. Every hash is keyed by each choice
of m - k bands, so an equi-join on those keys finds every pair; nothing is approximated. Identical
hashes are collapsed first. A key that very many distinct hashes share is split again by the same rule,
applied to the bits in which its hashes differ, until it is small or splitting no longer pays; what is
still crowded then is compared in blocks, one group per pair of blocks. A pair is emitted only under its
first agreeing choice of bands on every level.

Spark sizes an exploded side by the file it was read from, as if a hash had one key; joins of keyed rows
therefore ask for a merge join, or the driver would collect and broadcast every key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import HASH_BITS
from ..session import cut
from .inference import with_difference

AGREE = 3
HOT_KEY = 2000
PROBE = 16
EVAL_SPLITS = ("val", "production", "test")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bands(bits: list[int], count: int) -> list[int]:
    """Split bit positions into ``count`` runs of nearly equal length, as masks."""
    edges = [len(bits) * i // count for i in range(count + 1)]
    return [sum(1 << b for b in bits[edges[i] : edges[i + 1]]) for i in range(count)]


def _choices(bands: list[int], agree: int) -> list[int]:
    return [sum(choice) for choice in combinations(bands, agree)]


def _first_choice(differ: Column, bands: Column, agree: int) -> Column:
    """The mask of the first ``agree`` bands on which a pair agrees."""
    agreeing = F.filter(bands, lambda band: differ.bitwiseAND(band) == 0)
    return F.aggregate(F.slice(agreeing, 1, agree), F.lit(0).cast("bigint"), lambda acc, band: acc.bitwiseOR(band))


def _longs(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(f"{_signed(v)}L" for v in values) + ")")


@dataclass(frozen=True)
class _Meeting:
    """Rows that meet on equal ``keys``; ``levels`` are the bands of each level, ``blocked`` adds places i and j."""

    rows: DataFrame
    keys: list[str]
    levels: list[Column]
    blocked: bool = False

    def _sides(self, both_ways: bool) -> tuple[DataFrame, DataFrame, list[str]]:
        if not self.blocked:
            return self.rows, self.rows, self.keys
        block = F.pmod(F.xxhash64("hash"), F.col("blocks")).cast("int")
        rows, last = self.rows.withColumn("block", block), F.col("blocks") - 1
        first = F.lit(0) if both_ways else F.col("block")
        left = rows.withColumn("j", F.explode(F.sequence(first, last))).withColumnRenamed("block", "i")
        right = rows.withColumn("i", F.explode(F.sequence(F.lit(0), last if both_ways else F.col("block")))).withColumnRenamed("block", "j")
        return left, right, [*self.keys, "i", "j"]

    def pairs(self, k: int) -> DataFrame:
        """Each near pair that belongs here: hash_a < hash_b, distance."""
        left, right, keys = self._sides(both_ways=False)
        a, b = left.alias("a"), right.alias("b")
        differ = F.col("a.hash").bitwiseXOR(F.col("b.hash"))
        once = F.col("a.hash") < F.col("b.hash")
        if self.blocked:
            once = once | (F.col("a.i") < F.col("a.j"))
        condition = once & (F.bit_count(differ) <= k)
        for key in keys:
            condition = (F.col(f"a.{key}") == F.col(f"b.{key}")) & condition
        masks = [c for c in keys if c.startswith("mask")]
        found = a.join(b.hint("merge"), condition).select("a.*", F.col("b.hash").alias("other"))
        apart = F.col("hash").bitwiseXOR(F.col("other"))
        for mask, bands in zip(masks, self.levels, strict=True):
            found = found.filter(F.col(mask) == _first_choice(apart, bands, AGREE))
        return found.select(
            F.least("hash", "other").alias("hash_a"), F.greatest("hash", "other").alias("hash_b"), F.bit_count(apart).cast("long").alias("distance")
        )

    def met(self, k: int, gone: DataFrame) -> DataFrame:
        """The asking hashes (``asks``) not in ``gone`` that lie near a filed one here; a semi join, which lists no pairs."""
        left, right, keys = self._sides(both_ways=True)
        a, b = left.filter("asks").join(gone, "hash", "left_anti").alias("a"), right.filter("filed").alias("b")
        condition = F.bit_count(F.col("a.hash").bitwiseXOR(F.col("b.hash"))) <= k
        for key in keys:
            condition = (F.col(f"a.{key}") == F.col(f"b.{key}")) & condition
        return a.join(b.hint("merge"), condition, "left_semi").select("hash")


def _bands_of(bits: Column, count: int) -> Column:
    """``_bands`` of the set bits of a mask, as an expression."""
    places = F.filter(F.sequence(F.lit(0), F.lit(HASH_BITS - 1)), lambda i: F.getbit(bits, i) == 1)
    edge = lambda j: F.floor(F.size(places) * j / count).cast("int")
    of = lambda j: F.slice(places, edge(j) + 1, edge(j + 1) - edge(j))
    mask = lambda some: F.aggregate(some, F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda j: mask(of(j)))


def _masks(bands: Column, count: int) -> Column:
    """Every choice of ``AGREE`` of ``count`` bands, as masks."""
    picks = F.expr("array(" + ",".join(f"array({','.join(map(str, pick))})" for pick in combinations(range(count), AGREE)) + ")")
    return F.transform(picks, lambda pick: F.aggregate(pick, F.lit(0).cast("bigint"), lambda acc, i: acc.bitwiseOR(F.get(bands, i))))


def _worth_splitting(k: int) -> float:
    """The least number of bits by which splitting beats comparing all: one choice fixes a share AGREE / (k + AGREE) of them."""
    return (k + AGREE) / AGREE * log2(2 * comb(k + AGREE, AGREE))


def _meetings(hashes: DataFrame, k: int, hot: int, probe: int) -> Iterator[_Meeting]:
    """Groups of rows in which every near pair meets; ``hashes`` holds one row per hash, and asks and filed for ``met``.

    Every level of crowded keys is written. A crowded key is dropped if its hashes also agree on bands that
    come before its own choice, because all of its pairs meet there, or if nothing in it asks or nothing is filed.
    """
    if not 0 <= k <= HASH_BITS:
        raise ValueError(f"k must be in 0..{HASH_BITS}")
    count, least = k + AGREE, _worth_splitting(k)
    if least > HASH_BITS:
        total = hashes.count()
        yield _Meeting(hashes.withColumn("blocks", F.lit(-(-total // hot) or 1)), [], [], blocked=True)
        return
    rows, keys, levels = hashes, [], []
    bands, masks = _longs(_bands(list(range(HASH_BITS)), count)), _longs(_choices(_bands(list(range(HASH_BITS)), count), AGREE))
    while True:
        level = len(levels)
        mask, key = f"mask{level}", f"key{level}"
        keyed = rows.withColumn(mask, F.explode(masks)).withColumn(key, F.col("hash").bitwiseAND(F.col(mask)))
        keys, levels = [*keys, mask, key], [*levels, bands]
        seen = keyed.filter(F.pmod(F.xxhash64("hash"), F.lit(probe)) == 0)
        crowded = cut(seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") * probe > hot).drop("seen"), "crowded")
        if crowded.isEmpty():
            yield _Meeting(keyed, keys, levels)
            return
        yield _Meeting(keyed.join(crowded, keys, "left_anti"), keys, levels)
        busy = keyed.join(crowded, keys, "left_semi")
        varying = F.bit_or("hash").bitwiseXOR(F.bit_and("hash")).alias("varying")
        same_bands = [F.first(b).alias(b) for b in rows.columns if b.startswith("bands")]
        shape = busy.groupBy(*keys).agg(varying, F.count(F.lit(1)).alias("n"), F.bool_or("asks").alias("a"), F.bool_or("filed").alias("f"), *same_bands)
        shape = shape.filter((F.col("n") > 1) & F.col("a") & F.col("f") & (F.col(mask) == _first_choice(F.col("varying"), bands, AGREE)))
        finer = F.when(F.bit_count("varying") >= least, _bands_of(F.col("varying"), count))
        shape = shape.select(*keys, finer.alias(f"bands{level + 1}"), F.ceil(F.col("n") / hot).cast("int").alias("blocks"))
        busy = cut(busy.join(shape, keys), "busy")
        dense = F.col(f"bands{level + 1}").isNull()
        yield _Meeting(busy.filter(dense), keys, levels, blocked=True)
        rows = busy.filter(~dense).drop("blocks")
        if rows.isEmpty():
            return
        bands = F.col(f"bands{level + 1}")
        masks = _masks(bands, count)


def _product(a: Column, b: Column) -> Column:
    """Pair counts as DECIMAL: billions of copies of one picture overflow a BIGINT."""
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def _own_pairs(n: Column) -> Column:
    """n (n - 1) / 2 without halving a product."""
    return _product(F.floor(n / 2).cast("long"), n - 1 + n % 2)


def hash_neighbors(distinct: DataFrame, k: int = 6, hot: int = HOT_KEY, probe: int = PROBE) -> DataFrame:
    """All pairs of different hashes within ``k`` bits: hash_a < hash_b, distance.

    ``distinct`` has one row per hash. Keys that more than ``hot`` hashes share (judged on every
    ``probe``-th hash; misjudging changes cost, not results) are split further. The first levels run
    when this is called.
    """
    hashes = cut(distinct.select("hash", F.lit(True).alias("asks"), F.lit(True).alias("filed")), "hashes")
    found = None
    for meeting in _meetings(hashes, k, hot, probe):
        some = meeting.pairs(k)
        found = some if found is None else found.unionByName(some)
    return found


def near_hashes(asking: DataFrame, filed: DataFrame, k: int = 6, hot: int = HOT_KEY, probe: int = PROBE) -> DataFrame:
    """The distinct hashes of ``asking`` that lie within ``k`` bits of one of ``filed``: hash. Null hashes match nothing.

    Only existence is asked, so no pair is listed: a cascade of semi joins. Equal hashes leave first, those
    found under a level's small keys before what is crowded is compared.
    """
    sides = asking.select("hash", F.lit(True).alias("asks"), F.lit(False).alias("filed"))
    sides = sides.unionByName(filed.select("hash", F.lit(False).alias("asks"), F.lit(True).alias("filed")))
    hashes = sides.filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.bool_or("asks").alias("asks"), F.bool_or("filed").alias("filed"))
    hashes = cut(hashes, "hashes")
    found = hashes.filter("asks AND filed").select("hash")
    for meeting in _meetings(hashes, k, hot, probe):
        found = cut(found.unionByName(meeting.met(k, found).distinct()), "near")
    return found


def hamming_neighbors(hashes: DataFrame, k: int = 6, hot: int = HOT_KEY, probe: int = PROBE) -> DataFrame:
    """Near pairs at the level of distinct hashes: hash_a <= hash_b, distance, n_a, n_b, pairs.

    A row stands for ``pairs`` undirected id pairs; a hash shared by n ids gives one row with
    n (n - 1) / 2 of them. Ids with no hash match nothing.
    """
    groups = hashes.filter(F.col("hash").isNotNull()).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    near = hash_neighbors(groups.select("hash"), k, hot, probe)
    a = groups.select(F.col("hash").alias("hash_a"), F.col("n").alias("n_a"))
    b = groups.select(F.col("hash").alias("hash_b"), F.col("n").alias("n_b"))
    different = near.join(a, "hash_a").join(b, "hash_b")
    different = different.select("hash_a", "hash_b", "distance", "n_a", "n_b", _product(F.col("n_a"), F.col("n_b")).alias("pairs"))
    n = F.col("n")
    same = groups.filter(n > 1).select(
        F.col("hash").alias("hash_a"),
        F.col("hash").alias("hash_b"),
        F.lit(0).cast("long").alias("distance"),
        n.alias("n_a"),
        n.alias("n_b"),
        _own_pairs(n).alias("pairs"),
    )
    return different.unionByName(same)


def duplicate_groups(hashes: DataFrame) -> DataFrame:
    """Ids sharing hash and split, as one row: first and last id and size."""
    known = hashes.filter(F.col("hash").isNotNull())
    return known.groupBy("hash", "split").agg(F.min("id").alias("id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))


def _is_eval(split: Column) -> Column:
    return split.isin(*EVAL_SPLITS)


def near_dup_pairs(hashes: DataFrame, k: int = 6, hot: int = HOT_KEY, probe: int = PROBE) -> DataFrame:
    """Near pairs with their splits and the cross-split flag, one row per pair of (hash, split) groups.

    ``a`` and ``b`` are the first ids of the two groups and ``pairs`` the number of id pairs the row
    stands for. Where every id has its own hash this is the plain pair list.
    """
    groups = duplicate_groups(hashes)
    own = groups.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    near = hash_neighbors(groups.select("hash").distinct(), k, hot, probe)
    itself = own.select(F.col("hash").alias("hash_a"), F.col("hash").alias("hash_b"), F.lit(0).cast("long").alias("distance"))
    side = lambda s: groups.select(*[F.col(c).alias(f"{c}_{s}") for c in ("hash", "split", "id", "last_id", "n")])
    joined = near.unionByName(itself).join(side("a"), "hash_a").join(side("b"), "hash_b")
    other = F.col("hash_a") != F.col("hash_b")
    inner = ~other & (F.col("split_a") == F.col("split_b"))
    kept = joined.filter(other | (F.col("split_a") < F.col("split_b")) | (inner & (F.col("n_a") > 1)))
    flip = F.col("id_a") > F.col("id_b")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    cross = ((F.col("split_a") == "train") & _is_eval(F.col("split_b"))) | (
        (F.col("split_b") == "train") & _is_eval(F.col("split_a"))
    )
    return kept.select(
        pick("id_a", "id_b").alias("a"),
        F.when(inner, F.col("last_id_b")).otherwise(pick("id_b", "id_a")).alias("b"),
        pick("split_a", "split_b").alias("split_a"),
        pick("split_b", "split_a").alias("split_b"),
        "distance",
        cross.alias("cross"),
        F.when(inner, _own_pairs(F.col("n_a"))).otherwise(_product(F.col("n_a"), F.col("n_b"))).alias("pairs"),
        pick("hash_a", "hash_b").alias("hash_a"),
        pick("hash_b", "hash_a").alias("hash_b"),
    )


def order_pairs(pairs: DataFrame) -> DataFrame:
    """Cross-split pairs first, then by distance; ids break ties."""
    return pairs.orderBy(F.col("cross").desc(), "distance", "a", "b")


def leaked_ids(hashes: DataFrame, k: int = 6, hot: int = HOT_KEY, probe: int = PROBE) -> DataFrame:
    """Every evaluation-side id whose hash lies within ``k`` bits of a training hash; no pair is listed."""
    evaluated = hashes.filter(_is_eval(F.col("split")))
    near = near_hashes(evaluated, hashes.filter(F.col("split") == "train"), k, hot, probe)
    return evaluated.join(near, "hash", "left_semi").select("id").distinct()


def leak_accuracy_gap(preds: DataFrame, leaked: DataFrame) -> DataFrame:
    """Accuracy on leaked and clean evaluation rows, their gap and its 95 % interval. One row."""
    flagged = preds.filter(_is_eval(F.col("split"))).join(leaked.select("id", F.lit(True).alias("leaked")), "id", "left")
    hit, out = F.col("y_true") == F.col("y_pred"), F.coalesce(F.col("leaked"), F.lit(False))
    counts = flagged.agg(
        F.count_if(out & hit).alias("k_leaked"),
        F.count_if(out).alias("n_leaked"),
        F.count_if(~out & hit).alias("k_clean"),
        F.count_if(~out).alias("n_clean"),
    )
    row = with_difference(counts, "k_leaked", "n_leaked", "k_clean", "n_clean").select(
        "n_leaked",
        "n_clean",
        F.col("p1").alias("acc_leaked"),
        F.col("p2").alias("acc_clean"),
        F.col("diff").alias("gap"),
        F.col("diff_low").alias("gap_low"),
        F.col("diff_high").alias("gap_high"),
    )
    return row.select("*", leak_severity().alias("severity"))


def leak_severity() -> Column:
    """Severity from a gap row: any leaked share above 10 %, or a wide gap with enough rows, is critical."""
    share = F.col("n_leaked") / F.greatest(F.col("n_leaked") + F.col("n_clean"), F.lit(1))
    gap = F.col("gap")
    return (
        F.when(F.col("n_leaked") == 0, "none")
        .when((share > 0.10) | ((gap > 0.15) & (F.col("n_leaked") >= 10)), "critical")
        .when((share > 0.03) | (gap > 0.08), "moderate")
        .otherwise("low")
    )
