"""Running totals, positions and neighbours over an ordered column without a single-task window.

A window with no (or a hot) partition key sorts everything in one task. Here the input is evaluated once, into the
shared folder. Parts (groups of the partition key) that fit a task are left to a plain window. Only parts that hold more
than twice a task's even share, of which there can be no more than half as many as tasks, are cut into ranges of the
order column; running values are computed inside each range, and the totals of earlier ranges (about one row for each
task) are added. The range of a row is a plain function of its value and of fixed cuts, so a lost executor recomputes
exactly the same ranges. The cuts are approximate quantiles: they only balance the work and never influence a result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BUCKET = "__bucket"


def count_below(cuts: Column, size: int, value: Column, strict: bool = False) -> Column:
    """How many entries of the ascending array ``cuts`` are ``<= value`` (``< value`` if strict).

    A binary search written as a fold over powers of two: about log2(size) comparisons per row.
    ``size`` is an upper bound of the array length; ``get`` past the end is NULL and never counts.
    """
    steps = [1 << b for b in range(max(1, size).bit_length() - 1, -1, -1)]
    folds = F.array(*[F.lit(s) for s in steps])

    def advance(found: Column, step: Column) -> Column:
        probe = F.get(cuts, found + step - F.lit(1))
        fits = probe < value if strict else probe <= value
        return F.when(fits, found + step).otherwise(found)

    return F.aggregate(folds, F.lit(0), advance)


def count_below_fixed(cuts: Sequence[float], value: Column) -> Column:
    """How many of the ascending numbers ``cuts`` are ``<= value``; 0 for NULL.

    The caller's short list as a tree of comparisons: generated code, where a fold over an array is interpreted.
    """
    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.lit(cuts[middle]) <= value, among(middle + 1, high)).otherwise(among(low, middle))

    return among(0, len(cuts))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _place(df: DataFrame, order: str, part: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with ``__bucket``, non-decreasing in ``order`` within each part, and the parts that have several buckets.

    ``df`` must be a table that can be reread. A part is cut into as many ranges as it fills tasks.
    """
    tasks = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = df.count()
    even = max(1.0, total / tasks)
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    large = sizes.filter(F.col("__n") > 2 * even).collect()
    if not large:
        return df.select("*", F.lit(0).alias(BUCKET)), None
    ranges = max(2, -(-max(r["__n"] for r in large) * tasks // total))
    quantiles = F.percentile_approx(order, [i / ranges for i in range(1, ranges)], 10 * ranges).alias("__cuts")
    place = lambda cuts: F.coalesce(count_below(cuts, ranges - 1, F.col(order), strict=True), F.lit(0)).alias(BUCKET)
    if not part:
        found = df.agg(quantiles)
        edges = F.array(*[F.lit(v) for v in found.first()[0] or []]).cast(found.schema["__cuts"].dataType)
        return df.select("*", place(F.array_distinct(edges))), df.limit(0).select()
    # no more than tasks / 2 rows, and about as many cuts as tasks in all
    hot = df.sparkSession.createDataFrame([tuple(r) for r in large], sizes.schema)
    each = df.join(F.broadcast(hot), _same(df, hot, part), "left_semi").groupBy(*part).agg(quantiles)
    own = F.least(F.lit(ranges), F.ceil(F.col("__n") / even).cast("int"))
    some = F.transform(F.sequence(F.lit(1), own - 1), lambda j: F.get("__cuts", F.floor(j * ranges / own).cast("int") - 1))
    cuts = cut(each.join(F.broadcast(hot), _same(each, hot, part)).select(*[each[k] for k in part], F.array_distinct(some).alias("__cuts")), "cuts")
    placed = df.join(F.broadcast(cuts), _same(df, cuts, part), "left")
    return placed.select(*[df[c] for c in df.columns], place(F.col("__cuts"))), cuts.select(*part)


def _order(columns: Sequence[str], descending: bool) -> list[Column]:
    return [F.col(c).desc() if descending else F.col(c).asc() for c in columns]


def running(
    df: DataFrame,
    order: str | Sequence[str],
    aggs: Mapping[str, tuple[str, Column]],
    part: Sequence[str] = (),
    descending: bool = False,
) -> DataFrame:
    """Inclusive running aggregates in ``order``.

    ``aggs`` maps a name to ("sum" | "min" | "max", column), or to ("prev", column) for the column's
    value in the preceding row (the column must not be NULL). Each sum also gives its grand total per
    part as ``all_<name>``. The order must be unique within a part (group by it first, or end it with a row id). Its first
    column must be numeric; NULLs come first ascending and last descending.
    """
    columns = [order] if isinstance(order, str) else list(order)
    given = df.columns
    # each aggregate's input becomes a column, so that it is evaluated once, with the rest of the input
    df = cut(df.select("*", *[c.alias(f"__of_{n}") for n, (_, c) in aggs.items()]), "ordered")
    placed, hot = _place(df, columns[0], part)
    keys = [*part, BUCKET]
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    inside = Window.partitionBy(*keys).orderBy(*_order(columns, descending))
    local = inside.rowsBetween(Window.unboundedPreceding, 0)
    here = []
    for name, (f, _) in aggs.items():
        value = F.col(f"__of_{name}")
        here.append((F.lag(value).over(inside) if f == "prev" else fold[f](value).over(local)).alias(f"__in_{name}"))
        if f == "sum":
            here.append(F.sum(value).over(Window.partitionBy(*keys)).alias(f"__sum_{name}"))
    rows = placed.select(*given, BUCKET, *here)
    sums = [n for n, (f, _) in aggs.items() if f == "sum"]
    if hot is None:
        inner = lambda n, f: F.coalesce(F.col(f"__in_{n}"), F.lit(0)) if f == "sum" else F.col(f"__in_{n}")
        return rows.select(*given, *[inner(n, f).alias(n) for n, (f, _) in aggs.items()], *[F.col(f"__sum_{n}").alias(f"all_{n}") for n in sums])
    final_of = F.min_by if descending else F.max_by
    whole = [(final_of(f"__of_{n}", F.struct(*columns)) if f == "prev" else fold[f](f"__of_{n}")).alias(f"__all_{n}") for n, (f, _) in aggs.items()]
    several = placed.join(F.broadcast(hot), _same(placed, hot, part), "left_semi") if part else placed
    totals = several.groupBy(*keys).agg(*whole)
    across = Window.partitionBy(*part).orderBy(*_order([BUCKET], descending))
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    before = []
    for name, (f, _) in aggs.items():
        value = F.col(f"__all_{name}")
        before.append((F.last(value, ignorenulls=True) if f == "prev" else fold[f](value)).over(earlier).alias(f"__pre_{name}"))
        if f == "sum":
            before.append(F.sum(value).over(Window.partitionBy(*part)).alias(f"__grand_{name}"))
    # about one row for each task
    offsets = cut(totals.select(*keys, *before), "offsets")
    joined = rows.join(F.broadcast(offsets), _same(rows, offsets, keys), "left").select(*[rows[c] for c in rows.columns], *[c for c in offsets.columns if c not in keys])
    final = []
    for name, (f, _) in aggs.items():
        inner, passed = F.col(f"__in_{name}"), F.col(f"__pre_{name}")
        if f == "prev":
            value = F.coalesce(inner, passed)
        elif f == "sum":
            value = F.coalesce(inner, F.lit(0)) + F.coalesce(passed, F.lit(0))
        else:
            value = F.least(inner, passed) if f == "min" else F.greatest(inner, passed)
        final.append(value.alias(name))
    grand = [F.coalesce(f"__grand_{n}", f"__sum_{n}").alias(f"all_{n}") for n in sums]
    return joined.select(*given, *final, *grand)


def row_index(df: DataFrame, order: str | Sequence[str], part: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """Zero-based position of every row in ``order`` (unique) within ``part``."""
    indexed = running(df, order, {"__one": ("sum", F.lit(1).cast("long"))}, part)
    return indexed.select(*df.columns, (F.col("__one") - 1).alias(name))


def previous(
    df: DataFrame, order: str | Sequence[str], columns: Sequence[str], part: Sequence[str] = (), name: str = "prev"
) -> DataFrame:
    """Add a struct ``name`` holding ``columns`` of the preceding row, NULL for the first row of a part."""
    return running(df, order, {name: ("prev", F.struct(*columns))}, part)


def value_counts(df: DataFrame, column: str, part: Sequence[str] = (), **extra: Column) -> DataFrame:
    """Rows per distinct value: the map-side combine that removes hot values before any ordering."""
    aggs = [F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in extra.items()]]
    return df.groupBy(*part, column).agg(*aggs)


def order_statistics(counts: DataFrame, column: str, ranks: Column, part: Sequence[str] = ()) -> DataFrame:
    """Exact values at one-based ``ranks``, an array column that may read the size ``all_upto``.

    ``counts`` is a ``value_counts`` frame. Result: part columns, ``rank``, ``value``, ``size``.
    """
    cumulative = running(counts.select(*part, column, "n"), column, {"upto": ("sum", F.col("n"))}, part)
    first = F.col("upto") - F.col("n")
    hits = F.filter(ranks, lambda r: (r > first) & (r <= F.col("upto")))
    return cumulative.select(*part, F.explode(hits).alias("rank"), F.col(column).alias("value"), F.col("all_upto").alias("size"))
