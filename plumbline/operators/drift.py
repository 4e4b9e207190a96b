"""Distribution differences between a reference and a comparison sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import decimal_value, is_missing, trimmed
from ..session import cut
from . import sketches
from .running import count_below, running

PSEUDOCOUNT = 0.5
LABEL_COLUMNS = ("y_true", "y_pred")


def _plain_number(frames: Sequence[DataFrame], column: str) -> bool:
    """Typed as a number everywhere: no text parsing needed."""
    numeric = (T.DoubleType, T.FloatType, T.LongType, T.IntegerType, T.ShortType, T.ByteType)
    return column not in LABEL_COLUMNS and all(isinstance(f.schema[column].dataType, numeric) for f in frames)


def _values(df: DataFrame, columns: Sequence[str], fast: set[str]) -> DataFrame:
    """One row per present cell: feature, number (NULL for words and labels), cell (NULL on the fast path)."""
    cells = []
    for c in columns:
        if c in fast:
            number = F.col(c).cast("double")
            finite = F.when(F.abs(number) < float("inf"), number)
            cell, there = F.lit(None).cast("string"), finite.isNotNull()
        else:
            cell = trimmed(F.col(c).cast("string"))
            finite = F.lit(None).cast("double") if c in LABEL_COLUMNS else decimal_value(cell)
            there = ~is_missing(cell)
        cells.append(F.struct(F.lit(c).alias("feature"), finite.alias("number"), cell.alias("cell"), there.alias("there")))
    return df.select(F.inline(F.array(*cells))).filter("there").drop("there")


def _pair_rows(datasets: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str]], columns: Sequence[str]) -> DataFrame:
    """Cells of every dataset pair: ref, comp, feature, number, cell, n_ref, n_comp.

    Each dataset is read once; a cell then takes part in as many pairs as its dataset does (a literal
    list, fixed by the caller).
    """
    frames = list(datasets.values())
    fast = {c for c in columns if _plain_number(frames, c)}
    parts = []
    for name, df in datasets.items():
        roles = [(r, c, r == name) for r, c in pairs if name in (r, c)]
        if not roles:
            continue
        role = F.array(*[F.struct(F.lit(r).alias("ref"), F.lit(c).alias("comp"), F.lit(is_ref).alias("is_ref")) for r, c, is_ref in roles])
        parts.append(_values(df, columns, fast).select("*", F.inline(role)))
    return reduce(DataFrame.unionByName, parts)


PAIR = ("ref", "comp", "feature")


def ecdf_distances(ref: DataFrame, comp: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Kolmogorov-Smirnov and Wasserstein-1 per feature, equal values advancing together.

    Both samples collapse to distinct values; one running pass per feature yields both distances.
    Words form a NULL row that sorts first and marks the feature as not numeric.
    """
    rows = _pair_rows({"ref": ref, "comp": comp}, [("ref", "comp")], columns)
    counts = rows.groupBy("feature", "number").agg(
        F.count_if(F.col("is_ref")).alias("a"), F.count_if(~F.col("is_ref")).alias("b")
    )
    number = F.coalesce("number", F.lit(float("-inf")))
    walked = running(
        counts,
        "number",
        {"a_upto": ("sum", F.col("a")), "b_upto": ("sum", F.col("b")), "before": ("prev", number)},
        ("feature",),
    )
    n_a, n_b = F.col("all_a_upto"), F.col("all_b_upto")
    here = F.abs(F.try_divide("a_upto", n_a) - F.try_divide("b_upto", n_b))
    earlier = F.abs(F.try_divide(F.col("a_upto") - F.col("a"), n_a) - F.try_divide(F.col("b_upto") - F.col("b"), n_b))
    # Weighted subtraction: the difference of two huge numbers may overflow where its share does not.
    step = F.col("number") * earlier - F.col("before") * earlier
    stats = walked.groupBy("feature").agg(
        F.max(n_a).alias("n_ref"),
        F.max(n_b).alias("n_comp"),
        F.count_if(F.col("number").isNull()).alias("words"),
        F.max(here).alias("ks"),
        F.sum(F.when(earlier > 0, step)).alias("w1"),
    )
    named = ref.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    joined = named.join(stats, "feature", "left")
    both = F.coalesce((F.col("n_ref") > 0) & (F.col("n_comp") > 0), F.lit(False))
    reason = F.when(~both, "empty sample").when(F.col("words") > 0, "not numeric")
    usable = reason.isNull()
    distance = F.coalesce("w1", F.lit(0.0))
    # greatest() skips NULL, so the overflow test has to come first.
    w1 = F.when(usable & (F.abs(distance) < float("inf")), F.greatest(F.lit(0.0), distance))
    return joined.select(
        "feature",
        F.coalesce("n_ref", F.lit(0)).cast("long").alias("n_ref"),
        F.coalesce("n_comp", F.lit(0)).cast("long").alias("n_comp"),
        F.when(usable, F.col("ks")).alias("ks"),
        w1.alias("w1"),
        reason.alias("reason"),
    )


def _sketched(ref: DataFrame, comp: DataFrame, columns: Sequence[str], value: str, name: str) -> DataFrame:
    """A distance from sketches of both samples, for columns of numbers; within the bounds that ``sketches`` states."""
    found = sketches.distances(*[sketches.number_sketches(df, columns) for df in (ref, comp)])
    named = ref.sparkSession.createDataFrame([(c,) for c in columns], "feature string").join(found, "feature", "left")
    reason = F.when(F.col(value).isNull(), F.lit("empty sample"))
    return named.select("feature", F.col(value).alias(name), *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_ref", "n_comp")], reason.alias("reason"))


def ks_stat(ref: DataFrame, comp: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """feature, d, n_ref, n_comp and reason; ``approx`` reads mergeable sketches instead of all different values."""
    if approx:
        return _sketched(ref, comp, columns, "ks", "d")
    return ecdf_distances(ref, comp, columns).select("feature", F.col("ks").alias("d"), "n_ref", "n_comp", "reason")


def wasserstein1(ref: DataFrame, comp: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """feature, w, n_ref, n_comp and reason; ``approx`` as in ``ks_stat``."""
    if approx:
        return _sketched(ref, comp, columns, "w1", "w")
    rows = ecdf_distances(ref, comp, columns)
    reason = F.when(F.col("reason").isNull() & F.col("w1").isNull(), "not finite").otherwise(F.col("reason"))
    return rows.select("feature", F.col("w1").alias("w"), "n_ref", "n_comp", reason.alias("reason"))


def _counted(datasets: Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Rows per distinct cell of every dataset: name, feature, number, cell, n. Written once; each dataset is read once."""
    fast = {c for c in columns if _plain_number(list(datasets.values()), c)}
    parts = [_values(df, columns, fast).select(F.lit(name).alias("name"), "feature", "number", "cell") for name, df in datasets.items()]
    return cut(reduce(DataFrame.unionByName, parts).groupBy("name", "feature", "number", "cell").agg(F.count(F.lit(1)).alias("n")), "cells")


def _plan(counts: DataFrame, pairs: Sequence[tuple[str, str]], columns: Sequence[str], bins: int) -> DataFrame:
    """One row per pair and feature: kind, reason, sizes and the distinct interior cuts of the reference range.

    An interior boundary belongs to the upper bin. Sizes and ranges come from the counts, so nothing but the caller's
    own lists is in the plan.
    """
    stats = counts.groupBy("name", "feature").agg(
        F.sum("n").alias("n"),
        F.count_if(F.col("number").isNull()).alias("words"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
    )
    listed = counts.sparkSession.createDataFrame(list(pairs), "ref string, comp string")
    named = listed.select("ref", "comp", F.explode(F.array(*[F.lit(c) for c in columns])).alias("feature"))
    of_ref = stats.select(F.col("name").alias("ref"), "feature", F.col("n").alias("n_ref"), F.col("words").alias("words_ref"), "low", "high")
    of_comp = stats.select(F.col("name").alias("comp"), "feature", F.col("n").alias("n_comp"), F.col("words").alias("words_comp"))
    sized = named.join(of_ref, ["ref", "feature"], "left").join(of_comp, ["comp", "feature"], "left")
    both = F.col("n_ref").isNotNull() & F.col("n_comp").isNotNull()
    kind = F.when(both, F.when(F.col("words_ref") + F.col("words_comp") == 0, "numeric").otherwise("categorical"))
    flat = (kind == "numeric") & (F.col("low") == F.col("high"))
    share = lambda i: i / F.lit(float(bins))
    every = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("low") * (1 - share(i)) + F.col("high") * share(i))
    inside = F.array_distinct(F.filter(every, lambda c: (c > F.col("low")) & (c < F.col("high"))))
    reason = F.when(~both, "empty sample").when(flat, "constant reference")
    usable = (kind == "numeric") & ~flat
    return cut(sized.select(*PAIR, kind.alias("kind"), reason.alias("reason"), F.when(usable, inside).alias("cuts"), "n_ref", "n_comp"), "psi-plan")


def _psi_of(ref: Column, comp: Column, n_ref: Column, n_comp: Column, k: Column) -> Column:
    """One bin's term; every bin has half a pseudo-count."""
    p, q = (ref + PSEUDOCOUNT) / (n_ref + k * PSEUDOCOUNT), (comp + PSEUDOCOUNT) / (n_comp + k * PSEUDOCOUNT)
    return (q - p) * F.ln(q / p)


def _numeric_psi(counts: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """PSI of pairs with cuts. Each dataset is binned once, by the cuts of all references together; the bins of a pair
    are sums of those. ``most`` bounds the cuts of a feature.
    """
    live = plan.filter(F.col("cuts").isNotNull()).select(*PAIR, "cuts", "n_ref", "n_comp")
    edges = live.groupBy("feature").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("cuts")))).alias("edges"))
    # one row per feature, with no more cuts than references x bins
    placed = counts.filter(F.col("number").isNotNull()).join(F.broadcast(edges), "feature")
    fine = placed.groupBy("name", "feature", count_below(F.col("edges"), most, F.col("number")).alias("at")).agg(F.sum("n").alias("n"))
    held = fine.groupBy("name", "feature").agg(F.collect_list(F.struct("at", "n")).alias("held"))
    side = lambda role: held.select(F.col("name").alias(role), "feature", F.col("held").alias(f"held_{role}"))
    joined = live.join(edges, "feature").join(side("ref"), ["ref", "feature"]).join(side("comp"), ["comp", "feature"])
    # a cut's place among the edges: values below it lie in the fine bins before that place
    until = F.concat(F.transform("cuts", lambda c: F.array_position("edges", c)), F.array(F.lit(most + 1).cast("long")))
    bounded = joined.select(*PAIR, "n_ref", "n_comp", "held_ref", "held_comp", until.alias("until"))

    def inside(held: str, i: Column) -> Column:
        here = lambda x: (x["at"] < F.get("until", i)) & (x["at"] >= F.coalesce(F.get("until", i - 1), F.lit(0)))
        return F.aggregate(F.filter(held, here), F.lit(0).cast("long"), lambda s, x: s + x["n"])

    k = F.size("until")
    terms = F.transform(
        F.sequence(F.lit(0), k - 1), lambda i: _psi_of(inside("held_ref", i), inside("held_comp", i), F.col("n_ref"), F.col("n_comp"), k)
    )
    return bounded.select(*PAIR, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x).alias("psi"))


def _categorical_psi(counts: DataFrame, plan: DataFrame) -> DataFrame:
    """PSI over the union of both samples' categories."""
    live = plan.filter(F.col("kind") == "categorical").select(*PAIR, "n_ref", "n_comp")
    roles = F.array(*[F.struct(F.col(r).alias("name"), F.lit(r == "ref").alias("is_ref")) for r in ("ref", "comp")])
    shares = _categories(counts).join(live.select(*PAIR, F.inline(roles)), ["name", "feature"])
    side = lambda ref: F.sum(F.when(F.col("is_ref") == ref, F.col("n")).otherwise(0))
    rows = shares.groupBy(*PAIR, "category").agg(side(True).alias("a"), side(False).alias("b"))
    sized = live.join(rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("k")), list(PAIR))
    term = _psi_of(F.col("a"), F.col("b"), F.col("n_ref"), F.col("n_comp"), F.col("k"))
    return rows.join(sized, list(PAIR)).groupBy(*PAIR).agg(F.sum(term).alias("psi"))


def _categories(counts: DataFrame) -> DataFrame:
    category = F.coalesce(F.col("cell"), F.col("number").cast("string")).alias("category")
    return counts.groupBy("name", "feature", category).agg(F.sum("n").alias("n"))


def psi_pairs(
    datasets: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str]], columns: Sequence[str], bins: int = 10
) -> DataFrame:
    """Population stability index of each feature for each (reference, comparison) pair.

    Numeric features: equal-width cuts over the reference range, outer bins open. Others: the union of
    categories. Every bin gets half a pseudo-count. Undefined is NULL with a reason.
    Each dataset is read once, into counts of its distinct cells; ranges, bins and pairs all come from those.
    """
    if not 2 <= bins <= 100:
        raise ValueError("bins must be in 2..100")
    counts = _counted(datasets, columns)
    plan = _plan(counts, pairs, columns, bins)
    most = len({r for r, _ in pairs}) * (bins - 1)
    values = _numeric_psi(counts, plan, most).unionByName(_categorical_psi(counts, plan))
    psi = F.when(F.col("psi").isNotNull(), F.greatest(F.lit(0.0), F.col("psi")))
    return plan.join(values, list(PAIR), "left").select(*PAIR, "kind", psi.alias("psi"), "reason")


def psi(ref: DataFrame, comp: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    return psi_pairs({"ref": ref, "comp": comp}, [("ref", "comp")], columns, bins).drop("ref", "comp")


def psi_config(ref: DataFrame, comp: DataFrame, columns: Sequence[str], bins: int = 10) -> DataFrame:
    """The cut points and categories behind ``psi``: feature, kind, cut, category."""
    counts = _counted({"ref": ref, "comp": comp}, columns)
    plan = _plan(counts, [("ref", "comp")], columns, bins).filter(F.col("reason").isNull())
    cuts = plan.select("feature", "kind", F.explode("cuts").alias("cut"), F.lit(None).cast("string").alias("category"))
    wordy = plan.filter(F.col("kind") == "categorical").select("feature")
    words = _categories(counts).join(wordy, "feature", "left_semi").select("feature", "category").distinct()
    return cuts.unionByName(words.select("feature", F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("cut"), "category"))


def union_categories(rows: DataFrame) -> DataFrame:
    """Distinct categories over both samples."""
    return rows.select("feature", F.coalesce(F.col("cell"), F.col("number").cast("string")).alias("category")).distinct()


def categories_of(ref: DataFrame, comp: DataFrame, column: str) -> DataFrame:
    return union_categories(_pair_rows({"ref": ref, "comp": comp}, [("ref", "comp")], [column])).select("category")


def dataset_pairs(names: DataFrame, order: str = "position", name: str = "dataset") -> DataFrame:
    """Every unordered pair of registered datasets, the earlier one as reference.

    Datasets are numbered in order; each is then joined by number with all before it.
    """
    listed = names.select(F.row_number().over(Window.orderBy(order)).alias("k"), F.col(name).alias("comp"))
    earlier = listed.select("comp", F.explode(F.when(F.col("k") > 1, F.sequence(F.lit(1), F.col("k") - 1))).alias("k"))
    return earlier.join(listed.select("k", F.col("comp").alias("ref")), "k").select("ref", "comp")


def dataset_pair_review(datasets: Mapping[str, DataFrame], columns: Sequence[str], bins: int = 10) -> DataFrame:
    """Largest PSI and accuracy gap of every dataset pair with its status; untested stays NULL."""
    names = list(datasets)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    strongest = psi_pairs(datasets, pairs, columns, bins).groupBy("ref", "comp").agg(F.max("psi").alias("value"))
    rows = strongest.select("ref", "comp", F.lit("max_psi").alias("kind"), "value", _grade(F.col("value"), 0.25, 0.1).alias("status"))
    scored = {n: df for n, df in datasets.items() if {"y_true", "y_pred"} <= set(df.columns)}
    if len(scored) > 1:
        hits = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
        accuracy = {n: df.agg(hits.alias("accuracy")).scalar() for n, df in scored.items()}
        gaps = [(a, b) for a, b in pairs if a in scored and b in scored]
        one = next(iter(datasets.values())).sparkSession.range(1)
        cells = [F.struct(F.lit(a).alias("ref"), F.lit(b).alias("comp"), (accuracy[a] - accuracy[b]).alias("value")) for a, b in gaps]
        gap = one.select(F.inline(F.array(*cells)))
        rows = rows.unionByName(
            gap.select("ref", "comp", F.lit("accuracy_gap").alias("kind"), "value", _grade(F.abs("value"), 0.2, 0.1).alias("status"))
        )
    return rows


def _grade(value: Column, critical: float, warning: float) -> Column:
    return (
        F.when(value.isNull(), "untested").when(value > critical, "critical").when(value > warning, "warning").otherwise("healthy")
    )


def alternative_review(facts: DataFrame) -> DataFrame:
    """Status of four rival causes over one row of measurements; whatever was not measured is not assessed.

    Columns read: positive_prevalence, accuracy, balanced_accuracy, max_psi, train_accuracy,
    eval_accuracy, suspicions.
    """
    prev, acc, ba = F.col("positive_prevalence"), F.col("accuracy"), F.col("balanced_accuracy")
    skewed = (prev <= 0.35) | (prev >= 0.65)
    imbalance = (
        F.when(prev.isNull(), "not_assessed")
        .when(skewed, "supported")
        .when(acc.isNull() | ba.isNull(), "not_assessed")
        .when(acc - ba > 0.2, "supported")
        .otherwise("insufficient_evidence")
    )
    shift = F.when(F.col("max_psi").isNull(), "not_assessed").when(F.col("max_psi") > 0.25, "supported").otherwise("weak_evidence")
    gap = F.col("train_accuracy") - F.col("eval_accuracy")
    overfit = F.when(gap.isNull(), "not_assessed").when(gap > 0.15, "supported").otherwise("inconsistent_with_logs")
    leak = (
        F.when(F.col("suspicions").isNull(), "not_assessed")
        .when(F.col("suspicions") > 0, "insufficient_evidence")
        .otherwise("survives_challenge")
    )
    causes = {"class_imbalance": imbalance, "covariate_shift": shift, "overfitting": overfit, "target_leakage": leak}
    rows = [F.struct(F.lit(k).alias("cause"), v.alias("status")) for k, v in causes.items()]
    return facts.select(F.inline(F.array(*rows)))
