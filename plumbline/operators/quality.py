"""Column profiles, missing cells, repeated rows and class balance.

Cells are counted per (column, value) first. That one map-side combined shuffle serves profiles,
top values and comparisons, avoids one distinct aggregate per column, and leaves no hot value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import decimal_value, is_missing, sentinel_form, trimmed
from .running import row_index

IMBALANCE_SHARE = 0.7
# Name patterns of identifiers and of label columns, and the metadata names.
ID_NAME = r"(?i)(^id$|_id$|uuid)"
LABEL_NAME = r"(?i)^(label|class|target|stroke|survived|churn|fraud|outcome|y_true|default)$"
METADATA_NAMES = ("timestamp", "group", "site", "environment", "device")
# Significant digits of a column's largest number that a mean is taken with.
DIGITS = 15


def cells(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column): trimmed text ``cell``."""
    pairs = [F.struct(F.lit(c).alias("column"), trimmed(F.col(f"`{c}`").cast("string")).alias("cell")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def cell_counts(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct cell: ``column, cell, n`` (missing cells keep their spelling)."""
    columns = columns or [c for c in df.columns if c not in by]
    return cells(df, columns, by).groupBy(*by, "column", "cell").agg(F.count(F.lit(1)).alias("n"))


def profile_counts(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per column: type, missing, observed, distinct and, where every observed cell is a number, min/max/mean."""
    marked = counts.select(
        *by, "column", "n", is_missing(F.col("cell")).alias("gone"), decimal_value(F.col("cell")).alias("number")
    )
    # Sums of doubles depend on the order of rows. Whole multiples of a decimal step, fine enough for 15 digits of the
    # largest number of the column, are added as decimals instead: exactly, so in any order.
    keys = [*by, "column"]
    largest = marked.groupBy(*keys).agg(F.max(F.when(~F.col("gone"), F.abs("number"))).alias("largest"))
    digits = F.when(F.col("largest") > 0, F.ceil(F.log10("largest"))).otherwise(0)
    steps = largest.select(*[F.col(k).alias(f"__{k}") for k in keys], F.pow(F.lit(10.0), F.lit(DIGITS) - digits).alias("steps"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    # one row for each column of the frame (and dataset)
    marked = marked.join(F.broadcast(steps), same)
    there = ~F.col("gone")
    number, n = F.when(there, F.col("number")), F.col("n")
    whole = F.round(number * F.col("steps")).try_cast("decimal(19,0)") * n.cast("decimal(18,0)")
    total = lambda cond: F.coalesce(F.sum(F.when(cond, n)), F.lit(0)).cast("long")
    agg = marked.groupBy(*keys).agg(
        total(F.col("gone")).alias("missing"),
        total(there).alias("observed"),
        F.count_if(there).alias("distinct"),
        F.count_if(there & F.col("number").isNull()).alias("words"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        F.sum(whole).alias("total"),
        F.max("steps").alias("steps"),
    )
    numeric = (F.col("observed") > 0) & (F.col("words") == 0)
    mean = F.try_divide("total", F.col("observed").cast("decimal(19,0)")).cast("double") / F.col("steps")
    mean = F.greatest(F.col("low"), F.least(F.col("high"), mean))
    kind = F.when(F.col("observed") == 0, "empty").when(numeric, "numeric").otherwise("categorical")
    return agg.select(
        *by,
        "column",
        kind.alias("type"),
        "missing",
        "observed",
        "distinct",
        F.when(numeric, F.col("low")).alias("min"),
        F.when(numeric, F.col("high")).alias("max"),
        F.when(numeric, mean).alias("mean"),
    )


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return profile_counts(cell_counts(df, columns))


def top_values(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent cells per column, ties by value."""
    counts = cell_counts(df, columns).filter(~is_missing(F.col("cell")))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("cell"))
    return counts.select("column", F.col("cell").alias("value"), "n", F.row_number().over(order).alias("rank")).filter(
        F.col("rank") <= k
    )


def column_role(column: str, target: str) -> str:
    """Role by name. Scores and predictions keep fixed names; ``feature_`` marks inputs."""
    if column == target or column == "y_true":
        return "target"
    fixed = {"y_pred": "prediction", "y_probability": "probability"}
    if column in fixed:
        return fixed[column]
    if column in METADATA_NAMES:
        return "metadata"
    return "feature" if column.startswith("feature_") else "unknown"


def column_roles(df: DataFrame, target: str = "y_true") -> DataFrame:
    """Role and type of each column; labels and metadata stay categorical even when they look numeric."""
    profile = column_profile(df)
    roles = {c: column_role(c, target) for c in df.columns}
    role = F.create_map(*[x for pair in roles.items() for x in map(F.lit, pair)])[F.col("column")]
    wordy = F.col("column").isin("y_true", "y_pred", target, *METADATA_NAMES)
    kind = F.when(F.col("type") == "empty", "empty").when((F.col("type") == "numeric") & ~wordy, "numeric").otherwise("categorical")
    return profile.select("column", role.alias("role"), kind.alias("type"), "missing", "distinct")


def target_copies(df: DataFrame, target: str) -> DataFrame:
    """Per other column: rows present, and whether it equals the target in every row."""
    others = [c for c in df.columns if c != target]
    goal = trimmed(F.col(f"`{target}`").cast("string"))
    equal = {c: trimmed(F.col(f"`{c}`").cast("string")) for c in others}
    aggs = [F.count_if(~is_missing(cell) & ~is_missing(goal) & (cell == goal)).alias(f"eq{i}") for i, cell in enumerate(equal.values())]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    rows = [F.struct(F.lit(c).alias("column"), (F.col(f"eq{i}") == F.col("rows")).alias("copies")) for i, c in enumerate(others)]
    return wide.select("rows", F.inline(F.array(*rows)))


def column_warnings(df: DataFrame, target: str, task: str = "classification") -> DataFrame:
    """Review signals per column: constant, unique identifier, target copy, dominant class, wordy regression target."""
    counts = cell_counts(df)
    profile = profile_counts(counts)
    largest = counts.filter(~is_missing(F.col("cell"))).groupBy("column").agg(F.max("n").alias("largest"))
    facts = profile.join(largest, "column", "left").join(
        target_copies(df, target).select("column", "copies"), "column", "left"
    )
    is_target = F.col("column") == target
    flag = lambda cond, name: F.when(cond, F.lit(name))
    found = F.array_compact(
        F.array(
            flag(F.col("distinct") == 1, "constant"),
            flag(
                ~is_target & F.col("column").rlike(ID_NAME) & (F.col("distinct") == F.col("observed")) & (F.col("observed") > 1),
                "unique_identifier",
            ),
            flag(~is_target & (F.col("observed") >= 3) & F.col("copies"), "target_copy"),
            flag(
                is_target & F.lit(task == "classification") & (F.col("largest") / F.col("observed") >= IMBALANCE_SHARE),
                "dominant_class",
            ),
            flag(is_target & F.lit(task == "regression") & (F.col("type") != "numeric"), "nonnumeric_target"),
        )
    )
    return facts.select("column", F.explode(found).alias("warning"))


def label_counts(df: DataFrame, target: str) -> DataFrame:
    label = trimmed(F.col(f"`{target}`").cast("string"))
    return df.select(label.alias("label")).filter(~is_missing(F.col("label"))).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def class_prevalence(df: DataFrame, target: str) -> DataFrame:
    """Complete class frequencies of the target."""
    counts = label_counts(df, target)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label", "n", (F.col("n") / total).alias("prevalence"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Shares, the dominant class and the imbalance flag. Empty unless two classes or more are present."""
    counts = label_counts(df, target)
    facts = counts.agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("classes"),
        F.max(F.struct(F.col("n"))).getField("n").alias("top"),
    )
    first = counts.groupBy("n").agg(F.min("label").alias("label")).agg(F.max_by("label", "n")).scalar()
    shares = counts.select(
        "label",
        "n",
        (F.col("n") / facts.select("total").scalar()).alias("share"),
        (F.col("label") == first).alias("is_dominant"),
    )
    return shares.filter(facts.select(F.col("classes") >= 2).scalar()).select(
        "*", (F.col("is_dominant") & (F.col("share") >= IMBALANCE_SHARE)).alias("imbalanced")
    )


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: r.cast("string")), ",")


def missing_breakdown(df: DataFrame, row: str, present: int = 5, absent: int = 10) -> DataFrame:
    """Per column: missing and present cells, spellings used, and the first row numbers of either kind.

    ``row`` is a unique row number. The row lists are cut before any row is collected.
    """
    columns = [c for c in df.columns if c != row]
    forms = [F.struct(F.lit(c).alias("column"), sentinel_form(F.col(f"`{c}`").cast("string")).alias("form")) for c in columns]
    marked = df.select(row, F.inline(F.array(*forms))).withColumn("gone", F.col("form").isNotNull())
    spelled = marked.groupBy("column", "form").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(":", "form", F.col("n").cast("string"))
    table = spelled.groupBy("column").agg(
        F.coalesce(F.sum(F.when(F.col("form").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("missing"),
        F.coalesce(F.sum(F.when(F.col("form").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("present"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("form").isNotNull(), text))), ",").alias("sentinels"),
    )
    order = Window.partitionBy("column", "gone").orderBy(row)
    firsts = (
        marked.select("column", "gone", row, F.row_number().over(order).alias("k"))
        .filter(F.col("k") <= max(present, absent))
        .filter(F.col("k") <= F.when(F.col("gone"), absent).otherwise(present))
        .groupBy("column")
        .agg(
            _joined(F.sort_array(F.collect_list(F.when(F.col("gone"), F.col(row))))).alias("missing_rows"),
            _joined(F.sort_array(F.collect_list(F.when(~F.col("gone"), F.col(row))))).alias("present_rows"),
        )
    )
    rate = F.col("missing") / (F.col("missing") + F.col("present"))
    return table.join(firsts, "column").select("*", rate.alias("missing_rate"))


def repeated_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Total, unique and repeated rows over all columns."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    sums = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.count(F.lit(1)).alias("unique"))
    return sums.select("total", "unique", (F.col("total") - F.col("unique")).alias("repeated"))


def first_occurrence(df: DataFrame, columns: Sequence[str], row: str) -> DataFrame:
    """(row, first_row) for every row that repeats an earlier one.

    Only groups that do repeat are joined back; a dominant duplicate is one row on that side.
    """
    groups = df.groupBy(*columns).agg(F.min(row).alias("first_row"), F.count(F.lit(1)).alias("__n"))
    repeats = groups.filter(F.col("__n") > 1)
    same = [df[c].eqNullSafe(repeats[c]) for c in columns]
    return df.join(repeats, same).filter(F.col(row) > F.col("first_row")).select(row, "first_row")


def dedupe_first(df: DataFrame, key: str, row: str) -> tuple[DataFrame, DataFrame]:
    """First row per key, and the later ones. Spark prunes each partition to one row per key for the kept side."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(row))
    kept = df.select("*", rank.alias("__rank")).filter(F.col("__rank") == 1).drop("__rank")
    firsts = df.groupBy(key).agg(F.min(row).alias("__first"))
    dropped = df.join(firsts, key).filter(F.col(row) > F.col("__first")).drop("__first")
    return kept, dropped


def stride_sample(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows at positions floor(i N / n), i < n; all rows when there are at most n."""
    indexed = row_index(df, order, name="__at")
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    placed = indexed.select("*", total.alias("__total"))
    step = F.expr(f"(__at * {n} + __total - 1) div __total")
    hit = (step < n) & (F.expr(f"(((__at * {n} + __total - 1) div __total) * __total) div {n}") == F.col("__at"))
    return placed.filter((F.col("__total") <= n) | hit).drop("__at", "__total")


def cap_list(rows: DataFrame, cap: int, order: Sequence[Column | str]) -> DataFrame:
    """The first ``cap`` rows of a report list, each carrying the full total."""
    total = rows.agg(F.count(F.lit(1)).alias("total")).scalar()
    return rows.orderBy(*order).limit(cap).select("*", total.alias("total"))
