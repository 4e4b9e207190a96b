"""Lenient ingestion of image predictions and matching of image files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import clamp, file_stem, trimmed

# Accepted column names per field, image extensions, and split spellings in order of precedence.
ALIASES = {
    "id": ("image_id", "id", "filename", "image", "file"),
    "y_true": ("y_true", "label", "target", "ground_truth", "actual"),
    "y_pred": ("y_pred", "prediction", "pred", "predicted"),
    "y_probability": ("y_probability", "prob", "probability", "score", "conf", "confidence"),
    "split": ("split", "subset", "dataset_split"),
    "site": ("site", "hospital", "location", "center"),
    "device": ("device", "camera", "scanner", "sensor"),
    "capture_time": ("capture_time", "timestamp", "time", "date"),
    "annotator": ("annotator", "reviewer", "reader"),
}
REQUIRED = ("id", "y_true", "y_pred", "y_probability")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "svg")
SPLITS = (("train", "train"), ("val", "val"), ("prod", "production"), ("test", "test"))
LEADING_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def resolve_columns(columns: list[str]) -> dict[str, str]:
    """Field -> column: the first column, in table order, whose lower-cased name is an alias."""
    found = {}
    for field, names in ALIASES.items():
        match = next((c for c in columns if c.strip().lower() in names), None)
        if match is not None:
            found[field] = match
    absent = [f for f in REQUIRED if f not in found]
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return found


def coerce_label(cell: Column) -> Column:
    """1 for 1 / true / positive, else 0."""
    return F.when(F.lower(trimmed(cell)).isin("1", "true", "positive"), 1).otherwise(0).cast("long")


def lenient_number(cell: Column) -> Column:
    """The leading decimal number of a cell, NULL if there is none."""
    return F.nullif(F.regexp_extract(trimmed(cell), LEADING_NUMBER, 1), F.lit("")).try_cast("double")


def normal_split(cell: Column) -> Column:
    text = F.lower(trimmed(cell))
    named = None
    for part, split in SPLITS:
        named = F.when(text.contains(part), split) if named is None else named.when(text.contains(part), split)
    return named.otherwise("unassigned")


def ingest_predictions(raw: DataFrame, row: str) -> tuple[DataFrame, DataFrame]:
    """(rows, issues). The first row of an id wins; unknown labels become 0 and unreadable scores 0.5.

    Those replacements, and repeated ids, are listed as issues: row, id, code.
    """
    columns = [c for c in raw.columns if c != row]
    at = resolve_columns(columns)
    text = lambda f: trimmed(F.col(f"`{at[f]}`"))
    known = set(at.values())
    extras = [c for c in columns if c not in known]
    meta = F.map_from_arrays(
        F.array(*[F.lit(c.lower()) for c in extras]).cast("array<string>"),
        F.array(*[trimmed(F.col(f"`{c}`")) for c in extras]).cast("array<string>"),
    )
    number = lenient_number(text("y_probability"))
    optional = [(text(f) if f in at else F.lit(None).cast("string")).alias(f) for f in ("site", "device", "capture_time", "annotator")]
    parsed = raw.filter(F.coalesce(text("id"), F.lit("")) != "").select(
        F.col(row).alias("row"),
        text("id").alias("id"),
        coerce_label(text("y_true")).alias("y_true"),
        coerce_label(text("y_pred")).alias("y_pred"),
        clamp(F.coalesce(number, F.lit(0.5)), 0, 1).alias("y_probability"),
        (normal_split(text("split")) if "split" in at else F.lit("unassigned")).alias("split"),
        *optional,
        F.map_filter(meta, lambda _, v: v.isNotNull() & (v != "")).alias("metadata"),
        F.coalesce((number < 0) | (number > 1), F.lit(True)).alias("bad_probability"),
    )
    rank = F.row_number().over(Window.partitionBy("id").orderBy("row"))
    first = parsed.select("*", rank.alias("__rank")).filter(F.col("__rank") == 1)
    rows = first.drop("__rank", "bad_probability")
    firsts = parsed.groupBy("id").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    repeated = parsed.join(firsts, "id").filter(F.col("row") > F.col("first_row"))
    issues = first.filter("bad_probability").select("row", "id", F.lit("probability").alias("code"))
    return rows, issues.unionByName(repeated.select("row", "id", F.lit("duplicate_id").alias("code")))


def ingestion_audit(raw: DataFrame, rows: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: totals, rows per split, issues per kind."""
    n = lambda df, cond=None: (df.filter(cond) if cond is not None else df).agg(F.count(F.lit(1))).scalar()
    splits = ("train", "val", "production", "test", "unassigned")
    counted = rows.agg(F.count(F.lit(1)).alias("valid_rows"), *[F.count_if(F.col("split") == s).alias(s) for s in splits])
    return counted.select(
        n(raw).alias("total_rows"),
        "valid_rows",
        *splits,
        n(issues, F.col("code") == "probability").alias("bad_probabilities"),
        n(issues, F.col("code") == "duplicate_id").alias("duplicate_ids"),
    )


def match_files(rows: DataFrame, files: DataFrame, order: str = "position") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matched, missing ids, unmatched files) by case-insensitive id or file stem.

    ``files`` has ``name`` and an order column; of several files with one stem the last wins.
    """
    extension = F.lower(F.element_at(F.split(F.col("name"), r"\."), -1))
    images = files.filter(extension.isin(*IMAGE_EXTENSIONS))
    by_stem = images.groupBy(F.lower(file_stem(F.col("name"))).alias("stem")).agg(F.max_by("name", order).alias("name"))
    exact = by_stem.select(F.col("stem").alias("key"), F.col("name").alias("by_id"))
    stemmed = by_stem.select(F.col("stem").alias("id_stem"), F.col("name").alias("by_stem"))
    keyed = rows.select("id", F.lower("id").alias("key"), F.lower(file_stem(F.col("id"))).alias("id_stem"))
    joined = keyed.join(exact, "key", "left").join(stemmed, "id_stem", "left")
    named = joined.select("id", F.coalesce("by_id", "by_stem").alias("file"))
    used = keyed.select(F.col("key").alias("stem")).distinct()
    return (
        named.filter(F.col("file").isNotNull()),
        named.filter(F.col("file").isNull()).select("id"),
        by_stem.join(used, "stem", "left_anti").select("name"),
    )
