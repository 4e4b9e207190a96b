"""Strict evaluation ingestion: text cells in, typed rows or issues out."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import decimal_value, extras_map, in_label_pair, is_missing, is_probability, strip_bom, trimmed
from ..session import cut

REQUIRED = ("y_true", "y_pred", "y_probability")
CORRUPT = "_corrupt"


# --- text and CSV shape ------------------------------------------------------------------------

def encoding_flags(text: Column) -> dict[str, Column]:
    """Defects of decoded text: NUL, the replacement character, a leading byte-order mark."""
    return {
        "has_nul": F.contains(text, F.lit("\u0000")),
        "has_replacement": F.contains(text, F.lit("�")),
        "has_bom": F.startswith(text, F.lit("﻿")),
    }


def encoding_check(df: DataFrame, key: str, text: str) -> DataFrame:
    """Flag unreadable text and strip the byte-order mark. Binary input is checked for valid UTF-8 first."""
    raw = df.schema[text].dataType
    valid = F.is_valid_utf8(F.col(text)) if isinstance(raw, T.StringType) else F.try_validate_utf8(F.col(text)).isNotNull()
    body = F.col(text) if isinstance(raw, T.StringType) else F.try_validate_utf8(F.col(text))
    flags = encoding_flags(body)
    marked = df.select(key, valid.alias("valid_utf8"), *[v.alias(k) for k, v in flags.items()], strip_bom(body).alias("text"))
    readable = F.col("valid_utf8") & ~F.coalesce(F.col("has_nul"), F.lit(True)) & ~F.coalesce(F.col("has_replacement"), F.lit(True))
    return marked.select("*", readable.alias("readable"))


def check_header(names: Sequence[str]) -> list[str]:
    """Trimmed names, or an error: they must be nonempty and unique."""
    clean = [n.strip().lstrip("﻿") for n in names]
    if not all(clean) or len(set(clean)) != len(clean):
        raise ValueError("CSV headers must be nonempty and unique")
    return clean


def _split_shape(parsed: DataFrame, names: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    good = parsed.filter(F.col(CORRUPT).isNull())
    blank = F.array_size(F.filter(F.array(*[F.col(f"`{c}`") for c in names]), lambda v: v.isNotNull() & (v != ""))) == 0
    kept = good.filter(~blank) if len(names) == 1 else good
    rows = kept.select(*keep, *[trimmed(F.col(f"`{c}`")).alias(c) for c in names])
    return rows, parsed.filter(F.col(CORRUPT).isNotNull()).select(*keep, F.col(CORRUPT).alias("line"))


def parse_csv_lines(lines: DataFrame, column: str, header: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """CSV records held in a text column: (rows, ragged or malformed records). Blank records drop out."""
    names = check_header(header)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"', "multiLine": "true"}
    full = lines.filter(trimmed(F.col(column)) != "")
    parsed = full.select(*keep, F.from_csv(F.col(column), schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return _split_shape(parsed.select(*keep, "r.*"), names, keep)


def read_strict_csv(spark: SparkSession, path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """A CSV file as text columns: (rows, ragged records). The header is checked on the driver (one line).

    A large file is split over tasks, so a record is a line, and a file with quoted line feeds is refused. With
    ``multi_line`` it is read, each file by one task.

    The parsed records are written once: Spark's reader cannot answer for the corrupt column alone, and
    pruned columns would hide ragged records.
    """
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError("CSV needs a header and at least one data row")
    names = check_header(next(csv.reader(io.StringIO(first[0]))))
    if not multi_line and not spark.read.text(path).filter(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty():
        raise ValueError("quoted line feeds: read with multi_line=True")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    parsed = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(path)
    return _split_shape(cut(parsed, "csv"), names, ())


# --- evaluation rows -------------------------------------------------------------------------------

def cell_issues(positive: str, negative: str) -> Column:
    """Issues of one raw row as (column, code) structs."""
    issue = lambda column, code, bad: F.when(
        bad, F.struct(F.lit(column).alias("column"), F.lit(code).alias("code"))
    )
    found = []
    for column in REQUIRED[:2]:
        gone = is_missing(F.col(column))
        found.append(issue(column, "missing_value", gone))
        found.append(issue(column, "label", ~gone & ~in_label_pair(trimmed(F.col(column)), positive, negative)))
    p = trimmed(F.col("y_probability"))
    gone = is_missing(p)
    found.append(issue("y_probability", "missing_value", gone))
    found.append(issue("y_probability", "probability", ~gone & ~is_probability(decimal_value(p))))
    return F.array_compact(F.array(*found))


def check_labels(positive: str, negative: str) -> None:
    for label in (positive, negative):
        if not label.strip() or label != label.strip() or len(label) > 128:
            raise ValueError("labels must be nonempty, trimmed and at most 128 characters")
    if positive == negative:
        raise ValueError("the two labels must differ")


def check_columns(df: DataFrame) -> None:
    absent = [c for c in REQUIRED if c not in df.columns]
    if absent:
        raise ValueError(f"required columns are missing (names are case-sensitive): {absent}")


# (column, code) -> what to tell the user
MESSAGES = {
    ("y_true", "missing_value"): "y_true is empty; rows without a class label are never dropped silently",
    ("y_pred", "missing_value"): "y_pred is empty; rows without a class label are never dropped silently",
    ("y_true", "label"): "y_true is neither the positive nor the negative label; check spelling and case",
    ("y_pred", "label"): "y_pred is neither the positive nor the negative label; check spelling and case",
    ("y_probability", "missing_value"): "y_probability is empty; give the probability of the positive class",
    ("y_probability", "probability"): "y_probability must be a finite decimal number from 0 to 1, not a percentage or a logit",
}


def issue_message(column: Column, code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for (c, k), text in MESSAGES.items() for x in (f"{c} {k}", text)])
    return F.element_at(table, F.concat_ws(" ", column, code))


def evaluation_issues(raw: DataFrame, row: str, positive: str = "1", negative: str = "0") -> DataFrame:
    """Every bad required cell: row, column, code, message."""
    check_labels(positive, negative)
    check_columns(raw)
    found = raw.select(F.col(row).alias("row"), F.inline(cell_issues(positive, negative)))
    return found.select("*", issue_message(F.col("column"), F.col("code")).alias("message"))


def typed_rows(raw: DataFrame, row: str) -> DataFrame:
    """Evaluation rows of a checked frame; other columns go to ``attributes`` with blanks dropped."""
    extras = extras_map(raw.columns, [row, *REQUIRED])
    attributes = F.map_filter(extras, lambda _, v: ~is_missing(v))
    return raw.select(
        F.col(row).alias("row_id"),
        trimmed(F.col("y_true")).alias("y_true"),
        trimmed(F.col("y_pred")).alias("y_pred"),
        decimal_value(trimmed(F.col("y_probability"))).alias("y_probability"),
        attributes.alias("attributes"),
    )


def ingest(raw: DataFrame, row: str, positive: str = "1", negative: str = "0") -> tuple[DataFrame, DataFrame]:
    """Atomic ingestion: (rows, issues). With any issue the rows are empty; no valid subset is returned."""
    issues = evaluation_issues(raw, row, positive, negative)
    clean = issues.limit(1).agg((F.count(F.lit(1)) == 0).alias("clean")).scalar()
    return typed_rows(raw, row).filter(clean), issues


def ingest_rowwise(raw: DataFrame, row: str, positive: str = "1", negative: str = "0") -> tuple[DataFrame, DataFrame]:
    """Per-row validity, for streams: valid rows pass, the others become issues."""
    issues = evaluation_issues(raw, row, positive, negative)
    return typed_rows(raw.filter(F.size(cell_issues(positive, negative)) == 0), row), issues
