"""Training logs and JSON metrics: lines to metric rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import scaled_percent, trimmed
from ..operators.running import row_index, running

# Metric names, their prefixes and labels, and the token forms.
PREFIXES = {
    "train": "Training",
    "training": "Training",
    "val": "Validation",
    "validation": "Validation",
    "test": "Test",
    "production": "Production",
    "prod": "Production",
}
METRICS = ("accuracy", "acc", "loss", "mae", "mse", "rmse", "r2", "precision", "recall", "f1", "auc")
METRIC_COLUMNS = (
    "epoch", "train_loss", "val_loss", "train_accuracy", "val_accuracy", "production_accuracy", "train_mae", "val_mae",
    "train_mse", "val_mse", "train_rmse", "val_rmse", "train_r2", "val_r2", "val_precision", "val_recall", "val_f1", "val_auc",
)
BRACKETED = r"(?i)\[(validation|production|train|training|test)\]\s*(accuracy|loss|mae|mse|rmse|r2|precision|recall|f1|auc)"
SEPARATED = r"(?i)\b(train|training|val|validation|test|production)[/.](accuracy|acc|loss|mae|mse|rmse|r2|precision|recall|f1|auc)\b"
BARE = r"(?i)\b(loss|accuracy|acc):"
EPOCH = r"(?i)\bepoch(?:\s*[:=]\s*|\s+)(\d+)(?=\s|/|\]|\z)"
HEADER = r"(?i)^(.*)Epoch\s+(\d+)\s*/\s*\d+\s*\z"
TOKEN = r"(?i)\b([a-z_][a-z_0-9]*)\s*[:=]\s*([+-]?(?:\d*\.)?\d+(?:e[+-]?\d+)?|nan|inf(?:inity)?)\s*(%?)"
RATE = r"(?i)accuracy|share|recall|precision|f1|auc"
LARGEST_EPOCH = 2**53 - 1


def aliases() -> dict[str, str]:
    """Normalised key -> metric label."""
    table = {"majority": "Majority share", "minority_recall": "Minority recall"}
    for prefix, label in PREFIXES.items():
        for metric in METRICS:
            word = "accuracy" if metric == "acc" else metric
            table[f"{prefix}_{metric}"] = f"{label} {word if word in ('accuracy', 'loss') else word.upper()}"
    return table


def normalise(line: Column) -> Column:
    """Tracker, bracket and Keras spellings to ``split_metric``; lines without the sign that a spelling needs skip its pattern."""
    plain = F.when(F.contains(line, F.lit("[")), F.regexp_replace(line, BRACKETED, "$1_$2")).otherwise(line)
    plain = F.regexp_replace(plain, SEPARATED, "$1_$2")
    return F.when(F.contains(line, F.lit(":")), F.regexp_replace(plain, BARE, "train_$1:")).otherwise(plain)


def epoch_of(line: Column) -> Column:
    """The epoch that a line names; lines without the word skip the pattern and the cast of nothing."""
    number = F.regexp_extract(line, EPOCH, 1).try_cast("bigint")
    return F.when(F.contains(F.lower(line), F.lit("epoch")) & (number <= LARGEST_EPOCH), number)


def join_headers(lines: DataFrame) -> DataFrame:
    """Put a Keras header line (``Epoch 3/10``) in front of the next non-blank line of its source.

    Runs over range buckets of each source, so one huge log does not end up in one task.
    """
    full = lines.filter(trimmed(F.col("line")) != "")
    walked = running(
        full, "line_no", {"at": ("sum", F.lit(1).cast("long")), "before": ("prev", F.col("line"))}, ("source",)
    )
    header = F.col("line").rlike(HEADER)
    head = F.concat(
        F.regexp_extract("before", HEADER, 1), F.lit("[epoch "), F.regexp_extract("before", HEADER, 2), F.lit("] ")
    )
    lead = F.when(F.col("before").rlike(HEADER), head).otherwise("")
    return walked.filter(~header | (F.col("at") == F.col("all_at"))).select(
        "source", "line_no", F.concat(lead, F.col("line")).alias("line")
    )


def is_rate(label: Column) -> Column:
    return label.rlike(RATE)


def metric_reason(label: Column, rate: Column, value: Column, percent: Column) -> Column:
    """Why a value cannot be used: NULL for a valid one. ``value`` is already scaled; ``rate`` is ``is_rate`` of the label."""
    r2 = F.endswith(label, F.lit("R2"))
    return (
        F.when(~F.coalesce(F.abs(value) < float("inf"), F.lit(False)), "not finite")
        .when((value < 0) & ~r2, "negative")
        .when(r2 & (value > 1), "above one")
        .when(rate & (value > 1), "rate above one")
        .when(~rate & percent, "percent of an unbounded metric")
    )


def metric_tokens(lines: DataFrame) -> DataFrame:
    """Every recognised metric token: source, line_no, position, epoch, metric, value, reason.

    The parts of all tokens are taken from the line, one pass a part, and whether a label is a rate is looked up: as
    patterns on every token they would be matched again wherever a later expression names them.
    """
    spark = lines.sparkSession
    table = spark.createDataFrame(list(aliases().items()), "key string, metric string").withColumn("rate", is_rate(F.col("metric")))
    clean = lines.select("source", "line_no", epoch_of(F.col("line")).alias("epoch"), normalise(F.col("line")).alias("clean"))
    parts = [F.regexp_extract_all("clean", F.lit(TOKEN), F.lit(i)).alias(name) for i, name in enumerate(("key", "text", "sign"), 1)]
    rows = clean.select("source", "line_no", "epoch", F.posexplode(F.arrays_zip(*parts)).alias("position", "t"))
    keyed = rows.select("source", "line_no", "epoch", "position", F.lower("t.key").alias("key"), F.col("t.text").alias("text"), (F.col("t.sign") == "%").alias("percent"))
    named = keyed.join(F.broadcast(table), "key")
    value = scaled_percent(F.col("text").try_cast("double"), F.col("percent"), F.col("rate"))
    valued = named.select("source", "line_no", F.col("position").cast("long").alias("position"), "epoch", "metric", "rate", "percent", value.alias("value"))
    reason = metric_reason(F.col("metric"), F.col("rate"), F.col("value"), F.col("percent"))
    return valued.select(
        "source", "line_no", "position", "epoch", "metric", F.when(reason.isNull(), F.col("value")).alias("value"), reason.alias("reason")
    )


def extract_metrics(lines: DataFrame) -> DataFrame:
    """Valid metric rows only."""
    return metric_tokens(lines).filter(F.col("reason").isNull()).drop("reason")


def observations(lines: DataFrame, history: DataFrame | None = None, findings: DataFrame | None = None) -> DataFrame:
    """What a log reports, unverified: source, line_no, kind, text.

    Each non-blank line with its number; each epoch of ``history`` (source, epoch, metric) with the metrics it reports;
    each of ``findings`` (source, title).
    """
    full = lines.filter(trimmed(F.col("line")) != "")
    rows = full.select("source", "line_no", F.lit("log_line").alias("kind"), F.col("line").alias("text"))
    nowhere = F.lit(None).cast("long").alias("line_no")
    if history is not None:
        # the metrics of a history are a fixed list, so this array is short
        epochs = history.groupBy("source", "epoch").agg(F.array_join(F.sort_array(F.collect_set("metric")), ", ").alias("named"))
        text = F.concat(F.lit("epoch "), F.col("epoch").cast("string"), F.lit(": "), F.col("named"))
        rows = rows.unionByName(epochs.select("source", nowhere, F.lit("epoch").alias("kind"), text.alias("text")))
    if findings is not None:
        rows = rows.unionByName(findings.select("source", nowhere, F.lit("finding").alias("kind"), F.col("title").alias("text")))
    return rows


def map_metric_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns to known metric names; unknown sources, foreign targets and collisions are refused."""
    unknown = [c for c in mapping if c not in df.columns]
    foreign = [t for t in mapping.values() if t not in METRIC_COLUMNS]
    renamed = [mapping.get(c, c) for c in df.columns]
    if unknown or foreign or len(set(renamed)) != len(renamed):
        raise ValueError(f"invalid mapping: unknown {unknown}, foreign {foreign}, or two columns share a name")
    return df.withColumnsRenamed(dict(mapping))


def table_lines(df: DataFrame, row: str, source: str) -> DataFrame:
    """A metric table as log lines, so wide CSV metrics go through the same extraction."""
    named = [c for c in df.columns if c in METRIC_COLUMNS]
    cells = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in named]
    return df.select(F.lit(source).alias("source"), F.col(row).alias("line_no"), F.concat_ws(" ", *cells).alias("line"))


# --- JSON ---------------------------------------------------------------------------------------



def _nesting(text: Column) -> Column:
    """How deep a JSON text's brackets nest; brackets inside its strings may only add to it."""
    step = lambda c: F.when(c.isin("{", "["), F.lit(1)).otherwise(F.lit(-1))
    brackets = F.split(F.regexp_replace(text, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    walk = lambda a, c: F.struct((a["now"] + step(c)).alias("now"), F.greatest(a["most"], a["now"] + step(c)).alias("most"))
    return F.aggregate(F.filter(brackets, lambda c: c != ""), start, walk)["most"]


def _item(path: Column, node: Column) -> Column:
    """A node with its path and kind. The kind is found once: a scalar keeps it while deeper levels are opened."""
    kind = F.substring_index(F.schema_of_variant(node), "<", 1)
    return F.struct(path.alias("path"), node.alias("node"), kind.alias("kind"))


def _children(item: Column) -> Column:
    """An object's or array's members one level down; a scalar is its own only member."""
    node, path = item["node"], item["path"]
    join = lambda key: F.when(path == "", key).otherwise(F.concat_ws("_", path, key))
    fields = F.transform(F.map_entries(node.try_cast("map<string,variant>")), lambda e: _item(join(e.key), e.value))
    members = F.transform(node.try_cast("array<variant>"), lambda v, i: _item(join(i.cast("string")), v))
    return F.when(item["kind"] == "OBJECT", fields).when(item["kind"] == "ARRAY", members).otherwise(F.array(item))


def flatten_json(df: DataFrame, key: str, text: str) -> DataFrame:
    """Leaves of nested JSON: key, record, path joined by ``_``, value text. Invalid JSON gives no rows.

    A top-level array, or the array under ``history``, is a list of records; anything else is record 0.
    Numbers and strings are kept. Nesting is opened one level at a time, as deep as the deepest text goes,
    which a first job finds. An empty container gives no row.
    """
    depth = df.agg(F.max(_nesting(F.col(text)))).first()[0] or 0
    parsed = df.select(key, F.try_parse_json(text).alias("__doc")).filter(F.col("__doc").isNotNull())
    top = F.col("__doc").try_cast("array<variant>")
    history = F.try_variant_get("__doc", "$.history", "array<variant>")
    shape = F.schema_of_variant("__doc")
    records = (
        F.when(F.startswith(shape, F.lit("ARRAY")), top)
        .when(F.startswith(shape, F.lit("OBJECT")) & history.isNotNull(), history)
        .otherwise(F.array(F.col("__doc")))
    )
    rows = parsed.select(key, F.posexplode(records).alias("__at", "__node"))
    root = F.array(_item(F.lit(""), F.col("__node")))
    items = rows.select(key, F.col("__at").cast("long").alias("record"), root.alias("__items"))
    for _ in range(depth):
        items = items.select(key, "record", F.flatten(F.transform("__items", _children)).alias("__items"))
    leaves = items.select(key, "record", F.inline("__items"))
    kept = leaves.filter(~F.col("kind").isin("VOID", "BOOLEAN"))
    return kept.select(key, "record", "path", F.when(~F.col("kind").isin("OBJECT", "ARRAY"), F.try_variant_get("node", "$", "string")).alias("value"))


def json_lines(leaves: DataFrame, key: str) -> DataFrame:
    """One log line per leaf (``path=value``), ready for metric extraction."""
    line = F.concat(F.col("path"), F.lit("="), F.col("value"))
    return leaves.filter(F.col("value").isNotNull()).select(F.col(key).cast("string").alias("source"), F.col("record").alias("line_no"), line.alias("line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log files as (source, line_no, line).

    The line number is the byte-ordered row position inside its file, found without a per-file task.
    """
    raw = spark.read.text(path).select(
        F.input_file_name().alias("source"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")
    )
    return row_index(raw, "at", ("source",), "line_no").select("source", (F.col("line_no") + 1).alias("line_no"), "line")
