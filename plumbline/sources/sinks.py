"""Writing records and exports, and reading them back under a strict schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


RECORD_VERSION = 1


def write_records(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """One folder per entity. Every record carries the version of its layout."""
    for name, df in tables.items():
        df.select("*", F.lit(RECORD_VERSION).alias("record_version")).write.mode("errorifexists").format(form).save(f"{folder}/{name}")


def read_records(spark: SparkSession, folder: str, schemas: Mapping[str, T.StructType], form: str = "parquet") -> dict[str, DataFrame]:
    """The saved tables under their declared schemas; JSON records that do not fit raise on read."""
    reader = spark.read.option("mode", "FAILFAST") if form == "json" else spark.read
    versioned = {name: T.StructType([*schema.fields, T.StructField("record_version", T.IntegerType())]) for name, schema in schemas.items()}
    return {name: reader.schema(schema).format(form).load(f"{folder}/{name}") for name, schema in versioned.items()}


def round_trip(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet") -> DataFrame:
    """Save, reload and compare: entity, rows, changed (rows lost or altered on the way), versions."""
    write_records(tables, folder, form)
    spark = next(iter(tables.values())).sparkSession
    loaded = read_records(spark, folder, {n: df.schema for n, df in tables.items()}, form)
    parts = None
    for name, df in tables.items():
        back = loaded[name]
        lost = df.exceptAll(back.select(*df.columns)).agg(F.count(F.lit(1))).scalar()
        part = back.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("record_version").alias("versions"))
        part = part.select(F.lit(name).alias("entity"), "rows", lost.alias("changed"), "versions")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def export_normalized(ev: DataFrame, folder: str, positive: str = "1") -> None:
    """Labels recoded to 1 and 0 with the probability, as CSV."""
    bit = lambda c: F.when(F.col(c) == positive, 1).otherwise(0).alias(c)
    ev.select(bit("y_true"), bit("y_pred"), "y_probability").write.csv(folder, header=True)


def read_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("y_true string, y_pred string, y_probability double").csv(folder, header=True, enforceSchema=False)


def export_audit(audit: DataFrame, folder: str) -> None:
    """The decision audit as JSON lines."""
    audit.write.json(folder)
