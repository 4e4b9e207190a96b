"""Registration of catalog queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Comparable output: doubles rounded, integers and whole decimals as BIGINT."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(field.dataType, T.DecimalType) and field.dataType.scale == 0:
            c = c.try_cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, dir)`` under a survey id, with the SQL that must give the same rows."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, d: str) -> DataFrame:
            return tidy(fn(spark, d))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def sql(ctes: str, body: str, doubles: tuple[str, ...] | list[str] = (), longs: tuple[str, ...] | list[str] = ()) -> str:
    """Oracle text: ``WITH ctes`` around ``body``, doubles rounded like ``tidy`` and longs as BIGINT."""
    swaps = [f'round({c}, {DIGITS}) + 0.0 AS {c}' for c in doubles]
    swaps += [f'CAST({c} AS BIGINT) AS {c}' for c in longs]
    replace = f" REPLACE ({', '.join(swaps)})" if swaps else ""
    head = f"WITH {ctes.strip().rstrip(',')}\n" if ctes.strip() else ""
    return f"{head}SELECT *{replace} FROM (\n{body.strip()}\n) AS result"
