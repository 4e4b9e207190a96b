"""Screening of features that may reveal the outcome. Signals for review, never proof."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import is_missing, trimmed
from ..functions.times import utc_timestamp

# Name patterns of identifiers and of post-outcome columns.
IDENTIFIER_NAME = r"(?i)((^|_)id$|uuid|identifier)"
POST_OUTCOME_NAME = r"(?i)(^|_)(post_outcome|after_outcome|future|final_diagnosis|outcome_result)(_|$)"


def feature_values(ev: DataFrame, features: Sequence[str], positive: str = "1") -> DataFrame:
    """Per feature and distinct value: positives, negatives, and pairs equal to the target.

    This is the only pass over the rows; every rule below reads these counts. Missing values are
    kept under a NULL value so coverage needs no second pass.
    """
    cell = lambda c: trimmed(F.col(f"`{c}`").cast("string"))
    pairs = [F.struct(F.lit(c).alias("feature"), F.when(~is_missing(cell(c)), cell(c)).alias("value")) for c in features]
    rows = ev.select("y_true", F.inline(F.array(*pairs)))
    return rows.groupBy("feature", "value").agg(
        F.count_if(F.col("y_true") == positive).alias("pos"),
        F.count_if(F.col("y_true") != positive).alias("neg"),
        F.count_if(F.col("value") == F.col("y_true")).alias("copies"),
    )


def feature_facts(values: DataFrame) -> DataFrame:
    """One row per feature with all counts the rules need."""
    there = F.col("value").isNotNull()
    pick = lambda c: F.when(there, F.col(c))
    whole = lambda c: F.coalesce(F.sum(pick(c)), F.lit(0)).cast("long")
    size = F.col("pos") + F.col("neg")
    return values.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(there, size)), F.lit(0)).cast("long").alias("n"),
        F.coalesce(F.sum(F.when(~there, size)), F.lit(0)).cast("long").alias("missing"),
        whole("pos").alias("pos"),
        whole("neg").alias("neg"),
        whole("copies").alias("copies"),
        F.count_if(there).alias("distinct"),
        F.min(F.when(there, size)).alias("rarest"),
        F.coalesce(F.sum(F.when(there, F.greatest("pos", "neg"))), F.lit(0)).cast("long").alias("mapped"),
    )


def complete_pairs(facts: DataFrame) -> DataFrame:
    return facts.select("feature", F.col("n").alias("complete"), "missing", (F.col("n") == 0).alias("all_missing"))


def _enough() -> Column:
    return (F.col("n") >= 20) & (F.col("pos") >= 5) & (F.col("neg") >= 5)


def _exact() -> Column:
    return (F.col("n") >= 3) & (F.col("copies") == F.col("n"))


def exact_copy(facts: DataFrame) -> DataFrame:
    """``flag``: equal in every complete pair; ``suspicion`` additionally needs both classes."""
    return facts.select("feature", _exact().alias("flag"), (_exact() & (F.col("pos") > 0) & (F.col("neg") > 0)).alias("suspicion"))


def near_copy(facts: DataFrame) -> DataFrame:
    near = ~_exact() & _enough() & (F.col("copies") * 100 >= F.col("n") * 95)
    match = F.when(F.col("n") > 0, F.col("copies") / F.col("n"))
    return facts.select("feature", match.alias("match"), near.alias("flag"))


def unique_id(facts: DataFrame) -> DataFrame:
    flag = (F.col("distinct") == F.col("n")) & (F.col("n") >= 3) & F.col("feature").rlike(IDENTIFIER_NAME)
    return facts.select("feature", flag.alias("flag"))


def post_outcome_name(names: DataFrame, column: str = "feature") -> DataFrame:
    return names.select(column, F.col(column).rlike(POST_OUTCOME_NAME).alias("flag"))


def category_proxy(facts: DataFrame) -> DataFrame:
    """A value-to-majority-label map that reaches 95 % and beats the majority baseline by ten points."""
    majority = F.greatest("pos", "neg")
    repeated = F.col("distinct").between(2, 20) & (F.col("rarest") >= 2)
    better = (F.col("mapped") * 100 >= F.col("n") * 95) & ((F.col("mapped") - majority) * 10 >= F.col("n"))
    size = F.when(F.col("n") > 0, F.col("n"))
    return facts.select(
        "feature",
        (F.col("mapped") / size).alias("purity"),
        (majority / size).alias("baseline"),
        (_enough() & repeated & better).alias("flag"),
    )


def temporal_order(df: DataFrame, predicted_at: str, outcome_at: str) -> DataFrame:
    """Valid, missing and invalid time pairs, and outcomes at or before their prediction."""
    gone = is_missing(F.col(predicted_at)) | is_missing(F.col(outcome_at))
    p, o = utc_timestamp(F.col(predicted_at)), utc_timestamp(F.col(outcome_at))
    valid = ~gone & p.isNotNull() & o.isNotNull()
    return df.agg(
        F.count_if(valid).alias("valid"),
        F.count_if(gone).alias("missing"),
        F.count_if(~gone & ~valid).alias("invalid"),
        F.count_if(valid & (o <= p)).alias("reversed"),
    )


def scan(ev: DataFrame, features: Sequence[str], positive: str = "1") -> DataFrame:
    """All feature rules in one table: feature, classification, method."""
    facts = feature_facts(feature_values(ev, features, positive))
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    near = ~_exact() & _enough() & (F.col("copies") * 100 >= F.col("n") * 95)
    unique = (F.col("distinct") == F.col("n")) & (F.col("n") >= 3) & F.col("feature").rlike(IDENTIFIER_NAME)
    proxy = (
        _enough()
        & F.col("distinct").between(2, 20)
        & (F.col("rarest") >= 2)
        & (F.col("mapped") * 100 >= F.col("n") * 95)
        & ((F.col("mapped") - F.greatest("pos", "neg")) * 10 >= F.col("n"))
    )
    some = F.col("n") > 0
    rules = [
        (~some, "observation", "no_complete_pairs"),
        (_exact(), "observation", "exact_target_copy"),
        (_exact() & both, "suspicion", "target_copy_review"),
        (near, "suspicion", "near_target_copy"),
        (unique, "suspicion", "unique_identifier"),
        (some & F.col("feature").rlike(POST_OUTCOME_NAME), "suspicion", "post_outcome_name"),
        (proxy, "suspicion", "categorical_target_proxy"),
    ]
    hits = [
        F.when(cond, F.struct(F.lit(kind).alias("classification"), F.lit(method).alias("method")))
        for cond, kind, method in rules
    ]
    return facts.select("feature", "n", "missing", F.inline(F.array_compact(F.array(*hits))))
