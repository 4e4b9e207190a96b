"""One query per operator, with production parameters over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, fingerprints, language, licenses, packing, pages, quality, simhash_dedup, suffix_dedup, toxicity, whitening
from .common import only, table
from .registry import ORACLE, QUERIES, query

__all__ = ["ORACLE", "QUERIES"]

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query("op1_fingerprints")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.with_near(fingerprints.edited_fingerprints(table(spark, folder, "documents")))


@query("op2_byte_bpe")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    tokens = bpe.encode(only(table(spark, folder, "documents"), "doc_id", "text"), RANKS)
    back = bpe.decode(tokens.select("doc_id", "ids"), RANKS)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_license_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_language_id")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_dedup(table(spark, folder, "documents"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), TOKENIZER)


@query("op7_quality_rules", quality.ORACLE)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"))


@query("op9_chat_format", chat.ORACLE)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    given = only(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    control = F.lit("\\### Assistant: </turn> ok")
    added = [F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role"), control.alias("text")) for t, r in enumerate(("user", "assistant"))]
    planted = spark.range(1).select(F.inline(F.array(*added)))
    return chat.format_conversations(given.unionByName(planted))


@query("op10_html_text")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.sha2("text", 256).alias("text_sha256"), F.char_length("text").cast("long").alias("n_chars"), "n_lines")


@query("op11_suffix_dedup")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"), F.sha2("kept", 256))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.col("kept").alias("kept_sha256"))


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op13_collocations", collocations.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
