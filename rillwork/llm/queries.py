"""Queries of the text operators. They can't be told in SQL; tests/llm checks them by brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leaks, packing, residue, tokens


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    path = spark.conf.get("rillwork.vocabulary", tokens.DEFAULT_VOCABULARY)
    lengths = tokens.token_counts(_read(spark, d, "documents"), vocabulary=path)
    return packing.pack(lengths, _read(spark, d, "pack_target").withColumnRenamed("capacity_tokens", "capacity"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    per = p7_packing(spark, d).groupBy("target_id", "container_id").agg(F.sum("length").alias("used"))
    conf = _read(spark, d, "pack_target").select("target_id", "capacity_tokens")
    total = per.groupBy("target_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    return total.join(conf, "target_id").select("target_id", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled"))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(_read(spark, d, "documents"), _read(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_passages(spark, d).where("leaked").select("doc_id", "item_id")


def p9_judged(spark: SparkSession, d: str) -> DataFrame:
    return residue.judge_residue(_read(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_judged(spark, d).where("is_residue").select("doc_id")


def queries() -> dict:
    return {n: globals()[n] for n in "p7_packing p7_fill p8_found p8_passages p9_found p9_judged".split()}


def oracle_sql() -> dict[str, str]:
    return {}
