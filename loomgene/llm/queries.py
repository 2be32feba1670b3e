"""The queries of this subpackage's operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, licenses, lm, mixing, quality, sharding, simhash, tokens, urls
from .store import written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return near.select(F.col("doc").alias("doc_id"), simhash.hex_digits("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(_remainder(4) == 2, F.lit(False)))
    model = langid.train(docs.where(~F.col("held_out")))
    rows = langid.predict(docs.select("doc_id", "text", "held_out"), model)
    return rows.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score", "language.ambiguous")


def op3_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shuffle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    return rows.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.array_join(f"licenses.{c}", ",").alias(c) for c in ("base_labels", "labels")]
    return rows.select("doc_id", "licenses.n_words", "licenses.n_base", "licenses.first_word", "licenses.last_word", *joined, "licenses.score")


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return rows.select("page_id", "url_verdict.host", "url_verdict.path", "url_verdict.rule", "url_verdict.verdict")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    names = F.sha2(F.array_join("contamination.items", ",").cast("binary"), 256).alias("items_sha256")
    n_items = F.size("contamination.items").cast("bigint").alias("n_items")
    return rows.select("doc_id", "contamination.n_words", "contamination.n_hit", n_items, names, "contamination.contaminated")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = written(quality.signals(_table(spark, sf_dir, "documents"), "text", ["doc_id", "lang", "source"]), "signals")
    rows = quality.judge(signals, quality.thresholds(signals))
    return rows.select("doc_id", "sig.n_words", "sig.word_chars", "sig.n_symbols", "sig.n_dup_lines", "sig.n_repeat_words", "base_failed", "kept")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_sizes(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc").alias("doc_id"), "size", "source_size", "target", "taken")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(_remainder(5) == 1, F.lit(False)))
    model = lm.train(docs.where(~F.col("held_out")), order=3)
    rows = lm.score(docs, model)
    return rows.select("doc_id", "held_out", "lm.n_tokens", "lm.n_known", "lm.train_tokens", "lm.base_score", "lm.score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_langid": op2_langid,
    "op3_shuffle": op3_shuffle,
    "op4_licenses": op4_licenses,
    "op5_tokens": op5_tokens,
    "op6_urls": op6_urls,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_lm": op10_lm,
}

ORACLE_SQL: dict[str, str] = {
    "op4_licenses": licenses.oracle(),
    "op6_urls": urls.oracle(),
    "op7_decontaminate": decontaminate.oracle(),
    "op8_quality": quality.oracle(),
    "op9_mixing": mixing.oracle(),
}
