"""Registered queries opN_<name> over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg, line_dedup, mixing, ngram_join, order_minhash, ordinal, packing, pii, substring_rlz, substring_suffix


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.compare_with_edited(documents(spark, sf_dir))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return ordinal.score(docs, ordinal.train(docs, ordinal.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))))


def op3_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(documents(spark, sf_dir)))


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.store_texts(documents(spark, sf_dir), with_media=False)


def op5_substring_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_rlz.remove_repeats(documents(spark, sf_dir), with_text=False)


def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "lang", "n_chars", "text", "mix_copy", "mix_key")


def op7_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_suffix.remove_repeats(documents(spark, sf_dir), with_bytes=False)


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.length("kept").cast("long").alias("kept_chars"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.component_ids(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_order_minhash": op1_order_minhash, "op2_ordinal_quality": op2_ordinal_quality, "op3_pii_bootstrap": op3_pii_bootstrap, "op4_jpeg_media": op4_jpeg_media, "op5_substring_rlz": op5_substring_rlz, "op6_poisson_mix": op6_poisson_mix, "op7_pack_best_fit": op7_pack_best_fit, "op8_suffix_array": op8_suffix_array, "op9_fuzzy_lines": op9_fuzzy_lines, "op10_ngram_join": op10_ngram_join}


def oracle_sql() -> dict[str, str]:
    return {"op6_poisson_mix": mixing.ORACLE_SQL}
