"""The queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .decontamination import contaminated
from .extraction import extract_pages
from .jaccard import jaccard_components
from .licenses import scan_licenses
from .ngram_lm import interpolated_scores
from .outliers import mcd_outliers
from .packing import pack
from .quality import classify
from .records import read_records, with_starts, write_records
from .sharding import byte_shards
from .tokens import public_vocabulary


def op1_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams: what trigrams ask grows faster than the documents (see the README)."""
    return interpolated_scores(table(spark, sf_dir, "documents"), order=2)


def op2_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sample_rows=8000, labelled_rows=6000)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), threshold=0.7, overlap=0.8, n=5)


def op6_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = mcd_outliers(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_vocabulary(), size=1024, bound=64)


def op8_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = write_records(table(spark, sf_dir, "documents"), public_vocabulary())
    back = written(read_records(spark, folder, index), "records-back")
    return with_starts(back).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=3, threshold="9/10").select("doc_id", "n_shingles", "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: their source is the top folder, their language the one below."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string"))
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_interpolation": op1_interpolation, "op2_extraction": op2_extraction, "op3_quality": op3_quality, "op4_sharding": op4_sharding, "op5_decontamination": op5_decontamination, "op6_outliers": op6_outliers, "op7_packing": op7_packing, "op8_records": op8_records, "op9_ngram_jaccard": op9_ngram_jaccard, "op10_licenses": op10_licenses}


def oracle_sql() -> dict[str, str]:
    return {}
