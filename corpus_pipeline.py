"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet and reads it again as the
next stage's docs. All stages but the last return the columns of documents. Near-duplicates are documents whose sets
of five-word shingles have a Jaccard similarity of at least 0.8.

Decisions are about rows: documents with a null id, or one id for several rows, are judged by their texts like all others.
Columns other than doc_id, text, lang and source, whatever their names, are carried along untouched. No documents: no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmetrics.llm.common import table, written
from shelfmetrics.llm.decontamination import clean_of, contaminated
from shelfmetrics.llm.jaccard import jaccard_components
from shelfmetrics.llm.outliers import mcd_outliers
from shelfmetrics.llm.packing import pack
from shelfmetrics.llm.quality import kept_documents
from shelfmetrics.llm.tokens import public_vocabulary


_READ = ("doc_id", "text", "lang", "source")


def _coded(docs: DataFrame) -> DataFrame:
    """The documents, with names that no operator uses for the columns that none reads."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in _READ else f"extra_{k}") for k, c in enumerate(docs.columns)])


def _named(coded: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return coded.select(*[F.col(c if c in _READ else f"extra_{k}").alias(c) for k, c in enumerate(docs.columns)])


def _numbered(docs: DataFrame, tag: str) -> DataFrame:
    """The documents with a unique id for each row, _row; written, so that every use sees the same ids."""
    return written(docs.withColumn("_row", F.monotonically_increasing_id()), tag)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps: neither junk nor toxic.

    Null ids and repeated rows stay if their texts pass; null and empty texts are judged as texts without words. Scores at a half: toxic goes, quality stays.
    """
    return _named(kept_documents(_coded(docs), table(spark, sf_dir, "labels"), sample_rows=8000, labelled_rows=6000), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source, null ids and repeated rows included.

    Null and empty texts fail the base rules. Null languages and sources are groups of their own. A distance at the cutoff stays.
    """
    return _named(mcd_outliers(_coded(docs)).where("kept"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, of equal ids any one.

    Repeated rows are near-duplicates of each other. A null id comes after all others. Empty texts are nobody's duplicates.
    """
    rows = _numbered(_coded(docs), "near-duplicate-rows")
    groups = jaccard_components(rows, n=5, threshold="4/5", key="_row").select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    kept = groups.join(rows.select("_row", "doc_id"), "_row").groupBy("component_id").agg(F.min(order).alias("first")).select(F.col("first._row").alias("_row"))
    return _named(rows.join(kept, "_row", "left_semi"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; of rows with one id, or with none, those that hold an item go. Null and empty texts stay."""
    rows = _numbered(_coded(docs), "decontamination-rows")
    hits = contaminated(rows, table(spark, sf_dir, "benchmark"), threshold=0.7, overlap=0.8, n=5, key="_row")
    return _named(clean_of(rows, hits, key="_row"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences of 1024. Null and empty texts are their end alone; null and repeated ids are packed like others."""
    return pack(docs, public_vocabulary(), size=1024, bound=64)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]
#: SQL can't express the learned stages; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
