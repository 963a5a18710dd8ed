"""JSON lines to slim Parquet: six fields, four of them as JSON text, with a checksum and a manifest.

Source and target may lie in any file system that Spark reads.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation

from .load import FIELDS

_TEXTS = ", ".join(f"{f} string" for f in FIELDS)
_VALUES = ", ".join(f"{f} variant" for f in FIELDS)


def source_name(category: str) -> str:
    return f"raw/meta_categories/meta_{category}.jsonl"


def why_bad(line: Column) -> Column:
    """Why a line is no record; null for those that are. The JSON parser ignores what follows a value, so that a line is
    parsed as an array's only element."""
    whole = F.json_array_length(F.concat(F.lit("["), line, F.lit("]"))) == 1
    return F.when(~F.coalesce(whole, F.lit(False)), "not JSON").when(~F.ltrim(line).startswith("{"), "not an object")


def slim(lines: DataFrame) -> DataFrame:
    """Lines of text (column value) to the six fields, why_bad and the line; blank lines go, other columns stay.

    Numbers, objects and lists keep the text of their own, so that 12.0 stays apart from 12, and keys keep their order; strings are quoted. Of
    a key that occurs twice the last counts. An absent field is the text null; an id or title that isn't a string is null.
    """
    rows = lines.where(~F.col("value").rlike(r"(?U)^\s*$")).select("*", F.from_json("value", _TEXTS).alias("_t"), F.from_json("value", _VALUES).alias("_v"), why_bad(F.col("value")).alias("why_bad"))
    is_text = lambda f: F.coalesce(F.schema_of_variant(F.col(f"_v.{f}")) == "STRING", F.lit(False))
    cell = lambda f: F.when(is_text(f), F.to_json(F.col(f"_v.{f}"))).otherwise(F.coalesce(f"_t.{f}", F.lit("null"))).alias(f)
    text = lambda f: F.when(is_text(f), F.col(f"_t.{f}")).alias(f)
    others = [c for c in lines.columns if c != "value"]
    return rows.select(*others, text("parent_asin"), text("title"), *[cell(f) for f in FIELDS[2:]], "why_bad", F.col("value").alias("line"))


def _path(spark: SparkSession, path: str):
    """A path and its file system."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def digest(spark: SparkSession, path: str) -> tuple[int, str]:
    """Bytes and SHA-256 of a file, read as a stream: the checksum can't be taken in parts."""
    file, system = _path(spark, path)
    stream = system.open(file)
    try:
        return system.getFileStatus(file).getLen(), spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def _numbered(lines: DataFrame, bad: Column) -> DataFrame:
    """(line_no, line, why_bad) of the bad lines. A line's number is the number of lines in the blocks of the file before its
    own, of which there is a row for each, and its place in it."""
    rows = lines.select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    blocks = rows.groupBy("_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", "_first", F.coalesce(F.sum("_lines").over(before), F.lit(0)).alias("_before"))
    found = rows.where(~F.col("value").rlike(r"(?U)^\s*$")).withColumn("why_bad", bad).where("why_bad IS NOT NULL")
    return found.join(F.broadcast(blocks), "_block").select((F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line_no"), F.col("value").alias("line"), "why_bad")


def ingest(spark: SparkSession, source: str, out: str, expected: tuple[int, str] | None = None, overwrite: bool = False) -> dict | None:
    """Reads JSON lines, writes slim Parquet beside a manifest, and returns the manifest; None if the output is there.

    With ``expected`` (bytes, SHA-256) another source is refused, before anything is written. Lines that are no records are
    counted in the pass that writes the others, and the first twenty are shown with their numbers. The output is written under a partial name; an output
    that is there is moved aside until the new one has its name.
    """
    target, system = _path(spark, out)
    partial, aside = (_path(spark, f"{out}.{x}")[0] for x in ("partial", "replaced"))
    if system.exists(target) and not overwrite:
        return None
    size, sha = digest(spark, source)
    if expected and (size, sha) != expected:
        raise ValueError(f"{source} has {size} bytes and SHA-256 {sha}; {expected[0]} and {expected[1]} are published")
    lines = spark.read.text(source, lineSep="\n")
    system.delete(partial, True)
    seen = Observation()
    rows = slim(lines).observe(seen, F.count_if(F.col("why_bad").isNull()).alias("good"), F.count_if(F.col("why_bad").isNotNull()).alias("bad"))
    rows.where("why_bad IS NULL").select(*FIELDS).write.option("compression", "zstd").parquet(f"{out}.partial")
    counts = seen.get
    examples = _numbered(lines, why_bad(F.col("value"))).orderBy("line_no").limit(20).collect() if counts["bad"] else []
    manifest = {
        "source": source,
        "source_bytes": size,
        "source_sha256": sha,
        "rows_written": counts["good"],
        "unparseable_json_lines": counts["bad"],
        "unparseable_examples": [[r.line_no, f"{r.why_bad}: {r.line[:200]}"] for r in examples],
        "fields": list(FIELDS),
        "output": out,
        "output_bytes": system.getContentSummary(partial).getLength(),
    }
    system.delete(aside, True)
    if system.exists(target):
        system.rename(target, aside)
    if not system.rename(partial, target):
        system.rename(aside, target)
        raise OSError(f"{out}.partial can't be renamed to {out}")
    system.delete(aside, True)
    write_text(spark, f"{out}.manifest.json", json.dumps(manifest, indent=2))
    return manifest


def write_text(spark: SparkSession, path: str, text: str) -> None:
    file, system = _path(spark, path)
    stream = system.create(file, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if it isn't there."""
    file, system = _path(spark, path)
    if not system.exists(file):
        return None
    stream = system.open(file)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()
