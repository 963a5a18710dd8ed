"""Seeded samples: the same draw whatever the order or partitioning of the input.

A draw is the standard library's over sorted ids, whose choice of places depends on their number alone. So only counts of groups come to the
driver, places are drawn there, and the rows at these places are found by the counts of sorted partitions.
"""

from __future__ import annotations

import random
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rows_at(df: DataFrame, order: list[str], places: list[int]) -> DataFrame:
    """(audit_id, columns of df): the rows at these places of the sorted rows, numbered from 1 in the order of the list.

    The rows' keys are range-partitioned and sorted; a partition's count, of which there is a row each, tells where it begins.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).persist()
    try:
        counts = dict(ranged.groupBy(F.shiftright("_id", 33).alias("part")).count().collect())
        starts = list(accumulate((counts[p] for p in sorted(counts)), initial=0))
        names = sorted(counts)
        chosen = []
        for number, place in enumerate(places, 1):
            at = max(k for k in range(len(names)) if starts[k] <= place)
            chosen.append((number, (names[at] << 33) + place - starts[at]))
        found = ranged.join(F.broadcast(spark.createDataFrame(chosen, "audit_id int, _id long")), "_id").select("audit_id", *df.columns)  # a sample
        return spark.createDataFrame(found.collect(), found.schema)
    finally:
        ranged.unpersist()


def audit_sample(items: DataFrame, n: int = 200, seed: int = 20260930) -> DataFrame:
    """A simple random sample of items: audit_id (from 1), then the items' columns."""
    many = items.count()
    drawn = rows_at(items.select("parent_asin"), ["parent_asin"], random.Random(seed).sample(range(many), min(n, many)))
    return items.join(F.broadcast(drawn), "parent_asin").select("audit_id", *items.columns)  # n rows


def _by_query(groups: DataFrame, queries: tuple[str, ...], seed_text: str, quotas: tuple[tuple[str, int], ...], shuffle: bool) -> DataFrame:
    """(audit_id, query, parent_asin, title) of a draw for each query, from its groups in the order of the quotas, with one generator a query."""
    rows = groups.dropDuplicates(["query", "grp", "parent_asin"])
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("query", "grp").count().collect()}  # a row for each query and group
    starts = dict(zip(sorted(counts), accumulate((counts[g] for g in sorted(counts)), initial=0), strict=False))
    places: list[int] = []
    for query in queries:
        rng = random.Random(seed_text.format(query=query))
        own: list[int] = []
        for group, quota in quotas:
            many = counts.get((query, group), 0)
            own += [starts[query, group] + k for k in rng.sample(range(many), min(quota, many))]
        if shuffle:
            rng.shuffle(own)
        places += own
    return rows_at(rows, ["query", "grp", "parent_asin"], places).select("audit_id", "query", "parent_asin", "title")


def contamination_sample(matches: DataFrame, queries: tuple[str, ...], seed: int = 20261004, kept: int = 40, excluded: int = 20) -> DataFrame:
    """From each query's kept and excluded items, shuffled so that rows don't show which; short groups whole."""
    groups = matches.select("query", "parent_asin", "title", F.when(F.col("kept"), "kept").otherwise("excluded").alias("grp"))
    return _by_query(groups, queries, f"{seed}:{{query}}", (("kept", kept), ("excluded", excluded)), True)


def recall_sample(lost: DataFrame, queries: tuple[str, ...], seed: int = 20261004, n: int = 20) -> DataFrame:
    """From each query's titles that the phrase rule loses, with a seed of its own."""
    return _by_query(lost.select("query", "parent_asin", "title", F.lit("lost").alias("grp")), queries, f"{seed}:recall:{{query}}", (("lost", n),), False)


def publication_sample(matches: DataFrame, queries: tuple[str, ...], seed: int = 20261004, n: int = 50) -> DataFrame:
    """At most n of each query's kept items."""
    groups = matches.where("kept").select("query", "parent_asin", "title", F.lit("kept").alias("grp"))
    return _by_query(groups, queries, f"{seed}:publication:{{query}}", (("kept", n),), False)


def rows_per_query(sample: DataFrame) -> DataFrame:
    """How many rows of a sample each query has."""
    return sample.groupBy("query").agg(F.count("*").alias("n"))
