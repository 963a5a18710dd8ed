"""All catalogue queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmetrics.functions.decoding import json_kind, json_number
from shelfmetrics.functions.packsize import extract_pack_sizes
from shelfmetrics.functions.ratings import is_rated, wilson
from shelfmetrics.operators import matching, matrix, profile, ratings, sampling, scoring, sweep
from shelfmetrics.sources import catalog, load
from shelfmetrics.sources.settle import settled

from . import sql

FALLBACK = (4.25, 50.0)
RULES = matching.Rules(
    queries=("gear", "widgets", "small ring", "hot plate", "anvil kit", "red gizmo"),
    exclude_all=("holder", "kit"),
    exclude_per_query={"gear": ("pack of",), "widgets": ("refill",), "small ring": ("count",)},
)
LOST_QUERIES = ("oz gear", "count rod", "mug holder", "pack plate")


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.raw_items(spark, sf_dir)


@lru_cache(maxsize=64)
def _checked(spark: SparkSession, sf_dir: str) -> None:
    """Refuses a catalogue with any bad row; once for each source in a session."""
    load.load_items(spark, raw(spark, sf_dir))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    _checked(spark, sf_dir)
    return load.typed(load.decoded(raw(spark, sf_dir)))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.priced(items(spark, sf_dir))


def named_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate sets by the first two words of the title."""
    base = F.regexp_extract("title", r"^([a-z]+ [a-z]+?)s?\b", 1)
    return priced(spark, sf_dir).withColumn("query", base)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def car_topk_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = named_sets(spark, sf_dir)
    top = ratings.ranked(sets, ratings.priors_for(sets, FALLBACK), top=5)
    return _rounded(top.select("query", "rank", "parent_asin", "car", "source"), "car")


def priors_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ratings.priors_for(named_sets(spark, sf_dir), FALLBACK), "C", "m")


def pool_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ratings.compute_priors(priced(spark, sf_dir)), "C_simple", "C_weighted", "m_median")


def car_sensitivity_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(sweep.sweep(priced(spark, sf_dir)).select("combo", "rank", "parent_asin", "car"), "car")


def car_sensitivity_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.overlaps(sweep.sweep(priced(spark, sf_dir)))


def distinct_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.resolution(priced(spark, sf_dir))


def star_sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.by_stars(priced(spark, sf_dir)).select("parent_asin", "average_rating", "rating_number")


def star_sort_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = priced(spark, sf_dir)
    return sweep.star_overlap(pool, sweep.sweep(pool))


def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sweep.rank_table(sweep.sweep(priced(spark, sf_dir)))


def profile_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.profile_prices(raw(spark, sf_dir)), "min", "max", *[f"p{round(100 * p)}" for p in profile.PERCENTILES])


def profile_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(profile.profile_ratings(raw(spark, sf_dir)), "m_median", *[f"p{round(100 * p)}" for p in profile.PERCENTILES])


def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.price_histogram(raw(spark, sf_dir)).select("bin", "n")


def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.price_texts(raw(spark, sf_dir))


def price_null_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load.decoded(raw(spark, sf_dir)).where("price_null_reason IS NOT NULL")
    return rows.groupBy("price_null_reason").agg(F.count("*").alias("n"))


def load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.load_report(load.decoded(raw(spark, sf_dir)))


def _spoilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records, some of which break the contract in ways that their keys tell."""
    key = F.substring("parent_asin", 2, 8).cast("long")
    return raw(spark, sf_dir).withColumns(
        {
            "price": F.when(key % 101 == 1, F.concat(F.lit('"'), F.col("price"), F.lit('"'))).otherwise(F.col("price")),
            "average_rating": F.when(key % 103 == 2, "5.5").when(key % 107 == 3, "true").otherwise(F.col("average_rating")),
            "rating_number": F.when(key % 109 == 4, "-3").when(key % 113 == 5, '"12"').otherwise(F.col("rating_number")),
            "details": F.when(key % 127 == 6, "[1]").when(key % 131 == 7, "{bad").otherwise(F.col("details")),
        }
    )


def malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.decoded(_spoilt(spark, sf_dir)).where(F.size("errors") > 0).select("parent_asin", F.concat_ws("; ", "errors").alias("errors"))


def json_props_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.get_json_object("props", "$.k")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", json_kind(cell).alias("kind"), json_number(cell).alias("k"))


def detail_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load.detail_columns(items(spark, sf_dir)).select("parent_asin", "size", "unit_count", "number_of_items", "item_package_quantity")


def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(priced(spark, sf_dir), RULES).select("query", "parent_asin", "kept")


def exclusion_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match(priced(spark, sf_dir), RULES).where("NOT kept").select("query", "parent_asin", F.concat_ws("|", "hits").alias("hits"))


def adjacency_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.adjacency_lost(priced(spark, sf_dir), LOST_QUERIES).select("query", "parent_asin")


def license_phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return matching.match(docs, matching.Rules(("mit license",)), title="text").select("query", "doc_id")


def _packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pack_sizes(priced(spark, sf_dir))


def packsize_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("pack")
    return _packs(spark, sf_dir).select(
        "parent_asin", p["count"].alias("count"), p["size"].alias("size"), p["unit"].alias("unit"), p["dimension"].alias("dimension"), F.round(p["total_base"], 6).alias("total_base"),
        F.concat_ws("|", p["sources"]).alias("sources"), "confidence", "flag",
    )


def packsize_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.coverage(_packs(spark, sf_dir))


def packsize_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(scoring.coverage_total(_packs(spark, sf_dir)), "coverage")


def _truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by construction, a tenth of them wrong or N/A on purpose."""
    key = F.substring("parent_asin", 2, 8).cast("long")
    packs = _packs(spark, sf_dir)
    size, of, count = ((F.regexp_extract("title", p, 1)) for p in (r"(\d+) (?:oz|ml)", r"(\d+) x", r"(\d+) count"))
    t = key % catalog.TEMPLATES
    truth = (
        F.when(key % 10 == 9, "N/A").when(t.isin(0, 7), F.concat(F.lit("1 x "), size, F.lit(" oz"))).when(t == 1, F.concat(of, F.lit(" x "), size, F.lit(" ML")))
        .when(t == 2, F.concat(F.lit("1 x "), count, F.lit(" ct"))).when(t == 6, F.concat(F.lit("1 x "), size, F.lit(" oz"))).otherwise("none")
    )
    labels = packs.where(t.isin(0, 1, 2, 4, 6, 7) & ~F.col("title").contains("plate")).select(key.alias("audit_id"), "parent_asin", truth.alias("truth"))
    return scoring.judged(labels, packs)


def packsize_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truths(spark, sf_dir).select("audit_id", "truth_kind", "verdict", "exact")


def packsize_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scoring.score_report(_truths(spark, sf_dir))
    return _rounded(out, "coverage", *[f"{x}_{k}" for x in ("precision", "low", "high") for k in ("all", "no_na", "expressible")])


def audit_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("lang", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("in_set"), F.when(F.col("toxic") == 1, "UNCERTAIN").alias("notes"))
    return _rounded(scoring.membership_scores(rows, "lang").select("lang", "n", "yes", "n_sure", "yes_sure", "share", "low", "high"), "share", "low", "high")


def audit_without_unsure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("source", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("in_set"), F.when(F.col("toxic") == 1, "UNCERTAIN").alias("notes"))
    return _rounded(scoring.membership_scores(rows, "source").select("source", "n_sure", "yes_sure", "share_sure", "low_sure", "high_sure"), "share_sure", "low_sure", "high_sure")


def recall_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = matching.adjacency_lost(priced(spark, sf_dir), LOST_QUERIES)
    key = F.substring("parent_asin", 2, 8).cast("long")
    labels = lost.where(key % 3 == 0).select("query", F.when(key % 2 == 0, "yes").otherwise("no").alias("in_set"), F.lit(None).cast("string").alias("notes"))
    sizes = lost.groupBy("query").agg(F.count("*").alias("group_size"))
    return _rounded(scoring.recall_loss(scoring.membership_scores(labels, "query"), sizes).select("query", "n", "yes", "group_size", "lost"), "lost")


def precision_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    out = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return _rounded(out.withColumns({"low": low, "high": high}), "low", "high")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nouns as candidate sets, with CAR and unit prices; written, as the rules after it join the sets with what they come to."""
    noun = F.regexp_extract("title", r"^[a-z]+ ([a-z]+?)s?\b", 1)
    priors = ratings.priors_for(priced(spark, sf_dir).withColumn("query", noun), FALLBACK)
    return settled(matrix.unit_prices(ratings.with_car(_packs(spark, sf_dir).withColumn("query", noun), priors)), "scored")


def unit_price_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("parent_asin", "dimension", "unit", "total", "unit_price")
    return _rounded(rows, "total", "unit_price")


def coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.coherence(_scored(spark, sf_dir)), "share", "spread")


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets by noun and dimension, taken as coherent so that every rule after it has rows at any scale."""
    rows = _scored(spark, sf_dir).where("car IS NOT NULL AND unit_price IS NOT NULL").withColumn("query", F.concat_ws("/", "query", "dimension"))
    return matrix.guard(rows)


def two_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return matrix.two_axis(scored, matrix.coherence(scored)).select("query", "parent_asin")


def guard_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark, sf_dir).select("query", "parent_asin", "flagged", "guard_reason")


def quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.quadrants(_guarded(spark, sf_dir)).select("query", "parent_asin", "quadrant")


def off_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.off_diagonal(_guarded(spark, sf_dir)).select("query", "parent_asin", F.round("car_rank", 6).alias("car_rank"), F.round("price_rank", 6).alias("price_rank"), "off_diagonal")


def axis_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(matrix.axis_correlation(_guarded(spark, sf_dir)), "spearman")


def star_sort_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.star_sort_landing(matrix.quadrants(_guarded(spark, sf_dir))).select("query", "star_rank", "parent_asin", "quadrant")


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.explanation(_guarded(spark, sf_dir)).select("query", "parent_asin", "explanation")


def rated_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).agg(F.count("*").alias("n"), F.count_if(is_rated()).alias("n_rated"))


def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.audit_sample(priced(spark, sf_dir)).select("audit_id", "parent_asin", "title", "price")


def contamination_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.contamination_sample(matching.match(priced(spark, sf_dir), RULES), RULES.queries)


def recall_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.recall_sample(matching.adjacency_lost(priced(spark, sf_dir), LOST_QUERIES), LOST_QUERIES)


def publication_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.publication_sample(matching.match(priced(spark, sf_dir), RULES), RULES.queries)


_QUERIES = (
    car_topk_by_name, priors_with_fallback, pool_priors, car_sensitivity_top, car_sensitivity_overlap, distinct_resolution, star_sort_top, star_sort_overlap, rank_table, profile_price, profile_rating,
    price_histogram, price_texts, price_null_reasons, load_report, malformed_rows, json_props_decode, detail_projection, phrase_match, exclusion_hits, adjacency_lost, license_phrase_match, packsize_extract,
    packsize_coverage, packsize_pool, packsize_verdicts, packsize_score, audit_by_lang, audit_without_unsure, recall_loss, precision_wilson, unit_price_axis, coherence, two_axis, guard_flags, quadrants, off_diagonal, axis_spearman,
    star_sort_landing, explanations, rated_share, audit_sample, contamination_sample, recall_sample, publication_sample,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
