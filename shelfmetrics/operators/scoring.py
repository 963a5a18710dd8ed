"""Scores of extracted pack sizes and of candidate sets against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmetrics.functions.ratings import wilson
from shelfmetrics.functions.units import canonical_unit, dimension, factor
from shelfmetrics.sources.labels import LabelError

GUARDRAIL = 0.90
NEAR = 0.01
TRUTH = r"(?iU)^\s*(\d+(?:\.\d+)?)\s*x\s*(\d+(?:\.\d+)?)\s*(fl oz|oz|lb|g|kg|ml|l|gal|qt|pt|ct)\s*$"


def parse_truth(text: Column) -> Column:
    """A label as (kind, count, size, unit): COUNT x SIZE UNIT, NONE or N/A; kind is null for anything else."""
    word = F.upper(F.trim(text))
    is_size = text.rlike(TRUTH)
    part = lambda k: F.when(is_size, F.regexp_extract(text, TRUTH, k))
    unit = F.lower(part(3))
    return F.struct(
        F.when(word == "NONE", "none").when(word == "N/A", "na").when(is_size, "size").alias("kind"),
        part(1).try_cast("double").alias("count"),
        part(2).try_cast("double").alias("size"),
        F.when(unit == "ct", "ct").otherwise(canonical_unit(unit)).alias("unit"),
    )


def judged(labels: DataFrame, extracted: DataFrame) -> DataFrame:
    """Labels joined to extractions by id, with truth_kind, verdict (abstained, correct, wrong), exact and the text of what was
    extracted. Raises LabelError for labels that can't be read and for ids that aren't there.

    Labels are a hand-made sample. No pair of totals more than a hundredth apart is correct.
    """
    rows = labels.withColumn("_truth", parse_truth(F.col("truth"))).join(extracted.select("parent_asin", "pack", "confidence", "flag", F.lit(True).alias("_there")), "parent_asin", "left")
    bad = rows.where("_truth.kind IS NULL OR _there IS NULL").select("audit_id", "truth", "_there").orderBy("audit_id").limit(5).collect()
    if bad:
        raise LabelError("; ".join(f"audit_id {r[0]}: {'no such item' if r[2] is None else f'truth {r[1]!r}'}" for r in bad))
    t, p = F.col("_truth"), F.col("pack")
    total, each = t["count"] * t["size"] * factor(t["unit"]), t["size"] * factor(t["unit"])
    same = (p["dimension"] == dimension(t["unit"])) & (F.abs(p["total_base"] - total) <= F.lit(NEAR) * total)
    one_piece = (p["dimension"] == "count") & (F.abs(p["total_base"] - 1) < 1e-9)
    right = F.when(t["kind"] == "none", False).when(t["kind"] == "na", one_piece).otherwise(same)
    verdict = F.when(p.isNull(), "abstained").when(F.coalesce(right, F.lit(False)), "correct").otherwise("wrong")
    exact = (verdict == "correct") & (t["kind"] == "size") & (F.abs(p["count"] - t["count"]) < 1e-9) & (F.abs(p["size"] * factor(p["unit"]) - each) <= F.lit(NEAR) * each)
    short = lambda x: F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    shown = F.when(p.isNotNull(), F.concat_ws(" ", short(p["count"]), F.lit("x"), short(p["size"]), p["unit"]))
    return rows.select(
        *labels.columns, t["kind"].alias("truth_kind"), verdict.alias("verdict"), F.coalesce(exact, F.lit(False)).alias("exact"), shown.alias("extracted"), "confidence", "flag"
    )


def score_report(rows: DataFrame, format_limited: tuple[str, ...] = ()) -> DataFrame:
    """One row: counts, coverage, and precision with its interval for all labels, without N/A, and without the ids that
    no label can express; and whether precision reaches the guardrail. One pass over the labels."""
    returned, right = F.col("verdict") != "abstained", F.col("verdict") == "correct"
    limited = F.coalesce(F.col("audit_id").cast("string").isin(*format_limited), F.lit(False)) if format_limited else F.lit(False)
    subsets = {"all": F.lit(True), "no_na": F.col("truth_kind") != "na", "expressible": ~limited}
    counts = [
        F.count("*").alias("n_labelled"),
        F.count_if(returned).alias("n_returned"),
        *[F.count_if(F.col("truth_kind") == k).alias(f"truth_{k}") for k in ("size", "none", "na")],
        *[x for k, s in subsets.items() for x in (F.count_if(s & returned).alias(f"returned_{k}"), F.count_if(s & right).alias(f"correct_{k}"))],
        F.count_if(F.col("exact")).alias("exact_matches"),
        F.count_if((F.col("truth_kind") == "size") & ~returned).alias("labelled_but_abstained"),
        F.count_if((F.col("truth_kind") == "none") & (F.col("verdict") == "wrong")).alias("returned_where_none"),
    ]
    out = rows.agg(*counts).withColumn("coverage", F.try_divide("n_returned", "n_labelled"))
    for k in subsets:
        low, high = wilson(F.col(f"correct_{k}"), F.col(f"returned_{k}"))
        out = out.withColumns({f"precision_{k}": F.try_divide(f"correct_{k}", f"returned_{k}"), f"low_{k}": low, f"high_{k}": high})
    return out.withColumn("passes_guardrail", F.coalesce(F.col("precision_all"), F.lit(0.0)) >= GUARDRAIL)


def coverage(extracted: DataFrame) -> DataFrame:
    """Items by dimension returned, or by reason to abstain, the commonest first."""
    return extracted.groupBy(F.col("pack.dimension").alias("dimension"), "flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dimension", "flag")


def coverage_total(extracted: DataFrame) -> DataFrame:
    """One row: items, those with a pack size, and their share."""
    out = extracted.agg(F.count("*").alias("n_items"), F.count("pack").alias("extracted"))
    return out.withColumn("coverage", F.try_divide("extracted", "n_items"))


def membership_scores(labels: DataFrame, *by: str) -> DataFrame:
    """Shares of labels (column in_set, yes or no) with Wilson intervals, by group: of all labels (share, low, high), and without
    those whose notes say UNCERTAIN (share_sure, low_sure, high_sure)."""
    yes = F.lower(F.trim(F.col("in_set"))) == "yes"
    sure = ~F.coalesce(F.col("notes").contains("UNCERTAIN"), F.lit(False))
    out = labels.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(yes).alias("yes"), F.count_if(sure).alias("n_sure"), F.count_if(sure & yes).alias("yes_sure"))
    for k in ("", "_sure"):
        low, high = wilson(F.col(f"yes{k}"), F.col(f"n{k}"))
        out = out.withColumns({f"share{k}": F.try_divide(f"yes{k}", f"n{k}"), f"low{k}": low, f"high{k}": high})
    return out


def recall_loss(scores: DataFrame, group_sizes: DataFrame, by: str = "query") -> DataFrame:
    """The share of yes labels in a sample, scaled to the group it was drawn from."""
    return scores.join(group_sizes, by).withColumn("lost", F.col("share") * F.col("group_size"))
