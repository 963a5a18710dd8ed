"""Reports of the rating's sensitivity, as data and as a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sweep as grid
from .ratings import compute_priors


def tidy(title: str, most: int = 55) -> str:
    """A title for a table's cell: no bars, and an ellipsis beyond the given length."""
    plain = title.replace("|", "/")
    return plain[:most] + ("…" if len(plain) > most else "")


def sensitivity(items: DataFrame, m_values: tuple[int, ...] = (25, 50, 120, 500), sources: tuple[str, ...] = ("C_simple", "C_weighted"), top: int = 20) -> dict:
    """All that the sensitivity report says of the priced pool. Every table in it has some dozens of rows."""
    priors = compute_priors(items).first()
    tops = grid.sweep(items, top, m_values, sources).persist()
    try:
        rows = tops.orderBy("combo", "rank").collect()
        combos = [f"{grid.LABELS[s]} C, m={m}" for s in sources for m in m_values]
        shared = {(r.a, r.b): r.shared for r in grid.overlaps(tops).collect()}
        distinct = {r.combo: r for r in grid.resolution(items, m_values, sources).collect()}
        stars = grid.by_stars(items, top).collect()
        against = {r.combo: r for r in grid.star_overlap(items, tops, top).collect()}
        order = [r.parent_asin for r in grid.rank_table(tops, combos).select("place", "parent_asin").distinct().orderBy("place").collect()]
    finally:
        tops.unpersist()
    some = next(iter(distinct.values()), None)
    return {
        "n_items": items.count(),
        "n_rated": priors.n_rated,
        "top_k": top,
        "C_values": {s: priors[s] for s in sources},
        "combos": [
            {
                "id": c,
                "distinct_car": distinct[c].distinct_car,
                "distinct_car_at_2dp": distinct[c].distinct_car_2dp,
                "top": [{k: r[k] for k in ("rank", "parent_asin", "title", "average_rating", "rating_number", "car")} for r in rows if r.combo == c],
            }
            for c in combos
        ],
        "pairwise_overlap": {a: {b: shared[a, b] for b in combos} for a in combos},
        "distinct_star_ratings": some.distinct_stars if some else 0,
        "distinct_rating_and_count_pairs": some.distinct_pairs if some else 0,
        "star_sort": {
            "top": [{k: r[k] for k in ("parent_asin", "average_rating", "rating_number")} for r in stars],
            "median_rating_number_in_top": next((r.upper_median_count for r in against.values()), None),
            "overlap_with_each_combo": {c: against[c].shared for c in combos},
        },
        "order": order,
    }


def table(head: list[str], rows: list[list]) -> str:
    cell = lambda x: "" if x is None else f"{x:,}" if isinstance(x, int) else str(x)
    return "\n".join([f"| {' | '.join(head)} |", "|" + "---|" * len(head), *[f"| {' | '.join(map(cell, r))} |" for r in rows]])


def sensitivity_document(report: dict, name: str) -> str:
    """The report as Markdown: overlaps of all pairs, the star sort, distinct values, and all ranks."""
    combos, k = [c["id"] for c in report["combos"]], report["top_k"]
    stars = report["star_sort"]
    ranks = {c["id"]: {r["parent_asin"]: r["rank"] for r in c["top"]} for c in report["combos"]}
    known = {r["parent_asin"]: r for c in report["combos"] for r in c["top"]}
    values = ", ".join(f"{s} = {v:.4f}" if v is not None else f"{s}: none" for s, v in report["C_values"].items())
    parts = [
        f"# How the top {k} of {name} moves with the prior",
        f"{report['n_items']:,} priced items, {report['n_rated']:,} of them rated. Prior means: {values}.",
        f"## Items shared by the first {k} of each pair of settings",
        table(["", *combos], [[a, *("—" if a == b else report["pairwise_overlap"][a][b] for b in combos)] for a in combos]),
        f"## Items shared with the first {k} by stars",
        f"The upper median number of ratings among these is {stars['median_rating_number_in_top'] or 0:,}.",
        table(["Setting", "Shared"], [[c, f"{stars['overlap_with_each_combo'][c]} / {k}"] for c in combos]),
        "## Distinct values",
        f"{report['distinct_star_ratings']:,} star ratings and {report['distinct_rating_and_count_pairs']:,} pairs of rating and count, on which alone the adjusted rating depends.",
        table(["Setting", "Adjusted ratings", "At two decimals"], [[c["id"], c["distinct_car"], c["distinct_car_at_2dp"]] for c in report["combos"]]),
        f"## Ranks of all items that reach a top {k}",
        table(
            ["Item", "Title", "Rating", "Ratings", *combos],
            [[a, tidy(known[a]["title"]), known[a]["average_rating"], known[a]["rating_number"], *(ranks[c].get(a) for c in combos)] for a in report["order"]],
        ),
    ]
    return "\n\n".join(parts) + "\n"


def pool_coverage(extracted: DataFrame) -> dict:
    """How many items have a pack size, and their share, by dimension and by reason to abstain, the commonest first."""
    counts = extracted.groupBy(F.col("pack.dimension").alias("dimension"), "flag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dimension", "flag").collect()
    total, found = sum(r.n for r in counts), sum(r.n for r in counts if r.dimension)
    by_dimension: dict[str, int] = {}
    for r in counts:
        if r.dimension:
            by_dimension[r.dimension] = by_dimension.get(r.dimension, 0) + r.n
    return {
        "n_items": total, "extracted": found, "coverage": found / total if total else None, "by_dimension": by_dimension,
        "abstain_reasons": {r.flag: r.n for r in counts if not r.dimension},
    }
