"""Candidate sets by phrase, and what exclusion terms and word order cost."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmetrics.functions.phrases import any_order, phrase_pattern, term_pattern


@dataclass(frozen=True)
class Rules:
    """Queries, terms that exclude from any set, and terms that exclude from one."""

    queries: tuple[str, ...]
    exclude_all: tuple[str, ...] = ()
    exclude_per_query: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def terms(self, query: str) -> tuple[str, ...]:
        return (*self.exclude_all, *self.exclude_per_query.get(query, ()))


def match(items: DataFrame, rules: Rules, title: str = "title") -> DataFrame:
    """(query, item) for every title with a query's phrase, with the terms that hit, in the rules' order, and kept.

    Patterns are literals, compiled once, and one pass over the items serves all queries: no join. Null titles
    match nothing. A title may match several queries.
    """
    text = F.coalesce(F.col(title), F.lit(""))

    def one(query: str) -> Column:
        terms = F.array(*[F.when(text.rlike(term_pattern(t)), F.lit(t)) for t in rules.terms(query)]) if rules.terms(query) else F.array().cast("array<string>")
        return F.when(text.rlike(phrase_pattern(query)), F.struct(F.lit(query).alias("query"), F.filter(terms, lambda t: t.isNotNull()).alias("hits")))

    found = F.explode(F.filter(F.array(*[one(q) for q in rules.queries]), lambda m: m.isNotNull()))
    out = items.select(*items.columns, found.alias("_m"))
    return out.select("_m.query", *items.columns, "_m.hits", (F.size("_m.hits") == 0).alias("kept"))


def adjacency_lost(items: DataFrame, queries: tuple[str, ...], title: str = "title") -> DataFrame:
    """(query, item) for titles with every word of a query, in any order, but not its phrase."""
    text = F.coalesce(F.col(title), F.lit(""))
    lost = [F.when(any_order(text, q) & ~text.rlike(phrase_pattern(q)), F.lit(q)) for q in queries]
    found = F.explode(F.filter(F.array(*lost), lambda q: q.isNotNull()))
    return items.select(found.alias("query"), *items.columns)
