"""Typed settings from JSON files."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from shelfmetrics.operators.matching import Rules


@dataclass(frozen=True)
class Sweep:
    """The grid of the sensitivity report."""

    m_values: tuple[int, ...] = (25, 50, 120, 500)
    c_sources: tuple[str, ...] = ("C_simple", "C_weighted")
    top: int = 20

    def __post_init__(self) -> None:
        if not self.m_values or min(self.m_values) <= 0 or not set(self.c_sources) <= {"C_simple", "C_weighted"} or self.top < 1:
            raise ValueError(f"not a sweep: {self}")


@dataclass(frozen=True)
class Audit:
    """The matcher's audits: rules, seed and quotas."""

    rules: Rules
    seed: int
    kept: int
    excluded: int
    recall_queries: tuple[str, ...] = ()
    recall_each: int = 20
    most_published: int = 50
    roles: dict[str, str] = field(default_factory=dict)


def _read(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def load_sweep(path: str | Path) -> Sweep:
    found = _read(path)
    return Sweep(tuple(found["m_values"]), tuple(found["C_sources"]), found["top_k"])


def load_threshold(path: str | Path) -> float:
    value = float(_read(path)["confidence_threshold"])
    if not 0 <= value <= 1:
        raise ValueError(f"{path}: a threshold of {value} is no share")
    return value


def load_format_limited(path: str | Path) -> frozenset[str]:
    """Ids of labels that no label can express; none without a file."""
    return frozenset(map(str, _read(path)["audit_ids"])) if Path(path).exists() else frozenset()


def load_audit(path: str | Path) -> Audit:
    """Queries, exclusion terms and quotas of a registered audit."""
    found = _read(path)
    matcher, first, second = found["matcher"], found["contamination_audit"], found.get("recall_audit", {})
    rules = Rules(
        tuple(q["query"] for q in found["queries"]), tuple(matcher["exclude_all"]), {q: tuple(terms) for q, terms in matcher["exclude_per_query"].items()}
    )
    return Audit(
        rules, found["seed"], first["per_query_kept_sample"], first["per_query_excluded_sample"], tuple(second.get("queries", ())), second.get("per_query_sample", 20),
        found.get("publication", {}).get("max_items_per_set", 50), {q["query"]: q.get("role", "") for q in found["queries"]},
    )
