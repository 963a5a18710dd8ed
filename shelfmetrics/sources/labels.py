"""Label and audit files, configuration and stored priors."""

from __future__ import annotations

import csv
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from shelfmetrics.operators.ratings import LEAST_RATED

ROLE = f"fallback_only_when_candidate_set_lt_{LEAST_RATED}"


class LabelError(ValueError):
    """A label file that can't be scored."""


def has_labels(path: str | Path, column: str = "truth") -> bool:
    """Whether any cell of the column is filled in."""
    if not Path(path).exists():
        return False
    with open(path, newline="", encoding="utf-8-sig") as f:
        return any((row.get(column) or "").strip() for row in csv.DictReader(f))


def read_labels(spark: SparkSession, path: str, column: str = "truth") -> DataFrame:
    """A label CSV, which may begin with a byte order mark and have line breaks in quotes; partial labels are refused."""
    labels = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    empty = labels.where(f"`{column}` IS NULL OR trim(`{column}`) = ''")
    if found := empty.count():
        first = [r[0] for r in empty.orderBy("audit_id").limit(5).select("audit_id").collect()]
        raise LabelError(f"{found} rows have no {column} (audit_id {', '.join(map(str, first))}); refusing to score a partial audit")
    return labels


def write_audit(rows: DataFrame, path: str | Path, blank: tuple[str, ...], label: str) -> int:
    """Writes a sample as CSV with a byte order mark and blank columns to fill in; never over a file with labels."""
    if has_labels(path, label):
        raise FileExistsError(f"{path} has labels; refusing to overwrite")
    found = rows.orderBy("audit_id").collect()  # a sample of a few hundred rows
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        out = csv.writer(f)
        out.writerow([*rows.columns, *blank])
        out.writerows([*r, *[""] * len(blank)] for r in found)
    return len(found)


def write_fallback(priors: dict, path: str | Path) -> None:
    Path(path).write_text(json.dumps({"role": ROLE, "min_candidate_set": LEAST_RATED, **priors}, indent=2))


def load_fallback(path: str | Path) -> dict:
    """Stored priors; a file of another role is refused."""
    found = json.loads(Path(path).read_text())
    if found.get("role") != ROLE:
        raise ValueError(f"{path} isn't a file of fallback priors")
    return found


def load_json(path: str | Path, default: object = None) -> object:
    return json.loads(Path(path).read_text()) if Path(path).exists() or default is None else default


def write_report(rows: DataFrame, path: str | Path) -> None:
    """A small result as a JSON list of objects."""
    Path(path).write_text(json.dumps([json.loads(r) for r in rows.toJSON().collect()], indent=2, ensure_ascii=False))
