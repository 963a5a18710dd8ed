"""The pipeline's jobs, as functions and as ``python -m shelfmetrics.jobs JOB --help``.

Data are in ``<data>/meta_<category>.slim.parquet`` beside a manifest, results in a folder of reports, label files in one of audits.
"""

from __future__ import annotations

import argparse
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmetrics.functions.packsize import extract_pack_sizes
from shelfmetrics.operators import matching, profile, ratings, report, sampling, scoring
from shelfmetrics.sources import config, labels, load
from shelfmetrics.sources import ingest as sink


@dataclass(frozen=True)
class Places:
    """Where a category's files are."""

    category: str = "catalogue"
    data: str = "data/raw"
    reports: str = "reports"
    audits: str = "audit"
    settings: str = "config"

    @property
    def slim(self) -> str:
        return f"{self.data}/meta_{self.category}.slim.parquet"

    @property
    def manifest(self) -> str:
        return f"{self.slim}.manifest.json"

    def report(self, name: str, suffix: str = "json") -> Path:
        Path(self.reports).mkdir(parents=True, exist_ok=True)
        return Path(self.reports) / f"{name}_{self.category}.{suffix}"

    def setting(self, name: str) -> Path:
        return Path(self.settings) / f"{name}.json"


def _write(path: Path, data: dict) -> dict:
    path.write_text(json.dumps(data, indent=2, ensure_ascii=False, default=str))
    return data


def _items(spark: SparkSession, at: Places) -> load.Loaded:
    return load.load_items(spark, at.slim, at.manifest)


def _pool(spark: SparkSession, at: Places) -> DataFrame:
    return load.priced(_items(spark, at).items)


def ingest(spark: SparkSession, at: Places, source: str | None = None, size: int | None = None, sha256: str | None = None, overwrite: bool = False) -> dict | None:
    """JSON lines to slim Parquet. With a size and a checksum, another source is refused."""
    expected = (size, sha256) if size is not None and sha256 else None
    return sink.ingest(spark, source or f"{at.data}/{Path(sink.source_name(at.category)).name}", at.slim, expected, overwrite)


def load_report(spark: SparkSession, at: Places) -> dict:
    """Checks every row, and writes what was read, dropped, priced, and why prices are missing."""
    row = _items(spark, at).report.first().asDict()
    reasons = {k.removeprefix("price_"): v for k, v in row.items() if k.startswith("price_")}
    return _write(at.report("load"), {**{k: v for k, v in row.items() if not k.startswith("price_")}, "price_null_reasons": reasons, "price_null_total": sum(reasons.values())})


def profile_report(spark: SparkSession, at: Places) -> dict:
    """The raw catalogue's statistics, as data and as a document."""
    raw = spark.read.schema(load.RAW).parquet(at.slim)
    prices, stars = profile.profile_prices(raw).first().asDict(), profile.profile_ratings(raw).first().asDict()
    bins = {r.label: r.n for r in profile.price_histogram(raw).orderBy("bin").collect()}
    texts = {r.price_text: r.n for r in profile.price_texts(raw).collect()}
    document = "\n".join(profile.markdown(rows, f"{at.category}: {name}") for name, rows in (("prices", prices), ("ratings", stars), ("prices by bin", bins)))
    at.report("profile", "md").write_text(document)
    return _write(at.report("profile"), {"price": prices, "rating": stars, "price_histogram": bins, "price_texts": texts})


def priors(spark: SparkSession, at: Places) -> dict:
    """The priced pool's priors, for candidate sets that are too small for their own."""
    row = ratings.compute_priors(ratings.refuse_contradictions(_pool(spark, at))).first()
    found = {"C_simple": row.C_simple, "C_weighted": row.C_weighted, "m_median": row.m_median, "n_items": row.n_rated}
    labels.write_fallback(found, at.report("priors_fallback"))
    return found


def sensitivity(spark: SparkSession, at: Places) -> dict:
    """How the top moves with the prior, as data and as a document."""
    grid = config.load_sweep(at.setting("sweep")) if at.setting("sweep").exists() else config.Sweep()
    found = report.sensitivity(_pool(spark, at), grid.m_values, grid.c_sources, grid.top)
    at.report("sensitivity", "md").write_text(report.sensitivity_document(found, at.category))
    return _write(at.report("sensitivity"), {"category": at.category, **found})


def pack_audit(spark: SparkSession, at: Places) -> int:
    """A sample of priced items to label with their pack sizes; never over labels."""
    sample = sampling.audit_sample(_pool(spark, at))
    rows = load.detail_columns(sample).join(sample.select("audit_id", "parent_asin"), "parent_asin")
    return labels.write_audit(rows.select("audit_id", *[c for c in rows.columns if c != "audit_id"]), Path(at.audits) / "pack_sizes.csv", ("truth", "notes"), "truth")


def pack_score(spark: SparkSession, at: Places, coverage_only: bool = False) -> dict:
    """Coverage of the pool, and the score of extracted pack sizes against labels."""
    threshold = config.load_threshold(at.setting("pack_sizes")) if at.setting("pack_sizes").exists() else 0.7
    packs = extract_pack_sizes(_pool(spark, at), threshold).persist()
    try:
        found = {"threshold": threshold, **_write(at.report("pack_coverage"), report.pool_coverage(packs))}
        if not coverage_only:
            truth = labels.read_labels(spark, str(Path(at.audits) / "pack_sizes.csv"))
            rows = scoring.judged(truth.select("audit_id", "parent_asin", "truth"), packs).persist()
            limited = tuple(sorted(config.load_format_limited(Path(at.audits) / "format_limited.json")))
            score = scoring.score_report(rows, limited).first().asDict()
            wrong = [r.asDict() for r in rows.where("verdict = 'wrong'").orderBy("audit_id").collect()]  # of a sample
            found |= _write(at.report("pack_precision"), {**score, "errors": wrong})
            rows.unpersist()
    finally:
        packs.unpersist()
    return found


def match_audit(spark: SparkSession, at: Places, recall: bool = False) -> dict[str, int]:
    """A sample of each query's kept and excluded titles, or of those that the phrase rule loses, to label. Returns rows by query."""
    audit = config.load_audit(at.setting("audit"))
    pool = _pool(spark, at)
    if recall:
        sample = sampling.recall_sample(matching.adjacency_lost(pool, audit.recall_queries), audit.recall_queries, audit.seed, audit.recall_each)
    else:
        sample = sampling.contamination_sample(matching.match(pool, audit.rules), audit.rules.queries, audit.seed, audit.kept, audit.excluded)
    labels.write_audit(sample, Path(at.audits) / ("recall.csv" if recall else "membership.csv"), ("in_set", "notes"), "in_set")
    return {r["query"]: r["n"] for r in sampling.rows_per_query(sample).orderBy(F.desc("n"), "query").collect()}


JOBS = {
    "ingest": ingest, "load": load_report, "profile": profile_report, "priors": priors, "sensitivity": sensitivity, "pack-audit": pack_audit, "pack-score": pack_score, "match-audit": match_audit,
}


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="shelfmetrics.jobs", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, job in JOBS.items():
        own = jobs.add_parser(name, help=job.__doc__, description=job.__doc__)
        for field, default in Places.__dataclass_fields__.items():
            own.add_argument(f"--{field}", default=default.default)
        if job is ingest:
            own.add_argument("--source")
            own.add_argument("--size", type=int)
            own.add_argument("--sha256")
            own.add_argument("--overwrite", action="store_true")
        elif job is pack_score:
            own.add_argument("--coverage-only", action="store_true")
        elif job is match_audit:
            own.add_argument("--recall", action="store_true")
    given = vars(parser.parse_args(arguments))
    job = JOBS[given.pop("job")]
    at = Places(**{f: given.pop(f) for f in Places.__dataclass_fields__})
    spark = SparkSession.builder.appName("shelfmetrics").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    print(json.dumps(job(spark, at, **given), indent=2, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
