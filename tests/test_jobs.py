"""All jobs, one after another, on a small category of their own."""

import csv
import json
import random

import pytest

from shelfmetrics import jobs
from shelfmetrics.operators import report
from shelfmetrics.sources import config, load


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    root = tmp_path_factory.mktemp("jobs")
    at = jobs.Places("Toys", *(str(root / x) for x in ("data", "reports", "audit", "config")))
    for folder in (at.data, at.settings):
        (root / folder).mkdir()
    rng = random.Random(5)
    kinds = ["gear, {k} oz", "gear holder", "ring gear | {k} count", "key ring, pack of {k}", "long title " * 9 + "gear"]
    rows = [
        {"parent_asin": f"P{k:03}", "title": kinds[k % 5].format(k=k % 7 + 2), "price": [9.5 + k, None, "from $3", 12][k % 4], "average_rating": round(rng.uniform(1, 5), 1), "rating_number": rng.randint(1, 400), "details": {"Unit Count": "3"}}
        for k in range(200)
    ]
    (root / "data/meta_Toys.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (root / "config/sweep.json").write_text(json.dumps({"m_values": [10, 100], "C_sources": ["C_simple"], "top_k": 5}))
    (root / "config/pack_sizes.json").write_text(json.dumps({"confidence_threshold": 0.7}))
    (root / "config/audit.json").write_text(
        json.dumps(
            {
                "seed": 3, "queries": [{"query": "gear", "role": "primary"}, {"query": "key ring"}], "matcher": {"exclude_all": ["holder"], "exclude_per_query": {"key ring": ["chain"]}},
                "contamination_audit": {"per_query_kept_sample": 4, "per_query_excluded_sample": 2}, "recall_audit": {"queries": ["gear ring"], "per_query_sample": 3},
            }
        )
    )
    return at


def test_jobs(spark, at):
    made = jobs.ingest(spark, at)
    assert made["rows_written"] == 200 and jobs.ingest(spark, at) is None
    found = jobs.load_report(spark, at)
    assert (found["rows_loaded"], found["priced"], found["price_null_reasons"]["missing"], found["price_null_total"]) == (200, 100, 50, 100)
    assert jobs.profile_report(spark, at)["price"]["n"] == 100 and at.report("profile", "md").exists()
    assert 1 < jobs.priors(spark, at)["C_simple"] < 5
    swept = jobs.sensitivity(spark, at)
    assert [c["id"] for c in swept["combos"]] == ["simple C, m=10", "simple C, m=100"] and all(len(c["top"]) == 5 for c in swept["combos"])
    document = at.report("sensitivity", "md").read_text()
    assert "simple C, m=100" in document and "| —" in document and not any(len(line) > 400 for line in document.split("\n"))
    assert jobs.pack_score(spark, at, coverage_only=True)["n_items"] == 100
    assert jobs.match_audit(spark, at) == {"gear": 6, "key ring": 4} and jobs.match_audit(spark, at, recall=True) == {"gear ring": 3}


def test_pack_labels(spark, at):
    assert jobs.pack_audit(spark, at) == 100
    path = f"{at.audits}/pack_sizes.csv"
    with open(path, newline="", encoding="utf-8-sig") as f:
        rows = list(csv.DictReader(f))
    assert rows[0]["audit_id"] == "1" and rows[0]["unit_count"] == "3"
    for r in rows:
        r["truth"] = "none" if "holder" in r["title"] else "N/A"
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        out = csv.DictWriter(f, rows[0].keys())
        out.writeheader()
        out.writerows(rows)
    scored = jobs.pack_score(spark, at)
    assert scored["n_labelled"] == 100 and scored["extracted"] > 0
    with pytest.raises(FileExistsError):
        jobs.pack_audit(spark, at)


def test_settings(at, tmp_path):
    audit = config.load_audit(at.setting("audit"))
    assert audit.rules.terms("key ring") == ("holder", "chain") and audit.most_published == 50
    assert config.load_threshold(at.setting("pack_sizes")) == 0.7 and config.load_format_limited(tmp_path / "none.json") == frozenset()
    (tmp_path / "x.json").write_text(json.dumps({"confidence_threshold": 7, "m_values": [0], "C_sources": ["C_simple"], "top_k": 3, "audit_ids": [3]}))
    assert config.load_format_limited(tmp_path / "x.json") == {"3"}
    for wrong in (config.load_threshold, config.load_sweep):
        with pytest.raises(ValueError):
            wrong(tmp_path / "x.json")


def test_tidy_titles():
    assert report.tidy("a|b") == "a/b" and report.tidy("x" * 56) == "x" * 55 + "…" and report.tidy("x" * 55) == "x" * 55


def test_load_refuses_after_bad_lines(spark, at, tmp_path):
    (tmp_path / "meta_Toys.jsonl").write_text("nope")
    bad = jobs.Places("Toys", str(tmp_path), str(tmp_path), str(tmp_path), str(tmp_path))
    jobs.ingest(spark, bad)
    with pytest.raises(load.MalformedRows, match="1 source lines"):
        jobs.load_report(spark, bad)


def test_every_job_has_a_command(capsys):
    with pytest.raises(SystemExit):
        jobs.main(["--help"])
    shown = capsys.readouterr().out
    assert all(name in shown for name in jobs.JOBS)
