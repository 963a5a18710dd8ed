import json

import pytest
from pyspark.sql import functions as F

from shelfmetrics.functions.decoding import json_kind
from shelfmetrics.functions.phrases import phrase_pattern, term_pattern
from shelfmetrics.operators import matching, sampling, scoring, sweep
from shelfmetrics.sources import ingest, labels, load

GOOD = ("P1", "Oat bars", "19.5", "4.2", "87", "{}")


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), load.RAW)


def row(**changes):
    return tuple(changes.get(f, v) for f, v in zip(load.FIELDS, GOOD, strict=True))


@pytest.mark.parametrize(
    ("price", "value", "reason"), [("19.5", 19.5, None), ("7", 7.0, None), ("null", None, "missing"), ("0", None, "non_positive"), ('"—"', None, "dash"), ('"from 8.00"', None, "from_range"), ('" from $8 "', None, "from_range")]
)
def test_price_ladder(spark, price, value, reason):
    got = load.decoded(raw(spark, row(price=price))).first()
    assert (got["_price"], got["price_null_reason"], got["errors"]) == (value, reason, [])


@pytest.mark.parametrize(
    "bad",
    [
        {"price": '"12.99"'}, {"price": "true"}, {"price": "12 USD"}, {"price": None}, {"average_rating": "5.5"}, {"average_rating": '"4"'}, {"average_rating": "{"}, {"rating_number": "-1"},
        {"rating_number": "1.5"}, {"rating_number": '"3"'}, {"details": "[]"}, {"details": "null"}, {"parent_asin": ""}, {"title": None},
    ],
)
def test_bad_rows_are_all_reported(spark, bad):
    with pytest.raises(load.MalformedRows) as found:
        load.load_items(spark, raw(spark, row(**bad), row(price='["x"]', parent_asin="P9"), GOOD))
    assert found.value.count == 2


def test_blank_titles_are_counted_not_errors(spark):
    loaded = load.load_items(spark, raw(spark, GOOD, row(title=" \t\n", price="[]"), row(price="null")))
    report = loaded.report.first()
    assert (report["rows_read"], report["rows_loaded"], report["empty_titles"], report["priced"], report["price_missing"]) == (3, 2, 1, 1, 1)


def test_missing_column_and_gate(spark, tmp_path):
    with pytest.raises(ValueError, match="details"):
        load.decoded(raw(spark, GOOD).drop("details"))
    (tmp_path / "m.json").write_text(json.dumps({"unparseable_json_lines": 2}))
    with pytest.raises(ValueError, match="2 source lines"):
        load.gate(tmp_path / "m.json")
    load.gate(tmp_path / "none.json")


def test_trailing_text_is_bad_json(spark):
    kinds = spark.createDataFrame([(x,) for x in ("1 x", "1", '"a"', "", None)], "c string").select(json_kind(F.col("c"))).collect()
    assert [k[0] for k in kinds] == ["bad", "integer", "string", "bad", "missing"]


@pytest.mark.parametrize(
    ("query", "title", "hit"),
    [
        ("baby wipes", "Baby-Wipe refill", True), ("baby wipes", "wipes for baby", False), ("vitamin d", "Vitamin D3 drops", True), ("vitamin d", "Vitamin D-3", True), ("vitamin d", "Vitamin D 3", True),
        ("vitamin d", "vitamin dx", False), ("creatine", "microcreatine", False), ("dish soap", "Dish  soaps!", True),
    ],
)
def test_phrases(spark, query, title, hit):
    assert spark.createDataFrame([(title,)], "t string").select(F.col("t").rlike(phrase_pattern(query))).first()[0] == hit


def test_terms_are_literal(spark):
    got = spark.createDataFrame([("Case of 12",), ("cases",)], "t string").select(F.col("t").rlike(term_pattern("case"))).collect()
    assert [r[0] for r in got] == [True, False]


def test_match_and_samples_ignore_partitioning(spark):
    rules = matching.Rules(("gear", "ring"), ("holder",), {"ring": ("key",)})
    rows = [(f"P{k:03}", f"{['blue gear', 'gear holder', 'key ring', 'ring'][k % 4]} {k}") for k in range(80)]
    items = spark.createDataFrame(rows, "parent_asin string, title string")
    found = matching.match(items, rules)
    assert {(r["query"], r["kept"]): r["n"] for r in found.groupBy("query", "kept").agg(F.count("*").alias("n")).collect()} == {("gear", True): 20, ("gear", False): 20, ("ring", True): 20, ("ring", False): 20}
    draws = [[tuple(r) for r in sampling.contamination_sample(matching.match(items.repartition(n), rules), rules.queries, kept=5, excluded=3).orderBy("audit_id").collect()] for n in (1, 7)]
    assert draws[0] == draws[1] and len(draws[0]) == 16


def test_overlaps_are_symmetric(spark):
    rows = [(f"P{k:03}", f"t{k}", 1.0 + k % 40 / 10, (k * 7) % 300 + 1) for k in range(200)]
    items = spark.createDataFrame(rows, "parent_asin string, title string, average_rating double, rating_number long")
    shared = {(r["a"], r["b"]): r["shared"] for r in sweep.overlaps(sweep.sweep(items, 10)).collect()}
    assert len(shared) == 64 and all(shared[a, b] == shared[b, a] for a, b in shared) and all(n == 10 for (a, b), n in shared.items() if a == b)


def test_truth_labels(spark):
    got = spark.createDataFrame([(x,) for x in ("2 x 1.5 FL OZ", "none", " N/A ", "2 x 3 mg")], "t string").select(scoring.parse_truth(F.col("t")).alias("s")).collect()
    assert [r["s"]["kind"] for r in got] == ["size", "none", "na", None]
    assert got[0]["s"]["unit"] == "fl oz"


def test_ingest_round_trip(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text('{"parent_asin": "P1", "title": "Té", "price": 5.5, "details": {"Size": "1 oz"}}\n\nnot json\n{"parent_asin": "P2", "title": "x", "price": "from $3", "average_rating": 4, "rating_number": 2, "details": {}}\n')
    made = ingest.ingest(spark, str(source), str(tmp_path / "out.parquet"))
    assert (made["rows_written"], made["unparseable_json_lines"], made["unparseable_examples"]) == (2, 1, [[3, "not JSON: not json"]])
    assert ingest.ingest(spark, str(source), str(tmp_path / "out.parquet")) is None
    with pytest.raises(ValueError, match="published"):
        ingest.ingest(spark, str(source), str(tmp_path / "other.parquet"), expected=(1, "0"))
    rows = {r["parent_asin"]: r for r in spark.read.parquet(str(tmp_path / "out.parquet")).collect()}
    assert (rows["P1"]["title"], rows["P1"]["price"], rows["P1"]["average_rating"], rows["P2"]["price"]) == ("Té", "5.5", "null", '"from $3"')


def test_label_files(spark, tmp_path):
    path = tmp_path / "labels.csv"
    sample = spark.createDataFrame([(1, "P1", 'A "q"\nline')], "audit_id int, parent_asin string, title string")
    assert labels.write_audit(sample, path, ("truth", "notes"), "truth") == 1
    with pytest.raises(labels.LabelError, match="1 rows"):
        labels.read_labels(spark, str(path))
    path.write_text(path.read_text(encoding="utf-8-sig").rstrip("\r\n,") + ",1 x 2 oz,\n", encoding="utf-8-sig")
    with pytest.raises(FileExistsError):
        labels.write_audit(sample, path, ("truth", "notes"), "truth")
    labels.write_fallback({"C_simple": 4.2, "m_median": 50}, tmp_path / "f.json")
    assert labels.load_fallback(tmp_path / "f.json")["m_median"] == 50
    (tmp_path / "g.json").write_text("{}")
    with pytest.raises(ValueError):
        labels.load_fallback(tmp_path / "g.json")


def test_ingest_keeps_types_and_texts(spark, tmp_path):
    lines = [
        '{"parent_asin": "P1", "title": "a", "price": 12.0, "average_rating": 4.5, "rating_number": 12.0, "details": {"b": 1.0, "a": "é", "c": [1, 2]}}',
        '{"parent_asin": "P2", "title": "b", "price": "5", "average_rating": 4, "rating_number": 12, "details": {}, "price": "7"}',
        "5", "[1]", '{"parent_asin": 7, "title": "c", "price": null}', '{"price": 1} x', "   ", '{"parent_asin": "P4", "title": "d", "price": 12345678901234567890, "details": {"k": 1, "k": 2}}',
    ]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    made = ingest.ingest(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out.parquet"))
    assert (made["rows_written"], made["unparseable_json_lines"]) == (4, 3)
    assert made["unparseable_examples"] == [[3, "not an object: 5"], [4, "not an object: [1]"], [6, 'not JSON: {"price": 1} x']]
    rows = {r["title"]: r for r in spark.read.parquet(str(tmp_path / "out.parquet")).collect()}
    assert (rows["a"]["price"], rows["a"]["rating_number"], rows["a"]["details"]) == ("12.0", "12.0", '{"b":1.0,"a":"é","c":[1,2]}')
    assert (rows["b"]["price"], rows["b"]["rating_number"], rows["c"]["parent_asin"], rows["c"]["price"]) == ('"7"', "12", None, "null")
    assert (rows["d"]["price"], rows["d"]["average_rating"], json.loads(rows["d"]["details"])) == ("12345678901234567890", "null", {"k": 2})
    with pytest.raises(load.MalformedRows) as found:
        load.load_items(spark, str(tmp_path / "out.parquet"))
    assert any("not a whole number" in m for _, _, errors in found.value.first for m in errors)
    # a failed check leaves what is there alone, and overwriting replaces it
    with pytest.raises(ValueError, match="published"):
        ingest.ingest(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out.parquet"), expected=(1, "0"), overwrite=True)
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 4
    (tmp_path / "in.jsonl").write_text(lines[1])
    assert ingest.ingest(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out.parquet"), overwrite=True)["rows_written"] == 1
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["in.jsonl", "out.parquet", "out.parquet.manifest.json"]


def test_line_numbers_over_many_blocks(spark, tmp_path):
    lines = [f'{{"parent_asin": "P{k}", "title": "{"x" * (k % 90)}"}}' if k % 17 else f"bad {k}" for k in range(1, 3000)]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        text = spark.read.text(str(tmp_path / "in.jsonl"), lineSep="\n")
        assert text.rdd.getNumPartitions() > 5
        got = ingest._numbered(text, ingest.why_bad(F.col("value"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line_no, r.line) for r in got) == [(k, f"bad {k}") for k in range(1, 3000) if k % 17 == 0]


def test_all_bad_rows_with_their_places(spark, tmp_path):
    rows = [row(parent_asin=f"P{k}", price="true" if k % 3 == 0 else "1") for k in range(200)]
    raw(spark, *rows).repartition(1).write.parquet(str(tmp_path / "x.parquet"))
    stored = [r["parent_asin"] for r in spark.read.parquet(str(tmp_path / "x.parquet")).collect()]
    with pytest.raises(load.MalformedRows) as found:
        load.load_items(spark, str(tmp_path / "x.parquet"))
    assert found.value.count == 67 and len(found.value.first) == 50 and "17 more" in str(found.value)
    all_of = found.value.rows.collect()
    assert len(all_of) == 67 and all(stored[r["row_index"]] == r["parent_asin"] for r in all_of)


def test_samples_are_the_standard_librarys(spark):
    import random

    ids = [f"P{k:04}" for k in range(503)]
    items = spark.createDataFrame([(i, f"gear {i}" if k % 3 else f"gear holder {i}") for k, i in enumerate(random.Random(1).sample(ids, len(ids)))], "parent_asin string, title string").repartition(7)
    got = {r["audit_id"]: r["parent_asin"] for r in sampling.audit_sample(items, 40).collect()}
    assert [got[k] for k in range(1, 41)] == random.Random(20260930).sample(ids, 40)
    found = matching.match(items, matching.Rules(("ring", "gear"), ("holder",)))
    groups = {True: sorted(r["parent_asin"] for r in found.where("kept").collect()), False: sorted(r["parent_asin"] for r in found.where("NOT kept").collect())}
    rng = random.Random("20261004:gear")
    want = rng.sample(groups[True], 40) + rng.sample(groups[False], 20)
    rng.shuffle(want)
    rows = sampling.contamination_sample(found, ("ring", "gear")).orderBy("audit_id").collect()
    assert [r["parent_asin"] for r in rows] == want and [r["audit_id"] for r in rows] == list(range(1, 61))
    assert [r["n"] for r in sampling.rows_per_query(sampling.publication_sample(found, ("ring", "gear"))).collect()] == [50]
    assert [r["parent_asin"] for r in sampling.publication_sample(found, ("gear",)).orderBy("audit_id").collect()] == random.Random("20261004:publication:gear").sample(groups[True], 50)
    assert sampling.recall_sample(found.limit(0), ("gear",)).count() == 0


def test_membership_with_and_without_unsure(spark):
    rows = [("q", "yes", None), ("q", "no", "UNCERTAIN: half"), ("q", " YES ", ""), ("q", "no", "sure")]
    got = scoring.membership_scores(spark.createDataFrame(rows, "query string, in_set string, notes string"), "query").first()
    assert (got["n"], got["yes"], got["share"], got["n_sure"], got["yes_sure"]) == (4, 2, 0.5, 3, 2) and abs(got["share_sure"] - 2 / 3) < 1e-12 and got["low_sure"] > got["low"]


def test_format_limited_labels(spark):
    rows = spark.createDataFrame([(1, "size", "correct", True), (2, "size", "wrong", False), (3, "na", "correct", False), (4, "none", "abstained", False)], "audit_id int, truth_kind string, verdict string, exact boolean")
    got = scoring.score_report(rows, ("2",)).first()
    assert (got["precision_all"], got["precision_expressible"], got["precision_no_na"], got["coverage"]) == (2 / 3, 1.0, 0.5, 0.75)


def test_item_weight_disagreement(spark):
    from shelfmetrics.operators import matrix

    got = spark.createDataFrame([(100.0, 400.0), (400.0, 100.0), (100.0, 300.0), (None, 1.0), (0.0, 1.0)], "w double, t double").select(matrix.weight_disagrees(F.col("w"), F.col("t")).alias("d")).collect()
    assert [bool(r["d"]) for r in got] == [True, True, False, False, False]


def test_streaming_load(spark, tmp_path):
    from shelfmetrics.streaming import ingest as stream

    (tmp_path / "in").mkdir()
    good = '{"parent_asin": "P%d", "title": "t", "price": 5.5, "average_rating": 4.0, "rating_number": 3, "details": {}}'
    (tmp_path / "in/a.jsonl").write_text("\n".join([good % 1, "not json", '{"parent_asin": "P9", "title": "t", "price": true, "average_rating": 4, "rating_number": 1, "details": {}}']))
    places = [str(tmp_path / x) for x in ("items", "errors", "checkpoint")]
    stream.stream_items(spark, str(tmp_path / "in"), *places).awaitTermination()
    (tmp_path / "in/b.jsonl").write_text(good % 2)
    stream.stream_items(spark, str(tmp_path / "in"), *places).awaitTermination()
    assert sorted(r["parent_asin"] for r in spark.read.parquet(places[0]).collect()) == ["P1", "P2"]
    assert sorted((r["parent_asin"] or "", r["errors"][0]) for r in spark.read.parquet(places[1]).collect()) == [("", "not JSON"), ("P9", "price: unrecognised")]


def test_explanations_round_ties_as_sql_does(spark):
    import duckdb

    from shelfmetrics.operators import matrix
    from shelfmetrics.plans import sql

    # prices in cents over sizes that leave ties at two or six digits; 926.70 for 12 oz is 77.225
    prices = [92670 / 100 / 12, *(c / 100 / n for c in range(90000, 100000, 130) for n in (4, 8, 12, 24, 32, 64))]
    rows = [("q", f"P{k:05}", f"item {k}", 1 + p % 4, k % 7 or None, p, "oz") for k, p in enumerate(prices)]
    frame = spark.createDataFrame(rows, "query string, parent_asin string, title string, car double, rating_number long, unit_price double, unit string")
    got = {r["parent_asin"]: r["explanation"] for r in matrix.explanation(frame).collect()}
    assert got["P00000"].endswith("costs 77.22 per oz.")
    said = sql.oracle_sql()["explanations"].removeprefix(sql.GUARDED)
    with duckdb.connect() as con:
        con.execute("CREATE TABLE guarded (query VARCHAR, parent_asin VARCHAR, title VARCHAR, car DOUBLE, rating_number BIGINT, unit_price DOUBLE, unit VARCHAR)")
        con.executemany("INSERT INTO guarded VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
        assert {r[1]: r[2] for r in con.execute(said).fetchall()} == got


def test_round_scaled_edges(spark):
    from shelfmetrics.functions.rounding import round_scaled

    values = [77.225, -77.225, 0.125, None, 1e303, -1e308, float("inf"), float("nan")]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "k int, x double").orderBy("k").select(round_scaled(F.col("x"), 2)).collect()]
    assert got[:4] == [77.22, -77.22, 0.13, None] and got[4:7] == [1e303, -1e308, float("inf")] and got[7] != got[7]
