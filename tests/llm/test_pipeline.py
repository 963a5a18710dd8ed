from collections import Counter

from pyspark.sql import functions as F
from test_operators import ODD

import corpus_pipeline
from shelfmetrics.llm import jaccard, quality, registry

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_schema_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        assert docs.columns == columns, name
        assert not docs.join(before, "doc_id", "left_anti").count()
        counts.append(docs.count())
        if name == "n-gram Jaccard join":
            kept = {r["doc_id"] for r in docs.collect()}
            want = jaccard.brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, "4/5")
            assert kept == {i for i, (_, c) in want.items() if i == c}
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_stages_judge_rows_without_ids_and_repeated_rows(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    of = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    odd = spark.createDataFrame([*ODD, (None, "no id here"), (None, None)], "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1).cast("long")})
    mixed = docs.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))).select(*odd.columns)
    mixed = corpus_pipeline.written(mixed.unionByName(odd).unionByName(docs.select(*odd.columns).where("doc_id = 1")), "mixed")

    # all rows of a kept text stay, with or without an id
    got, labels = of(stages["quality classifier"](spark, mixed, SF)), spark.read.parquet(f"{SF}/labels.parquet")
    alike = Counter((r["doc_id"], r["kept"]) for r in quality.classify(mixed, labels, sample_rows=8000, labelled_rows=6000).collect())
    assert Counter(i for i, _ in got.elements()) == Counter({i: n for (i, kept), n in alike.items() if kept}) and got.total() < mixed.count()
    assert any(i is None for i, _ in got)

    got = of(stages["quality rules"](spark, mixed, SF))
    assert any(i is None for i, _ in got)

    rows = of(mixed)
    got = of(stages["n-gram Jaccard join"](spark, mixed, SF))
    sets = {k: t for k, t in enumerate(rows.elements())}
    want = jaccard.brute_components([(k, t) for k, (_, t) in sets.items()], 5, "4/5")
    groups = {}
    for k, (_, component) in want.items():
        groups.setdefault(component, []).append(sets[k])
    smallest = [min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()]
    assert Counter(i for i, _ in got.elements()) == Counter(smallest) and not got - rows
    assert got[8, "w " * 30000] == 1 and got[ODD[3]] == 1 and not got[4, "a b c"] and not got[5, "a b c"] and got[None, "no id here"] == 1 and got[0, None] == 1

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    some = odd.unionByName(odd.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(item)})).unionByName(odd.limit(1).withColumns({"doc_id": F.lit(4).cast("long"), "text": F.lit(item)}))
    assert of(stages["benchmark decontamination"](spark, some, SF)) == of(odd)
    assert stages["packing"](spark, some, SF).where("start = 0").count() == some.count()


def test_stages_carry_clashing_columns_and_bear_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    clashing = {"kept": F.lit("k"), "n": F.lit(1.5), "id": F.col("doc_id") * 2, "_row": F.lit("r"), "size": F.lit(None).cast("string"), "n_words": F.lit(7), "distance": F.lit("d"), "key": F.array(F.lit(1)), "a.b": F.lit(3), "shared": F.lit(True), "extra_0": F.lit(0)}
    wide = corpus_pipeline.written(docs.select("n_chars", *[c.alias(n) for n, c in clashing.items()], "text", "doc_id", "source", "lang"), "wide")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, wide, SF), stage(spark, docs, SF)
        assert got.dtypes == wide.dtypes, name
        rows = got.collect()
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in plain.collect()), name
        assert all((r["kept"], r["n"], r["id"], r["_row"], r["n_words"], r["distance"], r["a.b"], r["extra_0"]) == ("k", 1.5, 2 * r["doc_id"], "r", 7, "d", 3, 0) for r in rows), name
        assert stage(spark, wide.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, SF).where("start = 0").count() == 60
    assert corpus_pipeline.STAGES[-1][1](spark, wide.limit(0), SF).count() == 0


COLUMNS = {
    1: "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    2: "page_id bigint, url string, text string, n_chars bigint",
    3: "doc_id bigint, quality_score double, toxic_score double, kept boolean",
    4: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    5: "doc_id bigint, item_id bigint, passage bigint, bm25 double, question_overlap double, answer_overlap double",
    6: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    7: "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    8: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    9: "doc_id bigint, n_shingles bigint, component_id bigint",
    10: "doc_id bigint, path string, license string, cosine double, via string, folder string",
}


def test_queries_return_their_columns_for_all_rows(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").count()
    for name, query in registry.queries().items():
        number = int(name[2:].split("_")[0])
        got = query(spark, SF)
        want = [tuple(c.split(" ")) for c in COLUMNS[number].split(", ")]
        assert got.dtypes[: len(want)] == want, name
        rows = got.collect()
        if number == 2:
            assert len(rows) == pages and all(r["n_chars"] == len(r["text"]) for r in rows)
        elif number == 5:
            assert {r["doc_id"] for r in rows} <= set(docs) and rows
        elif number == 7:
            assert {r["doc_id"] for r in rows} == set(docs) and sum(r["doc_tokens"] for r in rows if r["start"] == 0) == sum(r["length"] for r in rows)
        else:
            assert sorted(r["doc_id"] for r in rows) == sorted(docs), name
        if number == 10:
            # sources are the top folders, languages the ones below
            assert all(r["path"] == f"{docs[r['doc_id']]['source']}/{docs[r['doc_id']]['lang']}/{r['doc_id']}" for r in rows)
        if number == 4:
            assert {r["law"] for r in rows} == {"bytes"} and {r["shard"] for r in rows} == set(range(8)) and {r["grown_shard"] for r in rows} == {None}


def test_every_operator_has_a_query():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
