"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd input."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmetrics.llm import decontamination, extraction, jaccard, ngram_lm, outliers, packing, quality, records, sharding, tokens
from shelfmetrics.llm.common import ASCII_LOWER, WORD_RE

SF = "/root/testdata/sf0.001"
ODD = [
    (0, None), (1, ""), (2, "a"), (3, " \t\n a  b\x0bc "), (4, "a b c"), (5, "a b c"), (6, "a b   é…"), (7, "\x01 x\n\n\ny <|endoftext|>"), (8, "w " * 30000), (8, "w " * 30000), (9, "naïve 日本 ÀÉ\x1c z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, repeats, a long text, and columns whose names clash with those that operators make."""
    df = spark.createDataFrame([*ODD, (None, "no id here")], "doc_id long, text string")
    return df.withColumns({"lang": F.when(F.col("doc_id") > 3, "en"), "source": F.lit(None).cast("string"), "size": F.lit("x"), "kept": F.lit(7), "n": F.lit(1), "key": F.lit("k"), "shard": F.lit(9)})


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def none_of(df):
    return df.limit(0)


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def words(text):
    return WORD_RE.findall((text or "").translate(ASCII_LOWER))


# language model


def brute_base(rows):
    counts = Counter(w for i, t in rows if ngram_lm.fold_of(i) != 2 for w in [*words(t), None])
    total = sum(counts.values())
    return {i: (len(words(t)) + 1, sum(counts[w] > 0 for w in [*words(t), None]), sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in [*words(t), None])) for i, t in rows}, total


@pytest.mark.parametrize("block", [1 << 10, 14 << 20])
def test_language_model_counts_are_exact(spark, documents, block):
    docs = documents.unionByName(spark.createDataFrame([(10**9, None), (10**9 + 1, "  ")], "doc_id long, text string"), allowMissingColumns=True)
    want, total = brute_base(rows_of(docs))
    got = ngram_lm.interpolated_scores(docs.repartition(3), block_bytes=block).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (*want[r["doc_id"]][:2], total)
        assert abs(r["base_score"] - want[r["doc_id"]][2]) < 1e-6
        assert r["score"] < 0
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_is_a_distribution():
    """The weights of a bucket add up to one, and learning finds the estimate that explains the cells."""
    half = ngram_lm.BUCKETS // 2
    cells = [(5, 0, 512 + 40, 512 + 4, 90), (5, 0, 0, 512 + 4, 10), (half + 3, 512 + 40, 512, 512, 50)]
    w = ngram_lm.learn_weights(cells)
    assert np.allclose(w.sum(1), 1) and w[5].argmax() == 1 and w[0, 1] == 0 and (w[:half, 0] == 0).all() and w[half + 3].argmax() == 0


def brute_model(rows, order):
    """Scores by plain dictionaries of token runs."""
    texts = [(ngram_lm.fold_of(i), [*words(t), None]) for i, t in rows]
    START, half = object(), ngram_lm.BUCKETS // 2

    def counts_of(folds):
        one, two, three, starts = Counter(), Counter(), Counter(), 0
        for fold, w in texts:
            if fold in folds:
                starts += 1
                one.update(w)
                run = [START, *w]
                two.update(zip(run, run[1:], strict=False))
                three.update(zip(run, run[1:], run[2:], strict=False))
        return one, two, three, starts

    def estimates(w, k, counts):
        one, two, three, starts = counts
        run = [START, *w]
        context = starts if k == 0 else one[w[k - 1]]
        wide = two[run[k - 1], run[k]] if k and order > 2 else 0
        p = [three[run[k - 1], run[k], w[k]] / wide if wide else 0.0, two[run[k], w[k]] / context if context else 0.0, one[w[k]] / max(1, one.total()), 1 / (len(one) + 1)]
        return (half + wide.bit_length() if wide else context.bit_length()), p

    kept, cells = counts_of((ngram_lm.KEPT,)), Counter()
    for fold, w in texts:
        if fold == ngram_lm.DELETED:
            for k in range(len(w)):
                bucket, p = estimates(w, k, kept)
                cells[(bucket, *(round(math.log2(x / p[3]) * ngram_lm._FINENESS) + 512 if x else 0 for x in p[:3]))] += 1
    weights, every = ngram_lm.learn_weights([(*c, n) for c, n in sorted(cells.items())]), counts_of((ngram_lm.KEPT, ngram_lm.DELETED))
    scores = []
    for _, w in texts:
        total = 0.0
        for k in range(len(w)):
            bucket, p = estimates(w, k, every)
            total += math.log10(sum(a * b for a, b in zip(weights[bucket], p, strict=True)))
        scores.append(total)
    return {i: s for (i, _), s in zip(rows, scores, strict=True)}


@pytest.mark.parametrize(("parts", "limits"), [(1, {}), (5, {"block_bytes": 1 << 12, "slice_tokens": 3000}), (3, {"order": 2, "block_bytes": 1 << 12})])
def test_language_model_by_brute_force(spark, documents, parts, limits):
    docs = documents.select("doc_id", "text").where("length(text) < 3000").unionByName(spark.createDataFrame([(10**9, None), (10**9 + 1, "  "), (10**9 + 3, "a"), (10**9 + 4, "a")], "doc_id long, text string"))
    want = brute_model(rows_of(docs), limits.get("order", 3))
    got = {r["doc_id"]: r["score"] for r in ngram_lm.interpolated_scores(docs.repartition(parts), **limits).collect()}
    assert len(got) == len(want) and all(abs(got[i] - want[i]) < 1e-6 * max(1, abs(want[i])) for i in want)


def test_language_model_tells_repeated_texts(spark, documents):
    """A held-out text of which a copy was learned scores higher, token by token, than others."""
    once = documents.select("doc_id", "text").where("length(text) > 400").dropDuplicates(["text"])
    twice = once.where("doc_id % 3 = 0").select((F.col("doc_id") + 10**8).alias("doc_id"), "text")
    got = ngram_lm.interpolated_scores(once.unionByName(twice)).toPandas()
    each, twin = got.score / got.n_tokens, got.doc_id.map(lambda i: i - 10**8 if i >= 10**8 else i + 10**8)
    learned = set(got.doc_id[~got.held_out])
    copied, alone = got.held_out & twin.isin(learned), got.held_out & ~twin.isin(set(got.doc_id))
    assert copied.sum() > 5 and (each[copied] > each[alone].quantile(0.9)).mean() > 0.8


def test_language_model_odd_and_empty(odd):
    assert ngram_lm.interpolated_scores(odd).count() == len(ODD) + 1
    assert ngram_lm.interpolated_scores(none_of(odd)).count() == 0


# extraction


def test_longest_common_subsequence():
    random.seed(1)
    for _ in range(500):
        a, b = ([random.randint(0, 4) for _ in range(random.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        for most_bits in (1 << 26, 1):
            found = extraction.shared_lines(a, b, most_bits)
            rest = iter(b)
            assert len(found) == table[-1][-1] and all(a[k] in rest for k in found)


def test_long_pages_take_linear_space_and_time():
    import time
    import tracemalloc

    began = time.time()
    extraction.lines_of("<div>" * 40000 + "</b>" * 40000)
    extraction.lines_of("<div><p>" * 20000 + "x</div>" * 20000)
    assert time.time() - began < 2
    random.seed(8)
    a = [random.randrange(30000) for _ in range(30000)]
    b = [x if random.random() < 0.5 else random.randrange(30000) for x in a]
    tracemalloc.start()
    found = extraction.shared_lines(a, b)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    rest = iter(b)
    assert len(found) > 14000 and all(a[k] in rest for k in found)


def test_broken_markup_leaves_no_text():
    of = lambda page: [x.text for x in extraction.lines_of(page)]
    assert of('<p>a</p><div class="x>y>hello</div><p>b</p>') == ["a", "y>hello", "b"]
    assert of("<p>1 < 2 &lt; 3 <b") == ["1 < 2 < 3"]
    assert of("</div></p>t<p>u<p>v</b></p>") == ["t", "u", "v"]


def test_differencing_decides_what_structure_leaves(spark):
    """In an article, shared paragraphs stay and other shared lines go; without differencing they would stay."""
    page = "<article><h1>H {k}</h1><div>Share this story</div><p>Said {k}.</p><p>As ever.</p><div>By writer {k}</div></article>"
    rows = [(k, f"http://h.example/a/{k:02}", page.replace("{k}", str(k))) for k in range(5)]
    got = extraction.extract_pages(spark.createDataFrame([*rows, rows[0], (None, "http://h.example/a/02", page)], "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("host", F.lit(2)))
    found = {r["page_id"]: (r["text"], r["n_shared"]) for r in got.collect()}
    assert found[3] == ("H 3\nSaid 3.\nAs ever.\nBy writer 3", 1) and got.count() == 7
    assert "Share this story" in extraction.main_text(extraction.lines_of(rows[3][2]), set())[0] and "Share this story" in found[None][0]


def test_extraction_by_structure_and_by_neighbours(spark):
    page = "<html><head><title>t</title><script>if(a<b){}</script></head><body><header>Top</header><article><h1>H {k}</h1><p>Text&nbsp;{k} &amp;amp; <b>bold<br>x<p>two</article><footer>f</footer></body></html>"
    bare = "<body><div>Acme shop</div><div>Story {k} begins.</div><p>And ends {k}.</p><div>All rights</div></body>"
    rows = [(k, f"http://h.example/a/{k:02}", page.replace("{k}", str(k))) for k in range(5)]
    rows += [(10 + k, f"http://g.example/b/{k:02}?x=1", bare.replace("{k}", str(k))) for k in range(6)]
    rows += [(20, None, None), (21, "http://g.example/b/00", ""), (22, "http://solo.example/", "<p>only <i hidden>no</i>one</p>")]
    for parts in (1, 4):
        got = {r["page_id"]: r for r in extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()}
        assert got[3]["text"] == "H 3\nText 3 &amp; bold x\ntwo"
        assert [got[10 + k]["text"] for k in range(6)] == [f"Story {k} begins.\nAnd ends {k}." for k in range(6)]
        assert (got[20]["text"], got[21]["text"], got[22]["text"]) == ("", "", "only\none")
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())


def test_extraction_empty_table(spark):
    assert extraction.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# quality classifier


def test_labeller_accuracies_are_found():
    random.seed(2)
    patterns, truth = Counter(), [0.95, 0.8, 0.9, 0.7]
    for _ in range(20000):
        bad = random.random() < 0.2
        patterns["".join(("b" if bad == (random.random() < a) else "g") if random.random() < 0.8 else "-" for a in truth)] += 1
    share, chances = quality.fit_labellers(patterns, 4, 0.15)
    assert abs(share - 0.2) < 0.03 and np.abs(quality.accuracies(share, chances) - truth).max() < 0.05


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where("doc_id % 2 = 0")
    got = quality.classify(docs, fitted).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    clean = got[(got.quality == 1) & (got.toxic == 0)]
    junk = got[got.quality == 0]
    assert clean.kept.mean() > 0.97
    assert junk.kept.mean() < 0.2


def test_classifier_on_held_out_toxic_labels(spark):
    """Toxic documents go in every language, whose insults no rule knows, and clean ones stay."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    toxic = got[got.toxic == 1]
    assert toxic.kept.mean() < 0.05
    assert all(len(g) > 10 and g.kept.mean() < 0.15 for _, g in toxic.groupby("lang"))
    assert got[(got.quality == 1) & (got.toxic == 0)].kept.mean() > 0.995


def test_training_does_not_hang_on_rounding():
    random.seed(11)
    features = [np.unique(np.array(random.choices(range(400), k=random.randint(1, 30)))) for _ in range(600)]
    target = np.array([float(any(x < 6 for x in f)) for f in features])
    dense = np.random.default_rng(0).random((600, len(quality.DENSE)))
    a, b = (quality.train(features, dense, target + noise, 10) for noise in (0, np.random.default_rng(1).normal(0, 1e-12, 600)))
    assert np.abs(a - b).max() < 1e-6
    score = np.array([a[f].sum() for f in features]) + dense @ a[2 << 10 :]
    assert ((score > 0) == (target > 0)).mean() > 0.97


def test_labellers_are_no_functions_of_each_other():
    texts = ["you idiot", "kill yourself now", "what the f**k", "scum and idiot", "hello there"]
    read = quality.read_batch(pa.array(texts))
    none = np.full(len(texts), np.nan)
    _, toxic = quality.votes_of(read, quality.dense_of(read), none, none, none)
    votes = dict(zip(quality.TOXIC_LABELLERS, (toxic == 1).T.tolist(), strict=True))
    assert votes["mockery"] == [True, False, False, True, False] and votes["contempt"] == [False, False, False, True, False]
    assert votes["threats"] == [False, True, False, False, False] and votes["masked"] == [False, False, True, False, False]


def test_classifier_by_plain_expectation_maximisation():
    """The fit over counts of patterns is that over single rows."""
    random.seed(10)
    rows = ["".join(random.choices("bg-", (0.2, 0.3, 0.5), k=3)) for _ in range(300)]
    share, chances = quality.fit_labellers(Counter(rows), 3, 0.15, rounds=20)
    pull, begin = 0.005 * len(rows) + 1, []
    for good in (0.9, 0.1):
        begin.append([])
        for k in range(3):
            voted = sum(r[k] != "-" for r in rows) / len(rows)
            own = {"-": 1 - voted + 1e-4, "g": voted * good + 1e-4, "b": voted * (1 - good) + 1e-4}
            begin[-1].append({v: x / sum(own.values()) for v, x in own.items()})
    prior, model = 0.15, begin
    for _ in range(20):
        bad = []
        for r in rows:
            yes, no = prior, 1 - prior
            for k, v in enumerate(r):
                yes, no = yes * model[1][k][v], no * model[0][k][v]
            bad.append(yes / (yes + no))
        prior = min(max((sum(bad) + 0.15 * pull) / (len(rows) + pull), 1e-3), 0.5)
        model = [[{v: sum(p if c else 1 - p for r, p in zip(rows, bad, strict=True) if r[k] == v) + pull * begin[c][k][v] for v in "-gb"} for k in range(3)] for c in (0, 1)]
        model = [[{v: max(x / sum(own.values()), 1e-4) for v, x in own.items()} for own in side] for side in model]
    assert abs(share - prior) < 1e-9 and np.allclose(chances, [[[own[v] for v in "-gb"] for own in side] for side in model])


@pytest.mark.parametrize("labels", [[(k, 1, 1) for k in range(10)], [(k, 0, 0) for k in range(10)], [(1, 1, 0)], [(None, None, None)]])
def test_classifier_of_one_class(spark, odd, labels):
    assert quality.classify(odd, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == len(ODD) + 1
def test_classifier_odd_and_empty(spark, odd):
    assert quality.classify(odd).count() == len(ODD) + 1
    labels = spark.createDataFrame([(2, 1, 0), (8, 0, 0), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality.classify(odd, labels).count() == len(ODD) + 1
    assert quality.classify(none_of(odd), labels).count() == 0


# sharding


def test_shards_are_contiguous_and_balanced(spark, documents):
    for parts in (1, 5):
        got = sharding.byte_shards(documents.repartition(parts)).toPandas().sort_values("start")
        sizes = {i: len((t or "").encode()) + 1 for i, t in rows_of(documents)}
        assert dict(zip(got.doc_id, got["size"], strict=True)) == sizes
        assert got.shard.is_monotonic_increasing and set(got.shard) == set(range(8)) and list(got.start) == list(got["size"].cumsum() - got["size"])
        # equal texts are parted by the seven cuts at most
        texts = got.doc_id.map(dict(rows_of(documents))).fillna("")
        assert texts.nunique() < len(got) and len(set(zip(texts, got.shard, strict=True))) <= texts.nunique() + 7
        by = got.groupby("shard")["size"].sum()
        assert by.max() - by.min() <= 2 * max(sizes.values())
        for _, g in got.groupby("shard"):
            assert list(g.slot) == list(range(len(g)))


def test_shards_odd_and_empty(odd):
    got = sharding.byte_shards(odd).collect()
    assert len(got) == len(ODD) + 1 and {r["size"] for r in got if r["doc_id"] in (0, 1)} == {1}
    assert {r["text_crc32"] for r in got if r["doc_id"] == 4} == {zlib.crc32(b"a b c")}
    assert sharding.byte_shards(none_of(odd)).count() == 0


# decontamination


def brute_hits(docs, items, overlap=0.8, n=5):
    parts = {i: [decontamination.shingles(x, n) for x in decontamination.question_and_answer(t)] for i, t in items if t and t.strip()}
    out = set()
    for d, text in docs:
        have = decontamination.shingles(decontamination.terms_of(text), n)
        out |= {(d, i) for i, (q, a) in parts.items() if q and len(q & have) >= overlap * len(q) and (not a or len(a & have) >= overlap * len(a))}
    return out


def test_decontamination_by_brute_force(spark, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_hits(rows_of(documents), [tuple(r) for r in items.select("item_id", "text").collect()])
    results = []
    for block in (16 << 20, 1 << 11):
        got = decontamination.contaminated(documents, items, block_bytes=block)
        results.append(sorted((r["doc_id"], r["item_id"], r["passage"], round(r["bm25"], 9), r["question_overlap"], r["answer_overlap"]) for r in got.collect()))
        assert {r[:2] for r in results[-1]} == want
    assert results[0] == results[1]
    assert decontamination.clean_of(documents, got).count() == documents.count() - len({d for d, _ in want})


def test_wand_finds_all_above_the_threshold():
    random.seed(3)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(random.choices(vocabulary, weights=range(1, 61), k=random.randint(3, 70)))) for k in range(150)]
    for common in (0.0, 0.35, 0.5):
        index = decontamination.BM25Index(items, common=common, block=4)
        total = np.zeros(len(items))
        for lists in (index.lists, index.common):
            np.add.at(total, lists.items, lists.weights)
        assert np.allclose(total, 1) and (index.rest <= common + 1e-9).all() and len(index.classes) > 1
        for _ in range(100):
            query = random.sample(range(len(index.terms)), 25)
            scores = defaultdict(float)
            for t in query:
                for lists in (index.lists, index.common):
                    for k in range(lists.starts[t], lists.starts[t + 1]):
                        scores[int(lists.items[k])] += lists.weights[k]
            for threshold in (0.51, 0.6, 0.7):
                want = {i for i, s in scores.items() if s >= threshold - 1e-9}
                assert {i for i, _ in index.search(query, threshold)} == want
                for _, low, high in index.classes:
                    assert {i for i, _ in index.search(query, threshold, low, high)} == {i for i in want if low <= i < high}
                # the bound over many passages loses none of them, however little is held at once
                for most in (1, 1000):
                    found = decontamination._promising(index, np.repeat(np.arange(2), len(query)), np.array(query * 2), threshold, 0, len(items), most)
                    assert found in ([0, 1], []) and (found or not want)


def test_decontamination_by_many_items(tmp_path):
    """20,000 items of the documents' own words against 8 MB: bounded memory, and the result of an exhaustive scan."""
    code = """
import random, resource, sys
import pyarrow as pa
from shelfmetrics.llm import decontamination
random.seed(7)
vocabulary = [f"w{k}" for k in range(20000)]
weights = [1 / (k + 5) for k in range(len(vocabulary))]
docs = [random.choices(vocabulary, weights, k=400) for _ in range(3400)]
items = [(k, " ".join(random.choices(vocabulary, weights, k=50))) for k in range(19800)]
want = set()
for k in range(19800, 20000):
    d = random.randrange(len(docs))
    at = random.randrange(300)
    items.append((k, " ".join(docs[d][at : at + 50])))
    want.add((d, k))
index = decontamination.BM25Index(items)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
batch = pa.record_batch([pa.array(range(len(docs))), pa.array([" ".join(d) for d in docs])], names=["id", "text"])
got = {(r["doc_id"], r["item_id"]) for b in decontamination._find(index, 0.7, 0.8, 5)(iter([batch])) for r in b.to_pylist()}
assert got == want, (len(got), len(want))
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, batch.nbytes >> 20)
"""
    import subprocess
    import sys
    from pathlib import Path

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=False)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) < 500


def test_decontamination_odd_and_empty(spark, odd):
    items = spark.createDataFrame([(1, None), (2, " "), (3, "a b c"), (4, "x " * 4)], "item_id long, text string")
    assert {r["item_id"] for r in decontamination.contaminated(odd, items).collect()} <= {3, 4}
    assert decontamination.contaminated(none_of(odd), items).count() == 0
    assert decontamination.contaminated(odd, none_of(items)).count() == 0


def test_decontamination_of_marked_and_altered_passages(spark):
    question = [f"q{k}" for k in range(24)]
    answers = {size: [f"a{size}w{k}" for k in range(size)] for size in (5, 8, 20, 28)}
    items = [(size, " ".join(question) + "\n" + " ".join(a)) for size, a in answers.items()]
    docs, want = [], set()
    for mark in ("%%%", "$$$", "&&&", "#", "*", "|", "<>", "…", "”"):
        docs.append((len(docs), f"before {' '.join([*question, *answers[5]])}{mark} after"))
        want.add((len(docs) - 1, 5))
    for size, answer in answers.items():
        for altered in range(size):
            docs.append((len(docs), " ".join(["before", *question, *answer[:altered], "other", *answer[altered + 1 :], "after"])))
            want.add((len(docs) - 1, size))
    # another answer to the same question is no item, nor are an answer's words far from the question
    docs.append((len(docs), " ".join([*question, "v w x y z"])))
    docs.append((len(docs), " ".join([*question, *["far"] * 500, *answers[5][:4]])))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(*frames).collect()} == want


# quality rules


def brute_statistics(text):
    w, seen, covered = WORD_RE.findall(text or ""), defaultdict(list), set()
    for k in range(len(w) - 7):
        seen[tuple(w[k : k + 8])].append(k)
    for places in seen.values():
        if len(places) > 1:
            for k in places:
                covered.update(range(k, k + 8))
    lines = [x for x in (text or "").split("\n") if WORD_RE.search(x)]
    return len(w), sum(map(len, w)), sum(c in outliers.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_statistics_by_brute_force(spark, documents):
    rows = rows_of(documents) + [(-1, "a b c d e f g h " * 3), (-2, "x " * 40), (-3, None), (-4, "l\nl\n\n \nl")]
    got = outliers.text_statistics(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {i: brute_statistics(t) for i, t in rows}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want[r["doc_id"]]


def test_outliers_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = outliers.mcd_outliers(docs).join(labels, "doc_id").toPandas()
    clean = got[(got.quality == 1) & ~got.base_failed]
    assert clean.kept.mean() > 0.99
    assert got[got.quality == 0].kept.mean() < 0.1


def brute_distances(rows, keep_share=0.75, floor=1e-3):
    """Concentration steps in plain matrices: rows of (weight, statistics) to scaled squared distances."""
    w, x = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    at = lambda v, q: np.sort(v)[math.ceil(q * len(v)) - 1]
    distinct = np.unique(np.array(rows), axis=0)
    dw, dx = distinct[:, 0], distinct[:, 1:]
    centre = np.array([at(c, 0.5) for c in dx.T])
    s = np.array([max(1.4826 * at(abs(dx[:, i] - centre[i]) * np.sqrt(dw), 0.5), math.sqrt(floor)) for i in range(dx.shape[1])])
    cov = np.diag(s**2)
    measure = lambda w, x: w * np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    for _ in range(8):
        d = measure(dw, dx)
        near = d <= at(d, keep_share)
        centre = (dw[near, None] * dx[near]).sum(0) / dw[near].sum()
        y = (dx[near] - centre) * np.sqrt(dw[near])[:, None]
        cov = y.T @ y / near.sum() + floor * np.eye(dx.shape[1])
    return measure(w, x) / at(measure(dw, dx), 0.5) * outliers.chi_square_quantile(0.5, dx.shape[1])


def test_outliers_by_brute_force(spark):
    """Groups of over 60 rows have estimates of their own, and the chi-square quantile decides."""
    random.seed(9)
    texts = []
    for group, (length, marks) in enumerate([(6, "."), (9, "!,"), (4, "-")]):
        for k in range(120):
            words_here = ["".join(random.choices("abcdefghij", k=max(1, int(random.gauss(length, 2))))) + random.choice(["", "", marks]) for _ in range(random.choice([25, 60, 200, 400]))]
            if k % 17 == 0:
                words_here = [w.upper() + "%$" for w in words_here]
            texts.append((len(texts), " ".join(words_here), "en", f"s{group}"))
    texts += [(len(texts) + k, texts[5][1], "en", "s0") for k in range(200)]  # copies don't draw the estimate in
    got = outliers.mcd_outliers(spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").repartition(4)).withColumn("_w", F.col("n_words") / (F.col("n_words") + outliers.SHORT))
    got = got.select("doc_id", "source", "base_failed", "kept", "distance", "_w", *[c.alias(f"x{i}") for i, c in enumerate(outliers.vector())]).collect()
    cutoff = outliers.chi_square_quantile(1 - 1e-12, 5)
    assert 60 < cutoff < 75
    for source in ("s0", "s1", "s2"):
        own = [r for r in got if r["source"] == source and not r["base_failed"]]
        want = brute_distances([tuple(r[5:]) for r in own])
        assert len(own) >= 100 and np.allclose([r["distance"] for r in own], want, rtol=1e-6)
        assert [r["kept"] for r in own] == (want <= cutoff).tolist()
        assert {r["doc_id"] for r in own if not r["kept"]} == {r["doc_id"] for r in own if r["doc_id"] < 360 and r["doc_id"] % 120 % 17 == 0}


def test_outliers_odd_and_empty(odd):
    got = outliers.mcd_outliers(odd)
    assert got.count() == len(ODD) + 1 and "size" in got.columns
    assert {r["kept"] for r in got.where("doc_id < 3").collect()} == {False}
    assert outliers.mcd_outliers(none_of(odd)).count() == 0


def test_chi_square():
    assert abs(outliers.chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-6
    assert abs(outliers.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3


# tokens, packing, records


def test_encoder_gives_the_tokenizers_ids(documents):
    texts = [t for _, t in rows_of(documents)] + [t for _, t in ODD] + ["foo. bar, baz.. qux., , . x\n, y.\n. z", "it's don't 12 3²½", " lead", "trail ", "a \nb", "a\n b"]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y\n<|endoftext|>z", "<|endoftext |> <| endoftext|>"]
    encoder, plain = tokens.PieceEncoder(tokens.public_vocabulary(), cache=3000), Tokenizer.from_file(tokens.public_vocabulary())
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == encoder._whole(["a <|endoftext|> b"])[0]
    for _ in range(2):
        flat, ends = encoder.encode(pa.array(texts, pa.string()))
        starts = np.concatenate([[0], ends])
        for k, text in enumerate(texts):
            assert flat[starts[k] : starts[k + 1]].tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_packing_covers_every_id_once(spark, documents):
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10**9, None), (10**9 + 1, "w " * 5000)], "doc_id long, text string"))
    got = packing.pack(docs.repartition(6), tokens.public_vocabulary(), bound=4).toPandas()
    plain = Tokenizer.from_file(tokens.public_vocabulary())
    for i, text in rows_of(docs):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
        assert list(own.start) == list(np.cumsum(own.length) - own.length)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 1024
    assert got.length.sum() / got.sequence_id.nunique() / 1024 > 0.9


def test_open_windows_are_bounded():
    windows = packing.OpenWindows(10, 3, 0)
    for n in (6, 7, 8, 9, 5, 4, 3, 2, 1, 10):
        windows.place(n)
        assert len(windows.free) <= 3


def test_leftover_windows_meet(spark):
    # more windows over half full than a partition keeps open, and as many leftovers that fit
    docs = spark.createDataFrame([(k, "a " * 5) for k in range(64)], "doc_id long, text string").repartition(16)
    got = packing.pack(docs, tokens.public_vocabulary(), bound=4, merge=4).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == list(np.cumsum(g.length) - g.length) and g.length.sum() <= 1024
    assert len(got) == 64 and got.sequence_id.nunique() == 1
    batch = pa.record_batch([pa.array(range(200)), pa.array([600] * 100 + [400] * 100)], names=["window", "fill"])
    merged = next(packing._merge_open(1000, 64)(iter([batch]))).to_pydict()
    assert len(set(merged["into"])) == 100 and set(merged["total"]) == {1000} and not any(merged["open"])


def test_packing_odd_and_empty(odd):
    assert packing.pack(odd, tokens.public_vocabulary()).where("start = 0").count() == len(ODD) + 1
    assert packing.pack(none_of(odd), tokens.public_vocabulary()).count() == 0


def test_record_frames():
    random.seed(4)
    data = [b"", b"123456789", *(random.randbytes(n) for n in (1, 63, 64, 65, 5000, 70000))]
    lengths = np.array([len(x) for x in data])
    crcs = records.crc32c_many(np.frombuffer(b"".join(data), np.uint8), np.cumsum(lengths) - lengths, lengths)
    assert crcs[1] == 0xE3069283  # the published check value
    framed, sizes = records.frame(data)
    assert records.unframe(framed) == data and sizes.sum() == len(framed)
    for spoil in (0, 9, 20, len(framed) - 1):
        broken = bytearray(framed)
        broken[spoil] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))


def test_records_round_trip(spark, documents):
    docs = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10**9, None)], "doc_id long, text string"))
    folder, index = records.write_records(docs.repartition(5), tokens.public_vocabulary())
    got = {r["key"]: r for r in records.with_starts(records.read_records(spark, folder, index, chunk=1 << 12)).collect()}
    plain, start = Tokenizer.from_file(tokens.public_vocabulary()), 0
    for i, text in sorted(rows_of(docs)):
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    # a single record by its index entry
    entry = index.orderBy("key").first()
    with open(f"{folder.removeprefix('file://')}/{entry['file']}", "rb") as f:
        f.seek(entry["offset"])
        assert len(records.unframe(f.read(entry["length"]))) == 1


def test_records_with_null_keys(spark, odd):
    docs = odd.unionByName(odd.where("doc_id IS NULL")).unionByName(odd.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    folder, index = records.write_records(docs.repartition(3), tokens.public_vocabulary())
    got = records.with_starts(records.read_records(spark, folder, index)).orderBy("start").collect()
    plain, start = Tokenizer.from_file(tokens.public_vocabulary()), 0
    rows = sorted(((i, t or "") for i, t in rows_of(docs)), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert len(got) == len(rows) and [r["key"] for r in got] == [i for i, _ in rows]
    for r, (_, text) in zip(got, rows, strict=True):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert index.where("key IS NULL").count() == 3


def test_records_empty(spark, odd):
    folder, index = records.write_records(none_of(odd), tokens.public_vocabulary())
    assert records.read_records(spark, folder, index).count() == 0


# similarity join


def test_jaccard_by_brute_force(spark):
    random.seed(5)
    vocabulary, rows = [f"w{k}" for k in range(2000)], []
    for length in (4, 12, 25, 60, 150, 400):
        base = random.choices(vocabulary, k=length)
        for _ in range(20):
            copy = list(base)
            for _ in range(random.randint(0, max(1, length // 25))):
                copy[random.randrange(length)] = random.choice(vocabulary)
            rows.append((len(rows), " ".join(copy[: max(1, length - random.choice([0, 0, 1, 3]))])))
    rows += [(1000 + i, t) for i, t in ODD[:7]]
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, threshold in ((3, "9/10"), (5, "4/5")):
        want = jaccard.brute_components(rows, n, threshold)
        for limits in ({}, {"chunk": 1, "levels": 3, "block_bytes": 1 << 10, "slice_keys": 500}):
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df.repartition(5), n, threshold, **limits).collect()}
            assert got == want


def test_jaccard_deletion_neighbourhoods_lose_nothing():
    """Where a corpus is so large that one-deletion segments pay, linked sets still share a key."""
    random.seed(6)
    from fractions import Fraction

    t = Fraction(9, 10)
    for size in (20, 60, 200):
        starts = jaccard.edges_of(t, 2 * size)
        bands = [jaccard.allocate(a, b - 1, t, 10**9) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        assert any(b.deletions for b in bands)
        for _ in range(200):
            base = [random.getrandbits(60) for _ in range(size)]
            x, y = (np.sort(np.array(base[: random.randint(size - 4, size)] + [random.getrandbits(60) for _ in range(random.randint(0, 3))], np.uint64)) for _ in range(2))
            if jaccard.linked(x, y, t) and not np.array_equal(x, y):
                # each set leaves out what it may: its own shingles, and the segments that the other might have needed most
                common, kept = np.intersect1d(x, y), []
                for s in (x, y):
                    kept.append(set())
                    for j in jaccard._schemes(len(s), starts, bands):
                        keys, slots = jaccard.keys_of(common, bands[j], j)
                        spare = jaccard.spare_of(len(s), len(s) - len(common), bands[j], t)
                        left_out = set()
                        for slot in random.sample(sorted(set(slots.tolist())), len(set(slots.tolist()))):
                            if spare >= 1 + slot % 2:
                                spare -= 1 + slot % 2
                                left_out.add(slot)
                        kept[-1] |= {int(k) for k, slot in zip(keys, slots, strict=True) if int(slot) not in left_out}
                assert kept[0] & kept[1]


def test_jaccard_odd_and_empty(odd):
    got = {r["doc_id"]: r for r in jaccard.jaccard_components(odd).collect()}
    assert (got[0]["component_id"], got[0]["n_shingles"], got[5]["component_id"], got[None]["component_id"]) == (0, 0, 3, None)
    assert jaccard.jaccard_components(none_of(odd)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    assert {r["id"]: r["component"] for r in jaccard.components(links).collect()} == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}




# licences


def test_licenses_by_brute_force(spark):
    files = [
        (1, "a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"), (2, "a/b/x", "some text"), (3, "a/b/c/y", None),
        (4, "a/b/c/COPYING", "Licensed under the Apache License, Version 2.0"), (5, "z/q", "many words of another kind stand here, before it\nReleased under the MIT License.\nand so do several others, which nobody licensed"), (6, "z/r", "words only"), (7, "top", "All rights reserved!\n" + "w " * 9000),
        (8, "a/b/c/d/e", "a licence of no known kind at all, with many more words"), (9, "", ""), (10, "a/b/x2", "some text"),
        # a short file with a header is no licence file, and a header may run over several lines
        (11, "q/short.py", "# Released under the MIT License"), (12, "q/other.py", "x = 1"),
        (13, "q/c.py", "#!/usr/bin/python\n#\n# Permission is hereby granted,\n# free of charge, to any person\n# obtaining a copy of this software and\n# associated documentation files\n#\nimport os"),
    ]
    from shelfmetrics.llm import licenses

    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], {"header": "own", "file": "own"}.get(r["via"], r["via"])) for r in licenses.scan_licenses(df).collect()}
    assert got == licenses.brute_licenses(files, licenses.TEMPLATES, 0.6)
    assert got[2] == ("MIT", "inherited") and got[3] == ("Apache-2.0", "inherited") and got[5][0] == "MIT" and got[6] == (None, "none")
    assert got[11] == ("MIT", "own") and got[12] == (None, "none") and got[13] == ("MIT", "own")
    assert got == {r["doc_id"]: (r["license"], {"header": "own", "file": "own"}.get(r["via"], r["via"])) for r in licenses.scan_licenses(df.repartition(5), most_bytes=0).collect()}


def test_licenses_of_full_texts(spark):
    from pathlib import Path

    from shelfmetrics.llm import licenses

    full = dict(licenses.FULL_TEXTS)
    files, want = [], {}
    for k, name in enumerate(full):
        # as repositories hold them: a notice of their own above the text
        files += [(2 * k, f"{k}/LICENSE", f"Example project\nCopyright 2020 Some Body\n\n{full[name]}"), (2 * k + 1, f"{k}/src/main.c", "int main")]
        want |= {2 * k: (name, "file"), 2 * k + 1: (name, "inherited")}
    prose = Path(licenses.__file__).parents[2].joinpath("README.md").read_text() * 4
    files += [(100, "prose/about", f"{prose}\nlicense"), (101, "prose/b", "some text")]
    want |= {100: (None, "none"), 101: (None, "none")}
    assert len(full["GPL-3.0"]) > 20000 and len(prose) > 20000
    got = {r["doc_id"]: (r["license"], r["via"]) for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == want


def test_licenses_odd_and_empty(odd):
    from shelfmetrics.llm import licenses

    files = odd.withColumn("path", F.lit(None).cast("string")).withColumn("license", F.lit("x"))
    text = F.when(F.col("doc_id").isNull(), "Released under the MIT License").when(F.col("doc_id") == 9, "an uncommon zephyrword of somebody").otherwise(F.col("text"))
    for most in (32 << 20, 0):
        got = licenses.scan_licenses(files.withColumn("text", text), [*licenses.TEMPLATES, ("Own", "An uncommon zephyrword of somebody")], most_bytes=most).collect()
        assert len(got) == len(ODD) + 1
        assert {r["doc_id"]: r["license"] for r in got if r["license"]} == {None: "MIT", 9: "Own"}
    assert licenses.scan_licenses(none_of(files)).count() == 0


def test_jaccard_moves_no_keys_of_unrelated_sets(spark):
    """Sets with too many shingles of their own are out before any key is made; of others only shared shingles go on."""
    from fractions import Fraction

    random.seed(12)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows = [(k, " ".join(random.choices(vocabulary, k=random.choice([3, 8, 30, 200])))) for k in range(400)]
    passage = " ".join(random.choices(vocabulary, k=40))
    rows += [(1000 + k, f"{passage} {' '.join(random.choices(vocabulary, k=60))}") for k in range(20)]  # a shared passage is not enough
    rows += [(2000 + k, " ".join([*passage.split(), f"tail{k}"])) for k in range(3)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(6)
    got = {r["id"]: r for r in jaccard._members(df, 10**9, 3, Fraction(9, 10), 1 << 12, 10**8).collect()}
    assert set(got) == {2000, 2001, 2002}
    assert all((r["n"], r["lone"], len(r["shared"])) == (39, 1, 38 * 8) for r in got.values())


def test_jaccard_leaves_out_the_longest_lists(spark):
    """A set spares as many segments as it has lone shingles: those that most sets share."""
    slots = [(1, 2, 10 + k, 0, k * 2, 2) for k in range(5)] + [(i, 0, 10 + k, 0, k * 2, 0) for i in (2, 3) for k in range(5)] + [(i, 0, 10, 0, 0, 0) for i in range(4, 9)] + [(9, 0, 11, 0, 2, 0)]
    kept = jaccard._allocated(spark.createDataFrame(slots, jaccard._KEYS)).collect()
    assert sorted(r["key"] for r in kept if r["id"] == 1) == [12, 13, 14] and sorted(r["key"] for r in kept if r["id"] == 2) == [10, 11, 12, 13, 14]


def test_extraction_of_given_pages_by_another_parser(spark):
    """The standard library's parser, with what holds articles and what surrounds them told by hand from these pages."""
    from html.parser import HTMLParser

    class Articles(HTMLParser):
        blocks = {"article", "h1", "h2", "h3", "p", "div", "ul", "ol", "li", "blockquote", "pre", "section", "table", "tr", "td", "aside", "footer", "header", "nav", "form", "figure", "figcaption", "button", "main"}
        away = {"script", "style", "nav", "aside", "footer", "form", "button", "noscript"}

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside = self.skip = 0
            self.lines, self.now, self.skipped = [], [], []

        def flush(self):
            text = " ".join("".join(self.now).split())
            self.now = []
            if text:
                self.lines.append(text)

        def handle_starttag(self, tag, attrs):
            if tag in self.blocks:
                self.flush()
            if tag == "br":
                self.now.append(" ")
            self.inside += tag == "article"
            if self.inside and (tag in self.away or any(n in ("class", "id") and v for n, v in attrs if tag not in ("p", "article"))) and not self.skip:
                self.skipped.append(tag)
                self.skip = 1
            elif self.skip and tag == self.skipped[-1]:
                self.skip += 1

        def handle_endtag(self, tag):
            if tag in self.blocks:
                self.flush()
            if self.skip and tag == self.skipped[-1]:
                self.skip -= 1
            self.inside -= tag == "article" and self.inside > 0

        def handle_data(self, data):
            if self.inside and not self.skip:
                self.now.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extraction.extract_pages(pages).collect()}
    different = []
    for r in pages.collect():
        parser = Articles()
        parser.feed(r["html"] or "")
        parser.close()
        parser.flush()
        if got[r["page_id"]] != "\n".join(parser.lines):
            different.append((r["page_id"], got[r["page_id"]][-200:], "\n".join(parser.lines)[-200:]))
    assert len(got) == pages.count() and not different, (len(different), different[:2])
