"""Quality classifier: a weak-label model over heuristic labellers, whose posteriors train a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, released, written
from .tokens import batches_of

_EDGE = ".,;:!?\"'()[]{}*#$%&|<>~_-"
_TAIL = r"[#*$%&|<>!=~^@_]{2,}\z"

#: General insults, by kind. Kinds are separate labellers, so that none decides alone.
MOCKERY = frozenset(
    "idiot idiots moron morons imbecile imbeciles dumb dumbass stupid fool fools clown clowns loser losers halfwit dimwit nitwit dunce cretin simpleton buffoon blockhead "
    "dummkopf trottel depp idiotin imbécile crétin abruti débile estúpido tonto imbécil payaso".split()
)
CONTEMPT = frozenset(
    "scum trash garbage filth vermin worthless pathetic disgusting despicable contemptible repulsive vile lowlife scumbag degenerate creep pig swine parasite parasites cockroach "
    "abschaum widerlich wertlos ordure dégoûtant minable escoria basura asqueroso patético".split()
)
MALICE = frozenset("hate hateful bastard bastards bitch bitches asshole assholes slut whore cunt retard retarded fuck fucking shit damn hass arschloch salaud connard odio cabrón mierda".split())

#: Wishes of harm, and curses with letters masked.
THREAT = r"(?i)\b(?:kill yourself|kys|go die|drop dead|hope you die|(?:i|we)(?:'ll| will) (?:kill|hurt|find|beat) you|you (?:should|will|deserve to) (?:die|suffer|burn))\b"
MASKED = r"(?i)\b(?:f[*#@$%]{1,3}k|f[*#@$%]{3}|sh[*#@$%!]t|s[*#@$%]{2}t|b[*#@$%!]tch|b[*#@$%]{4}|c[*#@$%]{2}t|a[*#@$%]{2}hole)"

#: Labellers that overlap, none a function of others: each kind of junk, and of toxic language, is seen by several. Those called fitted learn from a bounded
#: sample of labelled rows, the others are rules. No rule can know the insults of any language; so toxic language has two fitted
#: labellers, of which one knows words, word beginnings and rates, and one word beginnings alone.
JUNK_LABELLERS = ("tails", "symbols", "marks", "capitals", "upper letters", "exclaims", "repeats", "variety", "bare marks", "plain", "fitted")
TOXIC_LABELLERS = ("mockery", "contempt", "malice", "threats", "masked", "fitted", "fitted beginnings")
#: What each fitted labeller learns: of which labels, by which features.
FITTED = (("quality", "all"), ("toxic", "all"), ("toxic", "beginnings"))
DENSE = ("tail", "symbols", "marks", "capitals", "upper", "exclaim", "adjacent", "variety", "bare", "bias")
_VOTES = "doc_id long, junk string, toxic string"
_FEATURES = "doc_id long, features array<int>, dense array<float>"
_SCORES = "doc_id long, quality_score double, toxic_score double"


@dataclass
class Batch:
    """A batch's words: their codes in order, each text's part of them, and facts by distinct word."""

    words: pa.Array  # distinct
    bare: pa.Array  # the same, lower-cased, without marks at the edges
    codes: np.ndarray
    doc: np.ndarray
    counts: np.ndarray
    texts: pa.Array

    def per_text(self, fact: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, fact[self.codes], len(self.counts))


def read_batch(texts: pa.Array) -> Batch:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(texts)
    coded = split.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    codes, doc = codes[real], doc[real]
    bare = pc.utf8_lower(pc.ascii_trim(coded.dictionary, _EDGE))
    return Batch(coded.dictionary, bare, codes, doc, np.bincount(doc, minlength=len(texts)), texts)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(np.append(at, len(x)))


def dense_of(b: Batch) -> np.ndarray:
    """Rates of a text's words with a trait, by text and in the order of DENSE."""
    n = np.maximum(b.counts, 1).astype(float)
    fact = lambda x: x.to_numpy(zero_copy_only=False).astype(float)
    same = np.zeros(len(b.codes), bool)
    same[1:] = (b.codes[1:] == b.codes[:-1]) & (b.doc[1:] == b.doc[:-1])
    kinds = np.bincount(distinct(b.doc.astype(np.int64) << 32 | b.codes)[0] >> 32, minlength=len(n))
    expected = np.minimum(n, 4 * n**0.7)  # what usual texts reach at least
    chars = np.maximum(pc.utf8_length(b.texts).to_numpy().astype(float), 1)
    part = lambda pattern: pc.count_substring_regex(b.texts, pattern).to_numpy() / (chars + 40)
    soft = lambda hits, pull=8.0: hits / (n + pull)
    return np.stack(
        [
            soft(b.per_text(fact(pc.match_substring_regex(b.words, _TAIL)))),
            part(r"[#*$%&|<>]"),
            part(r"[^\pL\pN\pM\s]"),
            soft(b.per_text(fact(pc.and_(pc.utf8_is_upper(b.words), pc.greater(pc.utf8_length(b.words), 1))))),
            part(r"\p{Lu}"),
            soft(b.per_text(fact(pc.ends_with(b.words, "!")))),
            soft(np.bincount(b.doc, same, len(n))),
            np.clip(1 - kinds / expected, 0, 1) * n / (n + 8),
            soft(b.per_text(fact(pc.match_substring_regex(b.words, r"^[^\pL\pN]*\z")))),
            np.ones(len(n)),
        ],
        1,
    )


def votes_of(b: Batch, dense: np.ndarray, junk_fit: np.ndarray, toxic_fit: np.ndarray, toxic_beginnings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labellers' votes, 1 bad, 0 good, -1 none, in the order of JUNK_LABELLERS and of TOXIC_LABELLERS.

    A rule says nothing where it sees nothing: a text without symbols may be junk of another kind.
    """
    d = dict(zip(DENSE, dense.T, strict=True))
    says = lambda bad, good=False: np.where(bad, 1, np.where(good, 0, -1))
    fitted = lambda p, bad=0.7, good=0.3: says(p > bad, p < good)  # noqa: E731  nan, without a fit: none
    plain = (d["tail"] < 0.02) & (d["symbols"] < 0.01) & (d["marks"] < 0.08) & (d["capitals"] < 0.1) & (d["adjacent"] < 0.05) & (d["variety"] < 0.3) & (b.counts > 0)
    junk = [
        says(d["tail"] > 0.12),
        says(d["symbols"] > 0.02),
        says(d["marks"] > 0.13),
        says(d["capitals"] > 0.4),
        says(d["upper"] > 0.3),
        says(d["exclaim"] > 0.25),
        says(d["adjacent"] > 0.15),
        says(d["variety"] > 0.5),
        says(d["bare"] > 0.15),
        says(False, plain),
        fitted(junk_fit),
    ]
    hits = [b.per_text(pc.is_in(b.bare, pa.array(sorted(kind), b.bare.type)).to_numpy(zero_copy_only=False).astype(float)) for kind in (MOCKERY, CONTEMPT, MALICE)]
    seen = lambda pattern: says(pc.match_substring_regex(b.texts, pattern).to_numpy(zero_copy_only=False))
    toxic = [*(says(h > 0) for h in hits), seen(THREAT), seen(MASKED), fitted(toxic_fit, 0.5, 0.05), fitted(toxic_beginnings, 0.5, 0.05)]
    return np.stack(junk, 1), np.stack(toxic, 1)


def fit_labellers(patterns: dict[str, int], labellers: int, bad_prior: float, rounds: int = 100) -> tuple[float, np.ndarray]:
    """Expectation-maximisation of the share of bad rows and of each labeller's votes by class.

    ``patterns`` counts vote patterns, one character a labeller: b bad, g good, - none. There are at most 3 to the power of
    labellers, whatever the number of rows. Labellers vote independently given the class; that one says nothing is an outcome
    like the others, as it says more of a labeller that sees most bad rows. A labeller starts with nine right votes in ten, and a two-hundredth of all
    rows speaks for that throughout, so that one without company keeps it. Returns the share, and the chances [class (good, bad), labeller, vote (none, good, bad)].
    """
    votes, weight = _coded(patterns, labellers), np.array([patterns[k] for k in patterns], float)
    total = weight.sum()
    voted = ((votes > 0) * weight[:, None]).sum(0) / max(total, 1)
    begin = np.stack([np.stack([1 - voted, *((voted * 0.9, voted * 0.1)[::step])], 1) for step in (1, -1)]) + 1e-4
    begin /= begin.sum(2, keepdims=True)
    prior, chances, pull = bad_prior, begin, 0.005 * total + 1
    for _ in range(rounds):
        bad = pattern_posterior(votes, prior, chances)
        prior = float(np.clip(((weight * bad).sum() + bad_prior * pull) / (total + pull), 1e-3, 0.5))
        counts = np.stack([np.stack([((votes == v) * (weight * row)[:, None]).sum(0) for v in range(3)], 1) for row in (1 - bad, bad)]) + pull * begin
        chances = np.maximum(counts / counts.sum(2, keepdims=True), 1e-4)
    return prior, chances


def accuracies(share: float, chances: np.ndarray) -> np.ndarray:
    """How often each labeller is right when it votes."""
    joint = chances * np.array([1 - share, share])[:, None, None]
    return (joint[0, :, 1] + joint[1, :, 2]) / joint[:, :, 1:].sum((0, 2))


def _coded(patterns: Iterable[str], labellers: int) -> np.ndarray:
    return np.array([["-gb".index(c) for c in k] for k in patterns], np.int64).reshape(-1, labellers)


def pattern_posterior(votes: np.ndarray, prior: float, chances: np.ndarray) -> np.ndarray:
    """The chance that a row is bad, for votes coded 0 none, 1 good, 2 bad."""
    each = np.log(chances[:, np.arange(votes.shape[1]), votes]).sum(2)
    return 1 / (1 + np.exp(-np.clip(np.log(prior) - np.log1p(-prior) + each[1] - each[0], -40, 40)))


def hashed_words(b: Batch, bits: int, share: float = 0.007) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, by text: its distinct words, and beginnings of four and five letters that many of its words have.

    Words have the first 2 ** bits buckets, beginnings the next. A beginning counts from two words and ``share`` of all on: families of words with one stem show whatever their endings.
    """
    import xxhash

    doc, mask = b.doc.astype(np.int64) << 32, (1 << bits) - 1

    def buckets(words: pa.Array, salt: int) -> np.ndarray:
        data = words.cast(pa.large_binary()).to_pylist()
        return np.fromiter((xxhash.xxh32_intdigest(w, salt) for w in data), np.int64, len(data)) & mask

    pairs = [distinct(doc | buckets(b.bare, 0)[b.codes])[0]]
    lengths = pc.utf8_length(b.bare).to_numpy()
    for n in (4, 5):
        begin = pc.utf8_slice_codeunits(b.bare, 0, n).dictionary_encode()
        bucket = buckets(begin.dictionary, n)[begin.indices.to_numpy()]
        longer = (lengths > n)[b.codes]
        found, many = distinct(doc[longer] | bucket[b.codes[longer]])
        pairs.append(found[(many >= 2) & (many >= share * b.counts[found >> 32])] | 1 << bits)
    both = distinct(np.concatenate(pairs))[0]
    return both >> 32, both & (mask << 1 | 1)


def train(features: list[np.ndarray], dense: np.ndarray, target: np.ndarray, bits: int, l1: float = 2e-4, rounds: int = 300) -> np.ndarray:
    """Logistic regression with soft targets and an L1 penalty on hashed words, by proximal steps over all rows.

    Step lengths follow each weight's gradient history, from a tenth on for words: with longer steps the loss jumps for hundreds of
    rounds, and rounding errors decide which weights come out. Returns the weights of the buckets, then of DENSE.
    """
    size, n = 2 << bits, len(target)
    lengths = np.fromiter(map(len, features), np.int64, n)
    index = np.concatenate([*features, np.empty(0, np.int32)]).astype(np.int32)
    used = np.flatnonzero(np.bincount(index, minlength=size))
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used))
    index = place[index]
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)
    w, v = np.zeros(len(used)), np.zeros(dense.shape[1])
    gw2, gv2 = np.full(len(used), 1e-8), np.full(dense.shape[1], 1e-8)
    for _ in range(rounds):
        z = np.bincount(row, w[index], n) + dense @ v
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / n
        gw, gv = np.bincount(index, error[row], len(used)), error @ dense + 1e-5 * v
        gw2 += gw**2
        gv2 += gv**2
        step = 0.1 / np.sqrt(gw2)
        w = w - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step, 50) * l1, 0)
        v = v - 0.5 / np.sqrt(gv2) * gv
    out = np.zeros(size)
    out[used] = w
    return np.concatenate([out, v])


def _bad(read: Batch, dense: np.ndarray, weights: np.ndarray | None, bits: int, words: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The chance of the bad class by a linear scorer; nan without one."""
    if weights is None:
        return np.full(len(read.counts), np.nan)
    z = np.bincount(words[0], weights[words[1]], len(read.counts)) + dense @ weights[2 << bits :]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _label(fits: tuple, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.array(["-", "g", "b"])
        for batch in (x for b in batches for x in batches_of(b, 1)):
            read = read_batch(batch.column(1))
            dense, words = dense_of(read), hashed_words(read, bits)
            marks = [["".join(codes[r + 1]) for r in v] for v in votes_of(read, dense, *(_bad(read, dense, w, bits, words) for w in fits))]
            yield pa.record_batch([batch.column(0), *(pa.array(m, pa.string()) for m in marks)], names=[x.split()[0] for x in _VOTES.split(", ")])

    return run


def _features(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in batches_of(b, 1)):
            read = read_batch(batch.column(1))
            doc, bucket = hashed_words(read, bits)
            parts = np.split(bucket.astype(np.int32), np.searchsorted(doc, np.arange(1, batch.num_rows)))
            columns = [batch.column(0), pa.array(parts, pa.list_(pa.int32())), pa.array(list(dense_of(read).astype(np.float32)), pa.list_(pa.float32()))]
            yield pa.record_batch(columns, names=[x.split()[0] for x in _FEATURES.split(", ")])

    return run


def _score(weights: tuple[np.ndarray, np.ndarray], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in batches_of(b, 1)):
            read = read_batch(batch.column(1))
            dense, words = dense_of(read), hashed_words(read, bits)
            bad = [_bad(read, dense, w, bits, words) for w in weights]
            yield pa.record_batch([batch.column(0), pa.array(1 - bad[0]), pa.array(bad[1])], names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def _keep(weights: tuple[np.ndarray, np.ndarray], bits: int, text: int):
    """The rows that the scorers keep, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in batches_of(b, text)):
            read = read_batch(batch.column(text))
            dense, words = dense_of(read), hashed_words(read, bits)
            junk, toxic = (_bad(read, dense, w, bits, words) for w in weights)
            yield batch.filter(pa.array((1 - junk >= 0.5) & (toxic < 0.5)))

    return run


def _fit(rows: DataFrame, chosen: DataFrame, bits: int, targets: list) -> tuple:
    """Scorers for the chosen rows, of which there are at most a sample's number.

    A target maps the chosen rows' table to values in [0, 1], and comes with the kind of features to learn from.
    """
    sample = rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    table = sample.mapInArrow(released(_features(bits)), _FEATURES).join(chosen, "doc_id").orderBy("doc_id").toPandas()
    if not len(table):
        return (None,) * len(targets)
    out, features, dense = [], [np.asarray(x) for x in table["features"]], np.stack(table["dense"].tolist()).astype(float)
    for target, kind in targets:
        own = features if kind == "all" else [f[f >= 1 << bits] for f in features]
        rates = dense if kind == "all" else dense * (np.array(DENSE) == "bias")
        out.append(train(own, rates, np.asarray(target(table), float), bits).astype(np.float32))
    del table, features, dense, own, rates
    release()
    return tuple(out)


def _smallest_hashes(rows: DataFrame, most: int, tag: str) -> DataFrame:
    """At most ``most`` rows, by a hash of the key, so that any partitioning gives the same; written, as they are used twice."""
    return written(rows.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), tag)


def _scorers(rows: DataFrame, labels: DataFrame | None, sample_rows: int, labelled_rows: int, bits: int, key: str) -> tuple[np.ndarray, np.ndarray]:
    """The weights of the scorers for junk and for toxic language, learnt from rows (doc_id, text)."""
    fits: tuple = (None,) * len(FITTED)
    if labels is not None:
        known = labels.select(F.col(key).cast("long").alias("doc_id"), "quality", "toxic").where("quality IS NOT NULL AND toxic IS NOT NULL")
        here = known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
        bad = {"quality": lambda t: t["quality"] == 0, "toxic": lambda t: t["toxic"] == 1}
        fits = _fit(rows, _smallest_hashes(here, labelled_rows, "labelled"), bits, [(bad[what], kind) for what, kind in FITTED])
    votes = written(rows.mapInArrow(released(_label(fits, bits)), _VOTES), "votes")
    targets = []
    for column, names, prior in (("junk", JUNK_LABELLERS, 0.15), ("toxic", TOXIC_LABELLERS, 0.1)):
        patterns = {r[0]: r[1] for r in votes.groupBy(column).count().collect()}  # bounded by the number of labellers
        model = dict(zip(patterns, pattern_posterior(_coded(patterns, len(names)), *fit_labellers(patterns, len(names), prior)).tolist(), strict=True))
        targets.append((lambda t, column=column, model=model: t[column].map(model), "all"))
    weights = _fit(rows, _smallest_hashes(votes, sample_rows, "sample"), bits, targets)
    none = np.zeros((2 << bits) + len(DENSE), np.float32)
    return tuple(none if w is None else w for w in weights)


def classify(
    docs: DataFrame, labels: DataFrame | None = None, sample_rows: int = 8000, labelled_rows: int = 6000, bits: int = 18, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Scores every document for quality and for toxic language.

    Labellers vote on every whole text: rules, and some that are fitted on at most ``labelled_rows`` rows of
    labels (key, quality, toxic), where these are given. For junk and for toxic language apart, expectation-maximisation
    over the counts of vote patterns of all documents gives the labellers' accuracies. The posteriors label a sample of
    at most ``sample_rows`` documents, and train two linear scorers over hashed words, frequent word beginnings and rates.
    All documents are scored by these; one is kept if its quality score is at least a half and its toxic score below.
    Either sample is of the smallest hashes of keys.

    Returns key, quality_score, toxic_score, kept. Null or empty text: scored as a text without words. Repeated rows count
    and are scored as often as they occur; rows of labels with equal keys: any one. Null keys are scored too. No rows:
    no rows. Extra columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = rows.mapInArrow(released(_score(_scorers(rows, labels, sample_rows, labelled_rows, bits, key), bits)), _SCORES)
    return scored.withColumn("kept", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5)).withColumnRenamed("doc_id", key)


def kept_documents(
    docs: DataFrame, labels: DataFrame | None = None, sample_rows: int = 8000, labelled_rows: int = 6000, bits: int = 18, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents that ``classify`` keeps, all columns kept. Each row is judged by its own text and needs no key."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    weights = _scorers(rows, labels, sample_rows, labelled_rows, bits, key)
    return docs.mapInArrow(released(_keep(weights, bits, docs.columns.index(text))), docs.schema)
