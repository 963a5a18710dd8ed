"""Benchmark decontamination: a BM25 index of test items, queried by every training passage with block-max WAND."""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator, Sized
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, WORD_RE, released, written
from .jaccard import mix
from .tokens import batches_of

#: All ASCII marks, and those of Unicode's Latin-1, general punctuation and CJK and full-width blocks.
_EDGE = string.punctuation + "¡§«¶·»¿" + "".join(map(chr, [*range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x3001, 0x3004), *range(0x3008, 0x3012), 0xFF01, 0xFF08, 0xFF09, 0xFF0C, 0xFF0E, 0xFF1A, 0xFF1B, 0xFF1F]))
_A = np.uint64(0x9E3779B97F4A7C15)
_HITS = "doc_id long, item_id long, passage long, bm25 double, question_overlap double, answer_overlap double"


def terms_of(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their edges; words that are punctuation only go."""
    return [t for w in WORD_RE.findall((text or "").translate(ASCII_LOWER)) if (t := w.strip(_EDGE))]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """An item's two parts: its last line, or for one line its last sentence, is the answer; all before it the question.

    Where that leaves a part under five words, the whole item is the question and there is no answer to test.
    """
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) < 2:
        lines = re.split(r"(?<=[.!?])\s+", text.strip())
    question, answer = terms_of(" ".join(lines[:-1])), terms_of(lines[-1]) if lines else []
    return (question, answer) if len(question) >= 5 and len(answer) >= 5 else (terms_of(text), [])


def is_short(runs: Sized, overlap: float, n: int) -> bool:
    """Whether one altered word could take so many of an answer's runs that fewer than ``overlap`` are left."""
    return len(runs) - min(n, len(runs)) < overlap * len(runs)


def shingles(words: list[str], n: int) -> set[tuple[str, ...]]:
    """Runs of n words; a shorter list as one."""
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def runs_of(numbers: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the distinct runs of ``n`` numbers, sorted; a shorter list is one run."""
    if len(numbers) == 0:
        return np.empty(0, np.uint64)
    n = min(n, len(numbers))
    out = np.full(len(numbers) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * _A + numbers[k : k + len(out)].astype(np.uint64))
    return np.unique(out)


@dataclass
class Lists:
    """Lists of items with weights, one for each term and one after another: term t has those from starts[t] on."""

    starts: np.ndarray
    items: np.ndarray  # ascending in a list
    weights: np.ndarray

    @classmethod
    def of(cls, terms: int, term: np.ndarray, item: np.ndarray, weight: np.ndarray) -> Lists:
        order = np.lexsort((item, term))
        return cls(np.searchsorted(term[order], np.arange(terms + 1)), item[order], weight[order])

    def blocks(self, size: int) -> Blocks:
        """Each list in blocks of ``size`` items."""
        counts = np.diff(self.starts)
        many = -(-counts // size)
        starts = np.concatenate([[0], np.cumsum(many)])
        begin = np.repeat(self.starts[:-1], many) + (np.arange(starts[-1]) - np.repeat(starts[:-1], many)) * size
        ends = np.minimum(begin + size, np.repeat(self.starts[1:], many)) - 1
        most = np.maximum.reduceat(self.weights, begin) if len(begin) else np.empty(0)
        top = np.zeros(len(counts))
        np.maximum.at(top, np.repeat(np.arange(len(counts)), many), most)
        return Blocks(starts, self.items[ends], most, top)


@dataclass
class Blocks:
    starts: np.ndarray
    ends: np.ndarray  # the last item of each block
    most: np.ndarray  # the largest weight in each block
    top: np.ndarray  # the largest weight in each list


class BM25Index:
    """Lists of items with BM25 weights, in blocks with their largest weights.

    A weight is the term's BM25 contribution divided by the score that the item's own words give it, so a passage
    with all of an item's words scores 1 and one threshold suits short and long items. ``statistics`` are the number of all items,
    their mean length, and how many have each term; without them, those of the given items.

    An item's commonest terms, of up to ``common`` of its score in all, have lists of their own, which are only looked into for
    an item that the others have brought up: no item can reach a higher score by them alone. Items are ordered by the power
    of two that their length reaches, so that each class of lengths is a range.
    """

    def __init__(self, items: list[tuple[int, str | None]], statistics: tuple[int, float, dict[str, int]] | None = None, common: float = 0.5, k1: float = 1.2, b: float = 0.75, block: int = 32, least: int = 64):
        words = [terms_of(t) for _, t in items]
        size = lambda w: max(least, 1 << (len(w) - 1).bit_length()) if w else least
        order = sorted(range(len(items)), key=lambda k: size(words[k]))
        words, items = [words[k] for k in order], [items[k] for k in order]
        self.ids = [i for i, _ in items]
        sizes = np.array([size(w) for w in words], np.int64)
        #: (length, first item, item after the last) of each class
        self.classes = [(int(v), int(np.searchsorted(sizes, v)), int(np.searchsorted(sizes, v, "right"))) for v in np.unique(sizes)]
        self.terms = sorted({t for w in words for t in w})
        self.term_array = pa.array(self.terms, pa.large_string())
        self.number_of = {t: k for k, t in enumerate(self.terms)}
        counts = [Counter(w) for w in words]
        n, mean, frequency = statistics or (len(items), sum(map(len, words)) / max(1, len(items)), Counter(t for c in counts for t in c))
        df = np.array([frequency[t] for t in self.terms], float)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        item = np.repeat(np.arange(len(items)), [len(c) for c in counts])
        term = np.array([self.number_of[t] for c in counts for t in c], np.int64)
        f = np.array([x for c in counts for x in c.values()], float)
        length = np.array([len(w) for w in words], float)[item]
        raw = idf[term] * f * (k1 + 1) / (f + k1 * (1 - b + b * length / (mean or 1)))
        weight = raw / np.bincount(item, raw, len(items))[item]
        # each item's terms from the commonest to the rarest
        order = np.lexsort((term, -df[term], item))
        before = np.cumsum(weight[order])
        first = np.searchsorted(item, np.arange(len(items)))
        is_common = np.zeros(len(item), bool)
        is_common[order] = before - (before[first] - weight[order][first])[item] <= common if len(item) else False
        #: of each item's score, what its common terms give
        self.rest = np.bincount(item[is_common], weight[is_common], len(items))
        self.common = Lists.of(len(self.terms), term[is_common], item[is_common], weight[is_common])
        self.lists = Lists.of(len(self.terms), term[~is_common], item[~is_common], weight[~is_common])
        self.blocks = self.lists.blocks(block)
        numbers = lambda part: np.array([self.number_of[t] for t in part], np.int64)
        self.parts = [tuple(map(numbers, question_and_answer(t or ""))) for _, t in items]

    def search(self, terms: list[int], threshold: float, low: int = 0, high: int | None = None) -> list[tuple[int, float]]:
        """All items from low to before high that score ``threshold`` or more for the terms, by block-max WAND.

        Cursors run over the terms' lists without the common ones, whose most is added to every bound.
        """
        high, least = len(self.ids) if high is None else high, threshold - 1e-9
        rest = float(self.rest[low:high].max(initial=0.0))
        items, weights, blocks = self.lists.items, self.lists.weights, self.blocks
        cursors = []  # place, end of the list, term
        for t in terms:
            a, b = self.lists.starts[t], self.lists.starts[t + 1]
            at, end = a + np.searchsorted(items[a:b], low), a + np.searchsorted(items[a:b], high)
            if at < end:
                cursors.append([int(at), int(end), t])
        found = []
        while cursors:
            cursors.sort(key=lambda c: items[c[0]])
            bound = rest
            pivot = next((k for k, c in enumerate(cursors) if (bound := bound + blocks.top[c[2]]) >= least), None)
            if pivot is None:
                break
            item = int(items[cursors[pivot][0]])
            while pivot + 1 < len(cursors) and items[cursors[pivot + 1][0]] == item:
                pivot += 1
            # the blocks that could hold the item bound its score more tightly than whole lists do
            bound, border = rest, high
            for _, _, t in cursors[: pivot + 1]:
                a, b = blocks.starts[t], blocks.starts[t + 1]
                at = a + np.searchsorted(blocks.ends[a:b], item)
                if at < b:
                    bound += blocks.most[at]
                    border = min(border, int(blocks.ends[at]))
            if bound < least:
                # nothing up to the nearest block's end, or before the next list's item, can reach the threshold
                target = border + 1 if pivot + 1 == len(cursors) else max(item + 1, min(border + 1, int(items[cursors[pivot + 1][0]])))
            else:
                target = item + 1
                score = sum(self._weight(self.lists, t, item) for _, _, t in cursors[: pivot + 1])
                if score + self.rest[item] >= least:
                    score += sum(self._weight(self.common, t, item) for t in terms)
                    if score >= least:
                        found.append((item, float(score)))
            for c in cursors[: pivot + 1]:
                if items[c[0]] < target:
                    c[0] += int(np.searchsorted(items[c[0] : c[1]], target))
            cursors = [c for c in cursors if c[0] < c[1]]
        return found

    @staticmethod
    def _weight(lists: Lists, term: int, item: int) -> float:
        a, b = lists.starts[term], lists.starts[term + 1]
        at = a + np.searchsorted(lists.items[a:b], item)
        return float(lists.weights[at]) if at < b and lists.items[at] == item else 0.0


def _promising(index: BM25Index, passage: np.ndarray, number: np.ndarray, threshold: float, low: int, high: int, most: int) -> list[int]:
    """The passages of which WAND's bound, taken item by item over the lists, lets some item from low to before high reach the threshold.

    ``passage`` and ``number`` are a word's passage, in order, and its term. At most about ``most`` entries of lists are
    held at once, besides those of a single passage, which has each list once.
    """
    lists = index.lists
    if (low, high) == (0, len(index.ids)):
        begin, end = lists.starts[:-1], lists.starts[1:]
    else:  # the lists' parts of the range
        inside = np.concatenate([[0], np.cumsum((lists.items >= low) & (lists.items < high))])
        below = np.concatenate([[0], np.cumsum(lists.items < low)])
        begin = lists.starts[:-1] + below[lists.starts[1:]] - below[lists.starts[:-1]]
        end = begin + inside[lists.starts[1:]] - inside[lists.starts[:-1]]
    many = np.append(end - begin, 0)
    used = many[number] > 0
    pair = np.unique(passage[used] * np.int64(len(many)) + number[used])
    passage, number = np.divmod(pair, np.int64(len(many)))
    many = many[number]
    total, out, at = np.cumsum(many), [], 0
    while at < len(pair):
        # up to the last whole passage within the limit, or one passage
        upto = int(np.searchsorted(total, total[at] - many[at] + most, "right"))
        upto = len(pair) if upto >= len(pair) else max(int(np.searchsorted(passage, passage[upto])), at)
        if upto == at:
            upto = int(np.searchsorted(passage, passage[at], "right"))
        m, p, t = many[at:upto], passage[at:upto], number[at:upto]
        entry = np.repeat(begin[t] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        item = lists.items[entry]
        key, where = np.unique(np.repeat(p, m) * np.int64(len(index.ids)) + item, return_inverse=True)
        bound = np.bincount(where, lists.weights[entry], len(key)) + index.rest[key % len(index.ids)]
        out += np.unique(key[bound >= threshold - 1e-9] // len(index.ids)).tolist()
        at = upto
    return out


def _find(index: BM25Index, threshold: float, overlap: float, n: int, most: int = 2_000_000):
    questions = [(runs_of(q, n), runs_of(a, n)) for q, a in index.parts]
    # short answers are tested by words, each as often as it stands in the answer
    by_words = [Counter(a.tolist()) if len(a) and is_short(runs, overlap, n) else None for (_, a), (_, runs) in zip(index.parts, questions, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in batches_of(b, 1, 4 << 20)):
            texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
            words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
            coded = words.flatten().dictionary_encode()
            distinct = pc.utf8_trim(coded.dictionary, _EDGE)
            unknown = len(index.terms)
            term = pc.fill_null(pc.index_in(distinct, index.term_array), unknown).to_numpy()
            # words of punctuation only must not count as places; others do, known or not
            coded_at = coded.indices.to_numpy()
            real = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)[coded_at]
            offsets = words.offsets.to_numpy() - words.offsets[0].as_py()
            places = np.concatenate([[0], np.cumsum(real)])[offsets]
            number = term[coded_at[real]].astype(np.int64)
            at = np.flatnonzero(number < unknown)
            doc = np.searchsorted(places, at, "right") - 1
            rows: dict[tuple[int, int], tuple[float, int]] = {}
            word_share: dict[tuple[int, int], float] = {}
            for step, low, high in index.classes:
                # passages of twice the class's length, half overlapping, numbered through all documents
                first = np.concatenate([[0], np.cumsum(-(-np.diff(places) // step))])
                later = (at - places[doc]) // step
                passage = np.concatenate([first[doc] + later, (first[doc] + later - 1)[later > 0]])
                for k in _promising(index, passage, np.concatenate([number[at], number[at][later > 0]]), threshold, low, high, most):
                    d = int(np.searchsorted(first, k, "right")) - 1
                    begin = int(places[d] + (k - first[d]) * step)
                    known = set(number[begin : min(begin + 2 * step, int(places[d + 1]))].tolist()) - {unknown}
                    for hit, score in index.search(sorted(known), threshold, low, high):
                        if (answer_words := by_words[hit]) is not None:
                            share_here = sum(c for t, c in answer_words.items() if t in known) / answer_words.total()
                            word_share[d, hit] = max(share_here, word_share.get((d, hit), 0.0))
                        if score > rows.get((d, hit), (0.0, 0))[0]:
                            rows[d, hit] = score, int(begin - places[d])
            out, held = [], {}
            keys = batch.column(0).to_pylist()
            for (d, item), (score, begin) in rows.items():
                if d not in held:
                    held[d] = runs_of(number[places[d] : places[d + 1]], n)
                question, answer = (float(np.isin(s, held[d], assume_unique=True).mean()) if len(s) else None for s in questions[item])
                if (d, item) in word_share:
                    answer = max(answer or 0.0, word_share[d, item])
                if (question or 0.0) >= overlap and (answer is None or answer >= overlap):
                    out.append((keys[d], index.ids[item], begin, score, question, answer))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _HITS.split(", ")])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [terms_of(t) for t in batch.column(1).to_pylist()]
        columns = [*batch.columns, pa.array([sorted(set(w)) for w in words], pa.list_(pa.string())), pa.array(map(len, words), pa.int64())]
        yield pa.record_batch(columns, names=["item_id", "text", "terms", "length"])


def _indexes(items: DataFrame, block_bytes: int, common: float) -> Iterator[BM25Index]:
    """Indexes of blocks of items with the statistics of all items; one block is on the driver at a time."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    rows = written(rows.mapInArrow(released(_item_terms), "item_id long, text string, terms array<string>, length long").where("length > 0").withColumn("_row", F.monotonically_increasing_id()), "items")
    n, mean = rows.agg(F.count("*"), F.avg("length")).first()
    term = rows.select("_row", F.explode("terms").alias("term"))
    frequency = term.groupBy("term").agg(F.count("*").alias("df"))
    known = term.join(frequency, "term").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("df"))
    block: list[tuple[int, str]] = []
    held, counts = 0, {}
    # toLocalIterator holds one partition at a time, and a block is all that is kept of them
    for item in rows.join(known, "_row").orderBy("item_id", "text").select("item_id", "text", "df").toLocalIterator():
        block.append((item.item_id, item.text))
        counts.update(item.df)
        held += len(item.text.encode())
        if held >= block_bytes:
            yield BM25Index(block, (n, mean, counts), common)
            block, held, counts = [], 0, {}
    if block:
        yield BM25Index(block, (n, mean, counts), common)


def contaminated(
    docs: DataFrame, items: DataFrame, threshold: float = 0.7, overlap: float = 0.8, n: int = 5, block_bytes: int = 4 << 20, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The (document, item) pairs in which a document holds a test item.

    Every document is cut into passages, for each class of item lengths (powers of two) of twice the class's words, half overlapping, so that an item of any length
    lies whole in one. Each passage queries a BM25 index of the items; block-max WAND retrieves all items that score
    ``threshold`` of their own full score. WAND's first bound is taken for many passages at once, item by item: what the
    passage's words give the item by its rarer terms' lists, plus all that its common terms, of 0.7 of the threshold at most, could. A pair stays if the document has ``overlap`` of the ``n``-word runs of the
    item's question, and of its answer where it has one. An answer so short that one altered word could take more runs
    than that allows also passes if one retrieved passage has ``overlap`` of its words; answer_overlap is then the larger share.

    The index is sent to the executors, so the items are taken in blocks of at most ``block_bytes`` of text, each
    with an index and a pass over the documents of its own: any number of items works, with bounded memory. Item
    statistics are those of all items, so blocks don't change the result.

    Returns key, item_id, passage (its first word's place), bm25 (of the best passage), question_overlap, answer_overlap
    (null without an answer); one row for each pair of rows. Null or empty texts and items, and items of marks only: no pairs. Repeated
    documents or items: a pair for each. No items or documents: no rows. Extra columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = docs.sparkSession.createDataFrame([], _HITS)
    for index in _indexes(items, block_bytes, 0.7 * threshold):
        found = found.unionByName(rows.mapInArrow(released(_find(index, threshold, overlap, n)), _HITS))
    return found.withColumnRenamed("doc_id", key)


def clean_of(docs: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents without a pair, all columns kept. A document with a null key stays."""
    return docs.join(hits.select(F.col(key).alias("_hit")).distinct(), F.col(key) == F.col("_hit"), "left_anti")
