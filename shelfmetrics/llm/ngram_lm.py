"""Language-model scoring by deleted interpolation of trigram, bigram, unigram and uniform estimates.

A text's tokens are its words and one end. The probability of a token w after g, h is

    l3[b] c(g, h, w) / c(g, h) + l2[b] c(h, w) / c(h) + l1[b] c(w) / N + l0[b] / (V + 1)

with counts of the training texts and weights that depend on b, the bucket of the frequency of the context g, h, or of h
where g, h is unknown or the text has begun with h. The weights are
learned by expectation-maximisation on held-out training texts, with counts of the other training texts.

Texts are turned into blocks of token numbers once. Each block asks for the counts of its distinct words, then of bigrams of which other
blocks have both words, then of trigrams of which other blocks have both bigrams: no others can be elsewhere. The
questions, with the block's own counts, meet by key, and only keys of several blocks are answered. So counts are those of the whole corpus,
no task holds more than a block or a slice of the keys, and what is exchanged grows with the distinct keys of blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import pack, unpack
from .common import released, write_table, written
from .tokens import batches_of

KEPT, DELETED, HELD_OUT = 0, 1, 2  # learned from; learned from, and held out for the weights; scored only
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_END, _START = np.uint64(1), np.uint64(2)
#: Bits by which bigrams and trigrams are told apart, beyond those of the number of tokens: one in 2^16 meets another.
SPARE_BITS = 16
_BLOCKS = "block long, payload binary, tokens long"
_ASKED = "part int, block long, payload binary"
_ANSWERS = "block long, payload binary, kept long, deleted long, kinds long, kept_kinds long, starts_kept long, starts_deleted long"
_CELLS = "bucket int, three int, two int, one int, n long"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
#: Contexts of one word have the first buckets, contexts of two the next.
BUCKETS = 80
CHUNK = 1 << 18
_FINENESS = 4  # cells of probability ratios in an octave, for the weights only


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def fold_of(doc_id: int | None, folds: int = 7, held_out: int = 2, deleted: int = 5) -> int:
    """A text's part, by the crc32 of its id as text; a null id counts as an empty text."""
    rest = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds
    return HELD_OUT if rest == held_out else DELETED if rest == deleted else KEPT


def _tokenise(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def block() -> pa.RecordBatch:
            nonlocal number
            # words of all slices get one numbering
            names = pa.chunked_array([h[2] for h in held]).unify_dictionaries()
            words = names.chunk(0).dictionary.cast(pa.large_binary()).to_pylist()
            hashes = np.fromiter((_word(xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
            ids = np.concatenate([c.indices.to_numpy() for c in names.chunks])
            counts = np.concatenate([h[1] for h in held])
            doc = np.repeat(np.arange(len(counts)), counts)
            flat = np.full(len(ids) + len(counts), len(words), np.int32)
            flat[np.arange(len(ids)) + doc] = ids  # an end follows each text
            docs = [i for h in held for i in h[0]]
            known = np.array([0 if i is None else i for i in docs], np.int64)
            payload = pack(
                docs=known, null=np.array([i is None for i in docs], np.uint8), folds=np.array([fold_of(i) for i in docs], np.uint8),
                ends=np.cumsum(counts + 1), words=np.append(hashes, _END), ids=flat,
            )
            number += 1
            return pa.record_batch([pa.array([number], pa.int64()), pa.array([payload], pa.binary()), pa.array([len(flat)], pa.int64())], names=["block", "payload", "tokens"])

        for batch in (x for b in batches for x in batches_of(b, 1, min(block_bytes, 2 << 20))):
            split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(1).cast(pa.large_string()), "")))
            flat, lengths = split.flatten(), np.diff(split.offsets.to_numpy())
            real = pc.not_equal(flat, "")
            doc = np.repeat(np.arange(len(lengths)), lengths)
            counts = np.bincount(doc[real.to_numpy(zero_copy_only=False)], minlength=len(lengths))
            held.append((batch.column(0).to_pylist(), counts, flat.filter(real).dictionary_encode()))
            size += batch.nbytes
            if size >= block_bytes:
                yield block()
                held, size = [], 0
        if held:
            yield block()

    return run


def _word(digest: int) -> int:
    """A word's hash, clear of the marks of a text's start and end."""
    return digest if digest > 2 else digest + 3


def _grouped(token: np.ndarray, bits: int, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys of ``bits`` bits, sorted, each token's key's place, and the keys' kept and deleted counts."""
    token = token >> np.uint64(64 - bits)
    order = np.argsort(token).astype(np.int32)
    token = token[order]
    first = np.concatenate([[True], token[1:] != token[:-1]])
    keys = token[first]
    del token
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(first, dtype=np.int32) - 1
    del order, first
    return keys, place, _counts(place, fold, len(keys))


def _counts(place: np.ndarray, fold: np.ndarray, n: int) -> list[np.ndarray]:
    """How often each of n keys stands in learned and in deleted texts, in 32 bits until other blocks' counts are added."""
    return [np.bincount(place[fold == f], minlength=n).astype(np.uint32) for f in (KEPT, DELETED)]


@dataclass
class Counted:
    """A block's tokens, and its distinct words, bigrams and trigrams with the block's own counts.

    ``keys[k]`` are the sorted keys of runs of k + 1 tokens, ``place[k]`` each token's (of the run that ends with it), ``counts[k]`` their kept and deleted counts.
    A run that begins before its text has the text's start as its first token, and no trigram begins before that.
    """

    docs: np.ndarray
    null: np.ndarray
    folds: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    before: np.ndarray  # the place of the word before in the words, or -1 at a text's start
    first: np.ndarray  # whether a token is a text's first
    keys: list[np.ndarray]
    place: list[np.ndarray]
    counts: list[list[np.ndarray]]

    @classmethod
    def of(cls, payload: bytes, bits: int, upto: int = 3) -> Counted:
        x = unpack(payload)
        ids, ends, folds = x["ids"], x["ends"], x["folds"]
        lengths = np.diff(ends, prepend=0)
        doc = np.repeat(np.arange(len(ends), dtype=np.int32), lengths)
        first = np.zeros(len(ids), bool)
        first[ends - lengths] = True
        fold = folds[doc]
        word = _mix(x["words"] ^ _B)
        order = np.argsort(word)
        rank = np.empty(len(word), np.int32)
        rank[order] = np.arange(len(word))
        ids = rank[ids]
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[first] = -1
        keys, place = [word[order]], [ids]
        counts = [_counts(ids, fold, len(word))]
        if upto > 1:
            hashes = np.append(x["words"][order], _START)  # place -1 is the start
            pair = _mix(hashes[before] * _A + hashes[ids] * _B + _A)
            found = _grouped(pair, bits, fold)
            for out, new in zip((keys, place, counts), found, strict=True):
                out.append(new)
            if upto > 2:
                pair[1:] = pair[:-1]
                pair[first] = _A  # a text's first token has no context of two
                pair *= _B
                pair += hashes[ids] * _A + _B
                found = _grouped(_mix(pair), bits, fold)
                for out, new in zip((keys, place, counts), found, strict=True):
                    out.append(new)
        return cls(x["docs"], x["null"], folds, ends, doc, before, first, keys, place, counts)

    def answered(self, paths: list[str], block: int) -> Counted:
        """The counts of all blocks in place of the block's own, where other blocks have the key, too."""
        from pyarrow import fs

        for kind, path in enumerate(paths):
            # sums over all blocks may pass 32 bits: words' have 64 at once, others when they need them
            self.counts[kind] = [c.astype(np.int64) for c in self.counts[kind]] if kind == 0 else self.counts[kind]
            for x in _answers(*fs.FileSystem.from_uri(path), block):
                at = np.searchsorted(self.keys[kind], x["keys"])
                if kind and len(at) and self.counts[kind][0].dtype == np.uint32 and max(int(x["kept"].max()), int(x["deleted"].max())) >> 32:
                    self.counts[kind] = [c.astype(np.int64) for c in self.counts[kind]]
                self.counts[kind][0][at], self.counts[kind][1][at] = x["kept"], x["deleted"]
        return self

    def elsewhere(self, path: str, block: int, kind: int) -> np.ndarray:
        """Which of the block's keys of a kind other blocks have."""
        from pyarrow import fs

        out = np.zeros(len(self.keys[kind]), bool)
        for x in _answers(*fs.FileSystem.from_uri(path), block):
            out[np.searchsorted(self.keys[kind], x["keys"])] = True
        return out

    def estimates(self, at: slice | np.ndarray, counts: list[np.ndarray], starts: int, total: int, kinds: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The bucket of each token's context, and the trigram's, bigram's, unigram's and uniform estimates."""
        one = counts[0][self.place[0][at]]
        context = np.where(self.before[at] < 0, starts, counts[0][self.before[at]])
        three, wide = np.zeros(len(one)), np.zeros(len(one), np.int64)
        if len(self.keys) > 2:
            pair = np.concatenate([[0], self.place[1][:-1]])[at]
            wide = np.where(self.first[at], 0, counts[1][pair])
            three = np.where(wide > 0, counts[2][self.place[2][at]] / np.maximum(wide, 1), 0.0)
        two = counts[1][self.place[1][at]] / np.maximum(context, 1)
        bucket = np.where(wide > 0, BUCKETS // 2 + np.minimum(_bucket(wide), BUCKETS // 2 - 1), np.minimum(_bucket(context), BUCKETS // 2 - 1))
        return bucket, [three, two, one / max(total, 1), np.full(len(one), 1 / (kinds + 1))]


def _answers(system, path: str, block: int) -> Iterator[dict[str, np.ndarray]]:
    """The answers to a block, from its own folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    for file in system.get_file_info(fs.FileSelector(f"{path}/block={block}", allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with system.open_input_file(file.path) as source:
                for some in pq.ParquetFile(source).iter_batches(8, columns=["payload"]):
                    yield from map(unpack, some.column(0).to_pylist())


def _ask(parts: int, kind: int, bits: int, path: str | None = None):
    """A block's questions, for words (kind 0), bigrams (1) or trigrams (2). With the answers on shorter runs at ``path``, runs of
    which no other block has both shorter ones aren't asked for: no other block can have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            c = Counted.of(payload, bits, kind + 1)
            keys, (kept, deleted) = c.keys[kind], c.counts[kind]
            if kind:
                shared = c.elsewhere(path, block, kind - 1)
                last = shared[c.place[kind - 1]]
                if kind == 1:
                    both = last & np.where(c.before < 0, True, shared[c.before])
                else:
                    both = last & np.concatenate([[False], last[:-1]]) & ~c.first
                wanted = np.zeros(len(keys), bool)
                wanted[c.place[kind][both]] = True
                keys, kept, deleted = keys[wanted], kept[wanted], deleted[wanted]
            del c
            edges = np.array([(k << (bits if kind else 64)) // parts for k in range(1, parts)], np.uint64)
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            rows = []
            for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                if b > a:
                    rows.append((part, block, pack(kind=np.array([kind], np.uint8), keys=keys[a:b], kept=kept[a:b].astype(np.uint32), deleted=deleted[a:b].astype(np.uint32))))
            for k in range(0, len(rows), 64):
                columns = zip(*rows[k : k + 64], strict=True)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["part", "block", "payload"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part: sums by key, answers to the blocks of keys with several, and the part's totals of words under block -1."""
    names = [x.split()[0] for x in _ANSWERS.split(", ")]
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 6]
    end_key = _mix(np.array([_END]) ^ _B)[0]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def done(rows: list[tuple[int, dict]]) -> Iterator[pa.RecordBatch]:
        for kind in (0, 1, 2):
            own = [(b, x) for b, x in rows if x["kind"][0] == kind]
            if not own:
                continue
            keys = np.concatenate([x["keys"] for _, x in own])
            block = np.repeat(np.array([b for b, _ in own]), [len(x["keys"]) for _, x in own])
            order = np.argsort(keys, kind="stable")
            keys, block = keys[order], block[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            many = np.diff(np.append(starts, len(keys)))
            sums = [np.add.reduceat(np.concatenate([x[c] for _, x in own])[order].astype(np.int64), starts) for c in ("kept", "deleted")]
            if kind == 0:
                end = np.flatnonzero(keys[starts] == end_key)
                ends = [int(s[end[0]]) if len(end) else 0 for s in sums]
                yield batch_of([(-1, b"", int(sums[0].sum()), int(sums[1].sum()), int((sums[0] + sums[1] > 0).sum()), int((sums[0] > 0).sum()), *ends)])
            shared = np.repeat(many > 1, many)
            key, at, kept, deleted = keys[shared], block[shared], np.repeat(sums[0], many)[shared], np.repeat(sums[1], many)[shared]
            by = np.argsort(at, kind="stable")
            key, at, kept, deleted = key[by], at[by], kept[by], deleted[by]
            cuts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])).tolist() if len(at) else []
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(at)][: len(cuts)], strict=True):
                payload = pack(kind=np.array([kind], np.uint8), keys=key[a:b], kept=kept[a:b], deleted=deleted[a:b])
                out.append((int(at[a]), payload, None, None, None, None, None, None))
            for k in range(0, len(out), 64):
                yield batch_of(out[k : k + 64])

    part, rows = None, []
    for p, b, payload in (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
        if p != part:
            yield from done(rows)
            part, rows = p, []
        rows.append((b, unpack(payload)))
    yield from done(rows)


def _bucket(context: np.ndarray) -> np.ndarray:
    """The bit length of a context's count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))) + 1, 0).astype(np.int64)


def _held_out_cells(paths: list[str], bits: int, kept_total: int, kept_kinds: int, kept_starts: int):
    """Counts of held-out tokens by bucket and by the ratios of the estimates to the uniform one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            c = Counted.of(payload, bits, len(paths)).answered(paths, block)
            on = np.flatnonzero(c.folds[c.doc] == DELETED)
            kept = [x[0] for x in c.counts]
            c.counts.clear()
            bucket, estimates = c.estimates(on, kept, kept_starts, kept_total, kept_kinds)
            ratio = lambda p, u=estimates[3]: np.where(p > 0, np.round(np.log2(np.maximum(p, 1e-300) / u) * _FINENESS).clip(-500, 500) + 512, 0).astype(np.int64)
            three, two, one = map(ratio, estimates[:3])
            cell, n = np.unique(bucket << 30 | three << 20 | two << 10 | one, return_counts=True)
            columns = (*((cell >> k & 1023, pa.int32()) for k in (30, 20, 10, 0)), (n, pa.int64()))
            yield pa.record_batch([pa.array(x, t) for x, t in columns], names=["bucket", "three", "two", "one", "n"])

    return run


def learn_weights(cells: list[tuple[int, int, int, int, int]], rounds: int = 100) -> np.ndarray:
    """Expectation-maximisation of each bucket's weights (three, two, one, uniform) from held-out cells.

    A bucket without tokens takes the weights of the nearest one below. Weights start even, and one token of each estimate
    is added, so that none becomes zero but the bigram's in contexts never seen, and the trigram's in contexts of one word.
    """
    half = BUCKETS // 2
    weights = np.full((BUCKETS, 4), 1 / 4)
    weights[:half] = (0.0, 1 / 3, 1 / 3, 1 / 3)
    weights[0] = (0.0, 0.0, 0.5, 0.5)
    table = np.array(cells, float).reshape(-1, 5)
    seen = np.isin(np.arange(BUCKETS), table[:, 0])
    for b in np.flatnonzero(seen).tolist():
        own = table[table[:, 0] == b, 1:]
        p = np.stack([np.where(own[:, k] > 0, 2.0 ** ((own[:, k] - 512) / _FINENESS), 0.0) for k in range(3)] + [np.ones(len(own))], 1)
        w = weights[b].copy()
        for _ in range(rounds):
            part = p * w
            part *= (own[:, 3] / part.sum(1))[:, None]
            w = (part.sum(0) + (w > 0)) / (part.sum() + (w > 0).sum())
        weights[b] = w
    for b in [*range(2, half), *range(half + 2, BUCKETS)]:
        if not seen[b]:
            weights[b] = weights[b - 1]
    return weights


def _score(paths: list[str], bits: int, weights: np.ndarray, total: int, kinds: int, starts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, payload in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            c = Counted.of(payload, bits, len(paths)).answered(paths, block)
            counts = []
            while c.counts:
                kept, deleted = c.counts.pop(0)
                counts.append(kept + deleted if kept.dtype == np.int64 or int(kept.max(initial=0)) + int(deleted.max(initial=0)) < 1 << 32 else kept.astype(np.int64) + deleted)
                del kept, deleted
            n, size = len(c.ends), len(c.doc)
            base, score, known = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            for k in range(0, size, CHUNK):  # arrays of a chunk's tokens only
                at = np.arange(k, min(k + CHUNK, size))
                bucket, estimates = c.estimates(at, counts, starts, total, kinds)
                count, doc = counts[0][c.place[0][at]], c.doc[at]
                p = sum(weights[bucket, i] * x for i, x in enumerate(estimates))
                base += np.bincount(doc, np.log10(count + 1.0), n)
                score += np.bincount(doc, np.log10(p), n)
                known += np.bincount(doc[count > 0], minlength=n)
            tokens = np.diff(c.ends, prepend=0)
            columns = (
                (pa.array(c.docs, pa.int64(), mask=c.null.astype(bool))), pa.array(c.folds == HELD_OUT), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                pa.array(base - tokens * np.log10(float(total + kinds + 1))), pa.array(score),
            )
            yield pa.record_batch(list(columns), names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def interpolated_scores(docs: DataFrame, order: int = 3, block_bytes: int = 10 << 20, slice_tokens: int = 4_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every text with an interpolated model of the training texts: of trigrams, or with order 2 of bigrams.

    Training texts are those whose id's crc32, as text, modulo 7 is not 2; of these, those with 5 are held out while
    the weights are learned, and counted for the scores. Words are runs of characters other than ASCII white space, A-Z
    lower-cased. Words are told apart by 64-bit hashes, bigrams and trigrams by ``SPARE_BITS`` more than the number of tokens has. Questions meet in slices of about
    ``slice_tokens`` tokens of the corpus, so there is a row for each block and slice that it has keys of.

    Returns key, held_out, n_tokens, n_known (tokens with a training count), train_tokens, base_score (add-one unigrams, log10) and
    score (log10). Null or empty text: one token, the end. Null keys: as an empty id. Repeated rows count as often as they
    occur. No training texts: uniform probabilities. No rows: no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = written(rows.mapInArrow(released(_tokenise(block_bytes)), _BLOCKS), "blocks")
    tokens = blocks.agg(F.sum("tokens")).first()[0] or 0
    blocks = blocks.select("block", "payload")
    bits = min(60, tokens.bit_length() + SPARE_BITS)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, tokens // slice_tokens)
    paths: list[str] = []
    for kind in range(order):
        asked = blocks.mapInArrow(released(_ask(parts, kind, bits, paths[-1] if kind else None)), _ASKED).repartition(parts, "part").sortWithinPartitions("part")
        # one file for each block: the exchange is by block
        paths.append(write_table(asked.mapInArrow(released(_answer), _ANSWERS).repartition(least, "block").sortWithinPartitions("block"), "answers", "block"))
    totals = spark.read.schema(_ANSWERS).parquet(paths[0]).where("block = -1")
    names = ["kept", "deleted", "kinds", "kept_kinds", "starts_kept", "starts_deleted"]
    kept, deleted, kinds, kept_kinds, starts_kept, starts_deleted = (x or 0 for x in totals.agg(*[F.sum(n) for n in names]).first())
    cells = blocks.mapInArrow(released(_held_out_cells(paths, bits, kept, kept_kinds, starts_kept)), _CELLS).groupBy("bucket", "three", "two", "one").agg(F.sum("n").alias("n"))
    # at most a row for each combination of ratios in each bucket, whatever the corpus
    weights = learn_weights([tuple(r) for r in cells.orderBy("bucket", "three", "two", "one").collect()])
    scored = blocks.mapInArrow(released(_score(paths, bits, weights, kept + deleted, kinds, starts_kept + starts_deleted)), _SCORES)
    return scored.select(F.col("doc_id").alias(key), "held_out", "n_tokens", "n_known", F.lit(kept + deleted).cast("long").alias("train_tokens"), "base_score", "score")
