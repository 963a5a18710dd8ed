"""Exact set-similarity join of word n-grams by universe partition and the pigeonhole principle.

Sets x and y with a Jaccard similarity of at least t differ in at most (1 - t) / (1 + t) * (|x| + |y|) elements. Sizes are
cut into bands; a pair belongs to the band of its smaller set, and in band j it differs in at most k_j elements. All
shingles are hashed into segments. If e segments are compared as they are (score 1) and d segments up to one difference
(score 2), and the scores' sum e + 2 d is k_j + 1, some segment must pass, for one that fails its test holds as many
differences as its score. A set is indexed by its segments' hashes, and in the d segments also by the hashes with each one shingle left out.

Two things are known of a set before any of its keys moves. Shingles that no other set has can only differ; a set of
which more than 1 - t are such has no link at all, and is not indexed. Else, with r of them, what it shares with a partner
differs in r elements less, so the set may leave out segments of a total score of r; and those of the band's k_j that its
size leaves unused. It leaves out those with the longest lists: of empty segments and of common passages.

What passes is verified on whole sets. Links are kept as they come; components are found by contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import pack, unpack
from .common import ASCII_LOWER, WORD_RE, released, write_table, written
from .tokens import batches_of

_SETS = "id long, n long, h1 long, h2 long"
_KEYS = "id long, lone long, key long, group long, slot long, spare int"
_ASKED = "slice int, block long, payload binary"
_MEMBERS = "id long, n long, lone long, shared binary"
_FINE = 4  # parts of a segment that tell how far two sets differ
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's distinct n-word shingles as sorted 64-bit hashes; fewer words make one shingle, none an empty set."""
    import xxhash

    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    flat = hashes[coded.indices.to_numpy()]
    # leading and trailing white space leaves empty strings at the ends
    real = np.fromiter((bool(w) for w in words), bool, len(words))[coded.indices.to_numpy()]
    offsets = np.concatenate([[0], np.cumsum(real)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
    flat = flat[real]
    rolled = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for k in range(n):
        rolled = mix(rolled * _A + flat[k : k + len(rolled)] + np.uint64(k))
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(rolled[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mix(h * _B + flat[k])
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


@dataclass(frozen=True)
class Band:
    """The scheme for pairs whose smaller set has low..high shingles."""

    low: int
    high: int
    largest: int  # of the larger set
    differences: int  # k: the most in which a pair can differ
    segments: int
    deletions: int  # how many segments are indexed with one shingle left out, too


def allocate(low: int, high: int, t: Fraction, sets: int) -> Band:
    """The band's cheapest allocation: keys to index for a set, and sets that it will meet in small segments.

    With expected segment size s, a segment holds so few shingles that unlike sets agree on it with a chance of about
    e^-s (1 + s); that times the band's number of sets is what a set meets there, at a hundredth of a key's cost.
    """
    largest = int(high / t)
    k = int((1 - t) / (1 + t) * (high + largest))
    options = []
    for d in range(0, (k + 1) // 2 + 1):
        m = k + 1 - d
        s = high / m
        small = math.exp(-s) * (1 + s)
        smaller = small + math.exp(-s) * s * s / 2
        keys = (m - d) + d * (1 + s)
        options.append((keys + 0.01 * sets * ((m - d) * small + d * smaller), d))
        if d > 4 and options[-1][0] > 2 * min(options)[0]:
            break
    d = min(options)[1]
    return Band(low, high, largest, k, k + 1 - d, d)


def edges_of(t: Fraction, largest: int) -> list[int]:
    """Where size bands begin: each reaches to the size of the largest partner of its first."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] / t) + 1))
    return out


def keys_of(s: np.ndarray, band: Band, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The set's keys in a band's scheme, and of each the segment's place times two, plus one where the segment's score is two."""
    spread = mix(s ^ mix(np.array([number], np.uint64) + _B))
    segment = (spread % np.uint64(band.segments * _FINE)).astype(np.int64) // _FINE
    value = mix(spread + _A)
    sums = np.zeros(band.segments, np.uint64)
    np.add.at(sums, segment, value)
    salt = mix(np.arange(band.segments, dtype=np.uint64) + np.uint64(number << 32) + _A)
    place = np.arange(band.segments)
    keys, slots = mix(sums ^ salt), place * 2 + (place < band.deletions)
    if band.deletions:
        near = segment < band.deletions
        keys = np.concatenate([keys, mix((sums[segment[near]] - value[near]) ^ salt[segment[near]])])
        keys, at = np.unique(keys, return_index=True)
        slots = np.concatenate([slots, segment[near] * 2 + 1])[at]
    return keys, slots


def spare_of(size: int, lone: int, band: Band, t: Fraction) -> int:
    """The score that a set may leave out: its lone shingles, and the differences that its size can't make of the band's."""
    return lone + int((1 - t) / (1 + t) * ((band.high if size <= band.high else band.largest) - size))


def profile_of(s: np.ndarray, band: Band, number: int) -> np.ndarray:
    """A byte for each fine part of each segment; sets differ in at least as many shingles as bytes."""
    spread = mix(s ^ mix(np.array([number], np.uint64) + _B))
    sums = np.zeros(band.segments * _FINE, np.uint64)
    np.add.at(sums, (spread % np.uint64(band.segments * _FINE)).astype(np.int64), mix(spread + _A))
    return (mix(sums) >> np.uint64(56)).astype(np.uint8)


def _fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in batches_of(b, 1)):
            sets = shingle_sets(batch.column(1), n)
            one = np.array([mix(s + _A).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            two = np.array([mix(s ^ _B).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two)]
            yield pa.record_batch(columns, names=["id", "n", "h1", "h2"])

    return run


def _schemes(size: int, starts: list[int], bands: list[Band]) -> list[int]:
    """The bands in which a set of this size takes part: its own, and the one below as a pair's larger set."""
    own = int(np.searchsorted(starts, size, "right")) - 1
    return [j for j in (own, own - 1) if 0 <= j < len(bands) and bands[j].differences and size <= bands[j].largest]


def _blocks(block_bytes: int):
    """Adds to rows the number of their block, of about ``block_bytes`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in (x for b in batches for x in batches_of(b, 1, min(block_bytes, 4 << 20))):
            yield pa.record_batch([*batch.columns, pa.array(np.full(batch.num_rows, number, np.int64))], names=["id", "text", "block"])
            size += batch.nbytes
            if size >= block_bytes:
                number, size = number + 1, 0

    return run


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The runs of rows of one block in each batch."""
    for batch in batches:
        blocks = batch.column(2).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                part = pa.record_batch([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], names=batch.schema.names)
                yield from ((int(blocks[a]), x) for x in batches_of(part, 1, 4 << 20))


def _ask(n: int, bits: int, slices: int):
    """Each block's distinct shingles, cut to ``bits`` bits, in slices, with a mark on those that several of its own sets have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        edges = np.array([(k << bits) // slices for k in range(1, slices)], np.uint64)

        def questions(block: int) -> Iterator[pa.RecordBatch]:
            keys = np.sort(np.concatenate(held))
            held.clear()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            many = (np.diff(np.append(starts, len(keys))) > 1).astype(np.uint8)
            keys = keys[starts]
            cuts = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            rows = [(k, block, pack(keys=keys[a:b], many=many[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            for k in range(0, len(rows), 256):
                columns = zip(*rows[k : k + 256], strict=True)
                yield pa.record_batch([pa.array(x, c) for x, c in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["slice", "block", "payload"])

        last = None
        for block, batch in _by_block(batches):
            if block != last and held:
                yield from questions(last)
            last = block
            held += [(mix(s) >> np.uint64(64 - bits)) for s in shingle_sets(batch.column(1), n) if len(s)]
        if held:
            yield from questions(last)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice, what of each block's shingles several sets have."""

    def answers(rows: list[tuple[int, dict]]) -> Iterator[pa.RecordBatch]:
        keys = np.sort(np.concatenate([x["keys"] for _, x in rows] + [x["keys"][x["many"] > 0] for _, x in rows]))
        shared = np.unique(keys[1:][keys[1:] == keys[:-1]])
        for block, x in rows:
            at = np.searchsorted(shared, x["keys"])
            own = x["keys"][shared[np.minimum(at, len(shared) - 1)] == x["keys"]] if len(shared) else shared
            if len(own):
                columns = [[block >> 32], [block], [pack(keys=own)]]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["home", "block", "payload"])

    last, rows = None, []
    for part, block, payload in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        if part != last and rows:
            yield from answers(rows)
            rows = []
        last = part
        rows.append((block, unpack(payload)))
    if rows:
        yield from answers(rows)


def _answered(path: str, block: int) -> np.ndarray:
    """The block's shingles that several sets have, sorted; from the shared folder."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(path)
    found = [np.empty(0, np.uint64)]
    for file in system.get_file_info(fs.FileSelector(f"{path}/home={block >> 32}", allow_not_found=True)):
        if file.path.endswith(".parquet"):
            with system.open_input_file(file.path) as source:
                for some in pq.ParquetFile(source).iter_batches(64, columns=["block", "payload"]):
                    some = some.filter(pc.equal(some.column(0), block))
                    found += [unpack(x)["keys"] for x in some.column(1).to_pylist()]
    return np.sort(np.concatenate(found))


def _reduce(n: int, bits: int, t: Fraction, path: str):
    """The sets that can have a link, without the shingles that nobody else has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, common = None, np.empty(0, np.uint64)
        for block, batch in _by_block(batches):
            if block != last:
                last, common = block, _answered(path, block)
            rows = []
            if len(common):
                for i, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                    own = mix(s) >> np.uint64(64 - bits)
                    shared = s[common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own]
                    if len(s) and len(shared) * t.denominator >= len(s) * t.numerator:
                        rows.append((i, len(s), len(s) - len(shared), shared.tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "n", "lone", "shared"])

    return run


def _set(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _index(t: Fraction, starts: list[int], bands: list[Band], level: int):
    """Keys of members (id, n, lone, shared, group): those of two groups, or of two levels, are never equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in batches_of(b, 3, 4 << 20)):
            out = []
            for i, n, lone, shared, group in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for j in _schemes(n, starts, bands):
                    keys, slots = keys_of(_set(shared), bands[j], j + (level << 12))
                    if group:
                        keys = mix(keys ^ mix(np.array([group], np.int64).view(np.uint64) + _B))
                    k = len(keys)
                    spare = np.full(k, spare_of(n, lone, bands[j], t), np.int32)
                    out.append((np.full(k, i, np.int64), np.full(k, lone, np.int64), keys.view(np.int64), np.full(k, group, np.int64), slots.astype(np.int64) | j << 32, spare))
            if out:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["id", "lone", "key", "group", "slot", "spare"])

    return run


def linked(x: np.ndarray, y: np.ndarray, t: Fraction) -> bool:
    """Whether |x and y| / |x or y| is t or more, in whole numbers."""
    low, high = sorted((len(x), len(y)))
    if not low or low * t.denominator < high * t.numerator:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * t.denominator >= (low + high - common) * t.numerator


def _verify(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, first, x = [], None, np.empty(0, np.uint64)
            for k, (a, n, m, own, other) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5)), strict=True)):
                if a != first:
                    first, x = a, _set(own)
                y = _set(other)
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()) if len(x) else 0
                if common * t.denominator >= (n + m - common) * t.numerator:
                    keep.append(k)
            yield pa.record_batch([batch.column(c).take(pa.array(keep, pa.int64())) for c in (0, 1)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, members: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) that are linked. b's set travels first: in a star, a is the one that many pairs have."""
    x, y = (members.select(F.col("id").alias(c), F.col("n").alias(f"_n{c}"), F.col("shared").alias(f"_s{c}")) for c in "ab")
    both = pairs.join(y, "b").join(x, "a").select("a", "b", "_na", "_nb", "_sa", "_sb")
    return written(both.mapInArrow(released(_verify(t)), "a long, b long").distinct(), "links")


def _profiles(starts: list[int], bands: list[Band]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in batches_of(b, 3)):
            rows = []
            for i, n, lone, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(i, n, lone, j, profile_of(_set(shared), bands[j], j).tobytes()) for j in _schemes(n, starts, bands)]
            kinds = (*[pa.int64()] * 4, pa.binary())
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "n", "lone", "band", "profile"])

    return run


def _compare(bands: list[Band], t: Fraction):
    """Candidates of each (key, chunk, chunk) group between different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(rows) < 2:
                return
            _, first, second, band = group
            ids, sizes, lone, labels, chunks = (np.array([r[k] for r in rows]) for k in range(5))
            profiles = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(len(rows), -1)
            # pairs of a component needn't be compared: all others have a set outside the largest one
            names, sizes_of = np.unique(labels, return_counts=True)
            outside = labels != names[sizes_of.argmax()]
            places = np.arange(len(rows))
            for p in np.flatnonzero(outside).tolist():
                others = places[(labels != labels[p]) & (~outside | (ids > ids[p])) & ((chunks != chunks[p]) | (first == second))]
                low, high = np.minimum(sizes[others], sizes[p]), np.maximum(sizes[others], sizes[p])
                # a pair is compared in the band of its smaller set, by what sets of these sizes may differ in
                others = others[(low >= bands[band].low) & (low <= bands[band].high) & (high * t.numerator <= low * t.denominator)]
                left = (sizes[others] + sizes[p]) * (t.denominator - t.numerator) // (t.denominator + t.numerator) - lone[others] - lone[p]
                others, left = others[left >= 0], left[left >= 0]
                others = others[(profiles[others] != profiles[p]).sum(1) <= left]
                if len(others):
                    x, y = np.minimum(ids[others], ids[p]), np.maximum(ids[others], ids[p])
                    yield pa.record_batch([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            for key, first, second, chunk, i, size, alone, label, band, profile in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, first, second, band) != group:
                    yield from flush()
                    group, rows = (key, first, second, band), []
                rows.append((i, size, alone, label, chunk, profile))
        yield from flush()

    return run


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in links (a, b), as (id, component).

    Every round, each root takes the smallest root beside it, chains of roots are followed to their ends, and links are
    contracted to links between roots, until none are left. A round at least halves the roots with links. All tables
    are written to the shared folder; nothing but counts comes to the driver.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    labels = written(ids.withColumn("component", F.col("id")), "labels")
    while not edges.isEmpty():
        # links are from smaller to larger, so a root's parent is smaller and chains end
        parents = written(edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("parent")), "parents")
        while True:
            up = parents.select(F.col("root").alias("parent"), F.col("parent").alias("grand"))
            jumped = written(parents.join(up, "parent", "left").select("root", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "parents")
            parents = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        labels = written(labels.join(parents, F.col("component") == F.col("root"), "left").select("id", F.coalesce("parent", "component").alias("component")), "labels")
        a, b = (parents.select(F.col("root").alias(c), F.col("parent").alias(f"_{c}")) for c in "ab")
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        edges = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels


def _without(df: DataFrame, ids: DataFrame, how: str, most: int = 2_000_000) -> DataFrame:
    """A semi or anti join by id. Ids are sent to all executors only if they are counted and at most ``most``."""
    return df.join(F.broadcast(ids) if ids.count() <= most else ids, "id", how)


def _members(rows: DataFrame, shingles: int, n: int, t: Fraction, block_bytes: int, slice_keys: int) -> DataFrame:
    """Rows (id, text) as sets (id, n, lone, shared), where a link is possible: the size, the number of shingles that no other
    row has, and the others' hashes.

    Tasks send each block's sorted distinct shingles, cut to as many bits as tell nearly all apart, as gaps: some two bytes a
    shingle. Shingles cut to equal bits count as shared, which loses nothing. A slice of the shingles, of about
    ``slice_keys``, answers which are shared; a block's answers are read from the shared folder.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = written(rows.mapInArrow(released(_blocks(block_bytes)), "id long, text string, block long"), "blocks")
    bits, slices = min(60, shingles.bit_length() + 6), max(parts, shingles // slice_keys)
    asked = blocks.mapInArrow(released(_ask(n, bits, slices)), _ASKED).repartition(slices, "slice").sortWithinPartitions("slice")
    answers = asked.mapInArrow(released(_answer), "home long, block long, payload binary")
    # one file for each task of blocks
    path = write_table(answers.repartition(parts, "home").sortWithinPartitions("home", "block"), "shared-shingles", "home")
    return written(blocks.mapInArrow(released(_reduce(n, bits, t, path)), _MEMBERS), "members")


def _met(keys: DataFrame) -> DataFrame:
    """The keys that several ids have, with their number and the id that has the fewest lone shingles, the smallest of these.

    Of an original and its altered copies that is the original, which is nearer to each copy than most copies are to each other.
    """
    met = keys.groupBy("key").agg(F.min(F.struct("lone", "id"))["id"].alias("first"), F.min("id").alias("_x"), F.max("id").alias("_y"), F.count("*").alias("members")).where("_x < _y")
    return keys.join(met.drop("_x", "_y"), "key")


def _allocated(keys: DataFrame) -> DataFrame:
    """What is left of the keys that ids share when each set leaves out, of each band's segments, those with the longest lists,
    as far as their scores fit into what it may spare."""
    scheme = ["id", "lone", "group", "spare", "band"]
    by_set = _met(keys).withColumn("band", F.shiftright("slot", 32)).repartition("id").groupBy(*scheme, "slot").agg(F.max("members").alias("cost"), F.collect_list("key").alias("keys"))
    score = 1 + F.col("slot").bitwiseAND(F.lit(1))
    costly = Window.partitionBy(*scheme).orderBy(F.desc("cost"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    kept = by_set.withColumn("_sum", F.sum(score).over(costly)).where("_sum > spare")
    return written(kept.select("id", "lone", "band", F.explode("keys").alias("key")).distinct(), "keys")


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, id, lone, band, label, members, pairs) of keys whose sets are in several components; pairs are those between components."""
    named = shared.join(labels, "id", "left").select("key", "id", "lone", "band", F.coalesce("component", "id").alias("label"))
    sums = [F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")]
    counts = named.groupBy("key", "band", "label").agg(F.count("*").alias("count"), *sums)
    counts = counts.groupBy("key", "band").agg(F.sum("count").alias("members"), F.sum(F.col("count") * F.col("count")).alias("squares"), *[F.bit_xor(c).alias(c) for c in "xy"])
    pairs = counts.withColumn("pairs", (F.col("members") * F.col("members") - F.col("squares")) / 2).where("pairs > 0")
    # two long texts that are nearly alike share hundreds of keys: one of those with the same sets will do
    pairs = pairs.groupBy("band", "members", "pairs", "x", "y").agg(F.min("key").alias("key")).select("key", "members", "pairs")
    return written(named.join(pairs, "key"), "open")


def _is_large(chunk: int) -> Column:
    """Whether a set of a key has over ``chunk`` partners in other components on average."""
    return (F.col("pairs") > chunk * F.col("members")) & (F.col("pairs") > chunk * chunk)


def jaccard_components(
    docs: DataFrame, n: int = 3, threshold: str = "9/10", key: str = "doc_id", text: str = "text", chunk: int = 256, levels: int = 4, block_bytes: int = 24 << 20, slice_keys: int = 2_000_000
) -> DataFrame:
    """Groups documents by the links of their sets of distinct ``n``-word shingles.

    1. Documents with equal sets are one class, held by its smallest id: copies are never paired.
    2. Sets with too many shingles of their own are out; of the others, only shared shingles go on.
    3. Sets are indexed by their bands' keys, as allocated for the number of sets in each band, and leave out those with
       the longest lists, as the module says.
    4. In each key, every set is verified against the one with the fewest lone shingles; that joins groups of near copies along a star.
    5. Keys whose sets are still in different components are compared in full, by profiles that bound the difference from
       below, where a set has at most ``chunk`` partners in other components on average. The sets of larger keys are indexed
       anew, by a partition of their own for each key, as a linked pair agrees in a segment of every partition; so lists get
       shorter by the chance of a segment's value on each of ``levels`` levels. What is left is compared in chunks.

    So no link between different components is lost, and links inside a component need not be found.

    Returns key, n_shingles (the set's size), component_id (the smallest key reachable by links, itself included),
    class_id (the smallest key with the same set) and size (documents in the component). Words are runs of
    characters other than ASCII white space, A-Z lower-cased. A text with fewer words is one shingle; null or
    empty texts have an empty set, are linked with nothing and are classes of their own. Keys should be unique; rows with
    an equal key count as one document for links. Null keys: linked with nothing, component_id null. No rows: no rows.
    Extra columns are ignored.
    """
    t = Fraction(threshold)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sets = written(rows.mapInArrow(released(_fingerprints(n)), _SETS), "sets")
    known = sets.where("id IS NOT NULL AND n > 0")
    classes = written(known.groupBy("n", "h1", "h2").agg(F.min("id").alias("class_id"), F.count("*").alias("copies")), "classes")
    repeated = known.join(classes.where("copies > 1"), ["n", "h1", "h2"]).where("id <> class_id").select("id").distinct()
    alone = _without(rows.where("id IS NOT NULL"), repeated, "left_anti")
    members = _members(alone, int(classes.agg(F.sum("n")).first()[0] or 0), n, t, block_bytes, slice_keys)

    starts = edges_of(t, members.agg(F.max("n")).first()[0] or 0)
    edge = F.array(*[F.lit(s) for s in starts])
    # a row for each band, of which there are as many as the logarithm of the largest set
    counted = {r[0]: r[1] for r in members.groupBy(F.size(F.filter(edge, lambda e: e <= F.col("n"))).alias("band")).count().collect()}
    bands = [allocate(a, b - 1, t, counted.get(j + 1, 0) + counted.get(j + 2, 0)) for j, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True))]

    groups = members.withColumn("group", F.lit(0).cast("long"))
    links, compared = [], []
    for level in range(levels):
        keys = _allocated(written(groups.mapInArrow(released(_index(t, starts, bands, level)), _KEYS), "index"))
        shared = written(_met(keys), "shared")
        stars = shared.where("id <> first").select(F.least("first", "id").alias("a"), F.greatest("first", "id").alias("b")).distinct()
        links.append(_verified(stars, members, t))
        opened = _open(shared, components(_all(links)))
        large = opened.where(_is_large(chunk))
        if level + 1 == levels or large.isEmpty():
            compared.append(opened)
            break
        compared.append(opened.where(~_is_large(chunk)))
        groups = members.join(large.select("id", F.col("key").alias("group")).distinct(), "id").select(*members.columns, "group")

    left = _all(compared)
    profiles = _without(members, left.select("id").distinct(), "left_semi").mapInArrow(released(_profiles(starts, bands)), "id long, n long, lone long, band long, profile binary")
    chunks = F.ceil(F.col("members") / (chunk * chunk)).cast("long")
    placed = left.drop("lone").join(profiles, ["id", "band"]).withColumn("chunk", F.pmod(F.xxhash64("id"), chunks))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    grouped = spread.select("key", F.least("chunk", "other").alias("first"), F.greatest("chunk", "other").alias("second"), "chunk", "id", "n", "lone", "label", "band", "profile")
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "first", "second", "band"]
    candidates = grouped.repartition(parts, *order).sortWithinPartitions(*order).mapInArrow(released(_compare(bands, t)), "a long, b long").distinct()
    labels = components(_all([*links, _verified(candidates, members, t)]))

    named_classes = classes.join(labels, F.col("class_id") == F.col("id"), "left").select("n", "h1", "h2", "class_id", F.coalesce("component", "class_id").alias("component_id"), "copies")
    sizes = named_classes.groupBy("component_id").agg(F.sum("copies").alias("size"))
    named_classes = named_classes.join(sizes, "component_id")
    out = sets.join(named_classes, ["n", "h1", "h2"], "left")
    own = F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component_id", "id")).alias("component_id"),
        F.when(F.col("id").isNull(), None).otherwise(F.coalesce(own, "id")).alias("class_id"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("size")).otherwise(1).alias("size"),
    )


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def brute_components(rows: list[tuple[int, str | None]], n: int, threshold: str) -> dict[int, tuple[int, int]]:
    """By comparing all pairs of word tuples: id to (set size, component). For small fixtures in tests."""
    t, sets = Fraction(threshold), {}
    for i, text in rows:
        words = WORD_RE.findall((text or "").translate(ASCII_LOWER))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()
    root = {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common * t.denominator >= (len(sets[a]) + len(sets[b]) - common) * t.numerator:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}
