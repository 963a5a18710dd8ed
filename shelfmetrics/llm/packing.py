"""Bounded-space online packing of token pieces into fixed windows."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, written
from .tokens import batches_of, encoder

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, fill long, open boolean"


class OpenWindows:
    """At most ``bound`` open windows of ``size`` tokens, the fullest of which that still fits takes a piece."""

    def __init__(self, size: int, bound: int, first: int):
        self.size, self.bound, self.next = size, bound, first
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.done: list[tuple[int, int]] = []  # (window, fill) of those closed

    def place(self, length: int) -> tuple[int, int]:
        """The window and the offset in it; closes the fullest window when none has room and the bound is reached."""
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.bound:
                room, window = self.free.pop(0)
                self.done.append((window, self.size - room))
            room, window, self.next = self.size, self.next, self.next + 1
        if room > length:
            insort(self.free, (room - length, window))
        else:
            self.done.append((window, self.size))
        return window, self.size - room


def _pack_partition(path: str, size: int, bound: int, eos: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        windows, fills, held = OpenWindows(size, bound, base), {}, []

        def rows(some: list[tuple], is_open: bool) -> pa.RecordBatch:
            columns = list(zip(*some, strict=True)) or [[]] * 7
            fill = [fills[w] for w in columns[5]]
            kinds = [pa.int64()] * 8 + [pa.bool_()]
            return pa.record_batch([pa.array(c, k) for c, k in zip([*columns, fill, [is_open] * len(fill)], kinds, strict=True)], names=[x.split()[0] for x in _PIECES.split(", ")])

        encode = encoder(path).encode
        for batch in (x for b in batches for x in batches_of(b, 1)):
            flat, ends = encode(batch.column(1))
            start = 0
            for doc, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                ids = np.append(flat[start:end], eos).astype("<u4")
                start = end
                for k in range(0, len(ids), size):
                    piece = ids[k : k + size]
                    window, offset = windows.place(len(piece))
                    held.append((doc, k, len(piece), zlib.crc32(piece.tobytes()), len(ids), window, offset))
            fills.update(windows.done)
            windows.done = []
            if done := [x for x in held if x[5] in fills]:
                yield rows(done, False)
                held = [x for x in held if x[5] not in fills]
                fills = {}
        fills = {w: size - room for room, w in windows.free}
        if held:
            yield rows(held, True)

    return run


_MERGED = "window long, into long, shift long, total long, open boolean"


def _merge_open(size: int, bound: int):
    """Best fit over whole leftover windows, the fullest first, all of them open; the ``bound`` emptiest stay open after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(((f, w) for b in batches for w, f in zip(*(c.to_pylist() for c in b.columns[:2]), strict=True)), reverse=True)
        if not rows:
            return
        windows, out, names, totals = OpenWindows(size, len(rows), 0), [], {}, {}
        for fill, window in rows:
            place, offset = windows.place(fill)
            into = names.setdefault(place, window)
            totals[into] = offset + fill
            out.append((window, into, offset))
        still = set(sorted((w for w, t in totals.items() if t < size), key=lambda w: (totals[w], w))[:bound])
        columns = [*zip(*out, strict=True), [totals[i] for _, i, _ in out], [i in still for _, i, _ in out]]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 4 + [pa.bool_()], strict=True)], names=[x.split()[0] for x in _MERGED.split(", ")])

    return run


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, bound: int = 64, eos: int = 0, merge: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs each text's ids, and one ``eos``, into windows of ``size`` ids, as a stream and in bounded space.

    Texts longer than a window are cut into full windows and a rest. Each partition keeps ``bound`` windows open: a
    piece goes into the one that it fills best; when none has room, the fullest is emitted. What is open at the
    end of all partitions is merged: the leftover windows of ``merge`` neighbouring partitions meet in one
    task, as window numbers and fills only, and are packed whole, the fullest first, each into the window that it fills
    best. The ``bound`` emptiest windows of each such group meet once more, those of ``merge`` neighbouring groups in one task.

    Returns key, start, length, ids_crc32 (of the piece's ids as little-endian unsigned 32-bit integers), doc_tokens,
    sequence_id (unique, not gapless), offset. Null or empty text: one piece that is the
    ``eos``. Null or repeated keys are packed like any other. No rows: no rows. Extra columns are ignored.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(rows.mapInArrow(released(_pack_partition(vocabulary, size, bound, eos), encodes=True), _PIECES), "pieces")
    left = pieces.where("open").groupBy("window").agg(F.max("fill").alias("fill"), (F.shiftright(F.first("window"), 32) / merge).cast("long").alias("group"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = written(left.select("window", "fill", "group").repartition(parts, "group").mapInArrow(released(_merge_open(size, bound)), _MERGED), "merged")
    still = merged.where("open").groupBy("into").agg(F.max("total").alias("fill")).select(F.col("into").alias("window"), "fill", (F.shiftright("into", 32) / (merge * merge)).cast("long").alias("group"))
    again = still.repartition(parts, "group").mapInArrow(released(_merge_open(size, bound)), _MERGED).select(F.col("window").alias("into"), F.col("into").alias("_into"), F.col("shift").alias("_shift"))
    merged = merged.select("window", "into", "shift").join(again, "into", "left")
    merged = merged.select("window", F.coalesce("_into", "into").alias("into"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
    closed = pieces.where("NOT open").select("*", F.col("window").alias("sequence_id"))
    moved = pieces.where("open").join(merged, "window").withColumn("offset", F.col("offset") + F.col("shift"))
    out = closed.drop("window", "open").unionByName(moved.withColumn("sequence_id", F.col("into")).drop("window", "open", "into", "shift"))
    return out.select(F.col("doc_id").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
