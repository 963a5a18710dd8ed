"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

A record file is a run of frames. A frame is the payload's length (unsigned 64-bit, little-endian), the masked
CRC-32C of those eight bytes (unsigned 32-bit), the payload, and the payload's masked CRC-32C. A payload is a text's key
(signed 64-bit), the width of an id in bytes (one byte: 2 or 4, plus 128 for a null key) and the ids, little-endian. The mask rotates a checksum
right by 15 bits and adds a constant, so that checksums of data that hold checksums stay sound.

The index of a file is a Parquet table with a row for each record: file, slot, key, offset, length. With it any record
can be read alone, in any order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, released, written
from .tokens import batches_of, encoder

#: Fixed values of the public record format: the reversed Castagnoli polynomial and the mask's constant.
POLYNOMIAL, MASK_DELTA = 0x82F63B78, 0xA282EAD8
_HEAD, _KEY = "<QI", "<qB"
#: In the width's byte: the key is null (and stored as 0).
_NULL = 0x80
_INDEX = "file string, slot long, key long, offset long, length long, n_tokens long"
_BACK = "key long, file string, slot long, n_tokens long, ids_crc32 long"


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1).astype(np.uint32)
    return table


def _zeros_operator(n: int) -> np.ndarray:
    """The 4 x 256 table that moves a checksum's state over n zero bytes."""
    step = _byte_table()
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    state = columns.copy()
    for _ in range(n):
        state = step[state & 255] ^ (state >> np.uint32(8))
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte] ^= np.where(np.arange(256) >> bit & 1, state[8 * byte + bit], 0).astype(np.uint32)
    return out


_TABLE = _byte_table()
_WIDTH = 64
_OPERATORS: dict[int, np.ndarray] = {}


def _move(states: np.ndarray, n: int) -> np.ndarray:
    t = _OPERATORS.get(n)
    if t is None:
        t = _OPERATORS[n] = _zeros_operator(n)
    return t[0][states & 255] ^ t[1][states >> 8 & 255] ^ t[2][states >> 16 & 255] ^ t[3][states >> 24]


def crc32c_many(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of many byte runs of one buffer.

    Every run is cut into strips of 64 bytes, aligned at its end and padded with zeros in front, which a state of zero
    passes unchanged; all strips advance together, a byte a step. Then each run's strips are folded two by two,
    and the initial state, moved over the whole length, is added, as checksums are linear.
    """
    strips = np.maximum(1, -(-lengths // _WIDTH))
    owner = np.repeat(np.arange(len(lengths)), strips)
    first = np.cumsum(strips) - strips
    number = np.arange(len(owner)) - first[owner]
    begin = starts[owner] + lengths[owner] - (strips[owner] - number) * _WIDTH
    low = starts[owner]
    states = np.zeros(len(owner), np.uint32)
    for k in range(_WIDTH):
        at = begin + k
        byte = np.where(at >= low, flat[np.maximum(at, low).clip(max=len(flat) - 1)] if len(flat) else 0, 0)
        states = _TABLE[(states ^ byte) & 255] ^ (states >> np.uint32(8))
    # fold strips from the end: pairs (left, right) become left moved over right's bytes, plus right
    width, ends = _WIDTH, strips.copy()
    while len(states) > len(lengths):
        group = np.repeat(np.arange(len(ends)), ends)
        from_end = (np.cumsum(ends)[group] - 1) - np.arange(len(states))
        right = from_end % 2 == 0
        has_left = right & (from_end + 1 < ends[group])
        folded = states[right].copy()
        folded[has_left[right]] ^= _move(states[np.flatnonzero(has_left) - 1], width)
        states, ends, width = folded, (ends + 1) // 2, width * 2
    # the initial state, all ones, moved over each run's length
    initial = np.full(len(lengths), 0xFFFFFFFF, np.uint32)
    rest, power = lengths.astype(np.int64).copy(), 0
    while (rest > 0).any():
        odd = (rest & 1).astype(bool)
        if odd.any():
            initial[odd] = _move(initial[odd], 1 << power) if power < 12 else _move_far(initial[odd], power)
        rest >>= 1
        power += 1
    return states ^ initial ^ np.uint32(0xFFFFFFFF)


def _move_far(states: np.ndarray, power: int) -> np.ndarray:
    """Over 2 ** power zero bytes, by squaring the operator of half as many."""
    n = 1 << power
    if n not in _OPERATORS:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        half = (lambda x: _move(x, n >> 1)) if power <= 12 else (lambda x: _move_far(x, power - 1))
        state = half(half(columns))
        out = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[byte] ^= np.where(np.arange(256) >> bit & 1, state[8 * byte + bit], 0).astype(np.uint32)
        _OPERATORS[n] = out
    return _move(states, n)


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The frames of the payloads as one string of bytes, and the length of each frame."""
    if not payloads:
        return b"", np.empty(0, np.int64)
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    parts = [*heads, *payloads]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    crcs = masked(crc32c_many(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths)).tolist()
    n = len(payloads)
    out = b"".join(x for h, p, a, b in zip(heads, payloads, crcs[:n], crcs[n:], strict=True) for x in (h, struct.pack("<I", a), p, struct.pack("<I", b)))
    return out, lengths[n:] + 16


def unframe(data: bytes) -> list[bytes]:
    """The payloads of whole frames; raises ValueError where a length or a checksum is wrong."""
    at, heads, payloads, sums = 0, [], [], []
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError(f"a frame at {at} ends early")
        length, head_sum = struct.unpack_from(_HEAD, data, at)
        if at + 16 + length > len(data):
            raise ValueError(f"a frame at {at} ends early or has a wrong length")
        heads.append(data[at : at + 8])
        payloads.append(data[at + 12 : at + 12 + length])
        sums.append((head_sum, struct.unpack_from("<I", data, at + 12 + length)[0]))
        at += 16 + length
    if payloads:
        parts = [*heads, *payloads]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        found = masked(crc32c_many(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths))
        if not np.array_equal(found, np.array([a for a, _ in sums] + [b for _, b in sums], np.uint32)):
            raise ValueError("a checksum is wrong")
    return payloads


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _write_partition(vocabulary: str, folder: str, eos: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = _filesystem(folder)
        name = f"part-{context.partitionId():06d}.rec"
        attempt = f"{path}/.{name}.{context.taskAttemptId()}"
        encode, width = encoder(vocabulary).encode, 0
        out, offset, slot = None, 0, 0
        for batch in (x for b in batches for x in batches_of(b, 1)):
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(attempt)
                width = 2 if encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 else 4
            flat, ends = encode(batch.column(1))
            keys, parts = batch.column(0).to_pylist(), np.split(flat, ends[:-1])
            ids = [np.append(p, eos).astype(f"<u{width}") for p in parts]
            data, lengths = frame([struct.pack(_KEY, k or 0, width | _NULL * (k is None)) + x.tobytes() for k, x in zip(keys, ids, strict=True)])
            out.write(data)
            n = len(keys)
            columns = ([name] * n, range(slot, slot + n), keys, offset + np.cumsum(lengths) - lengths, lengths, [len(x) for x in ids])
            kinds = (pa.string(), *[pa.int64()] * 5)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])
            offset, slot = offset + len(data), slot + n
        if out is not None:
            out.close()
            # the last act: a retry writes the same bytes and replaces the whole file
            system.move(attempt, f"{path}/{name}")

    return run


def write_records(docs: DataFrame, vocabulary: str, eos: int = 0, folder: str | None = None, key: str = "doc_id", text: str = "text") -> tuple[str, DataFrame]:
    """Encodes every whole text, appends ``eos``, and writes records in ascending key order into ``folder``.

    Files are named in key order, and keys ascend inside a file. A task writes under a name of its own and renames at its
    end, so a lost executor leaves no half file under a file's name. Returns the folder (by default a new one in
    the shared folder) and the index, which is itself a written table beside the files.

    Null or empty text: a record with ``eos`` alone. Null keys come first and are read back as null. Equal keys are written in the order of their
    texts. No rows: no files and an empty index. Extra columns are ignored.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "records")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    ranged = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    return folder, written(ranged.mapInArrow(released(_write_partition(vocabulary, folder, eos), encodes=True), _INDEX), "record-index")


def _read_files(folder: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        for file, begin, end, slot in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            with system.open_input_file(f"{path}/{file}") as source:
                payloads = unframe(source.read_at(end - begin, begin))
            keys, counts, sums = [], [], []
            for p in payloads:
                key, width = struct.unpack_from(_KEY, p)
                key, width = None if width & _NULL else key, width & ~_NULL
                ids = np.frombuffer(p, f"<u{width}", offset=struct.calcsize(_KEY)).astype("<u4")
                keys.append(key)
                counts.append(len(ids))
                sums.append(zlib.crc32(ids.tobytes()))
            columns = (keys, [file] * len(keys), range(slot, slot + len(keys)), counts, sums)
            kinds = (pa.int64(), pa.string(), *[pa.int64()] * 3)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _BACK.split(", ")])

    return run


def read_records(spark: SparkSession, folder: str, index: DataFrame, chunk: int = 8 << 20) -> DataFrame:
    """Reads the files back, by runs of about ``chunk`` bytes that the index marks out, and checks every frame.

    Returns key, file, slot, n_tokens, ids_crc32 from the files' own bytes.
    """
    runs = index.groupBy("file", F.floor(F.col("offset") / chunk).alias("run")).agg(
        F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("slot").alias("slot")
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return runs.select("file", "begin", "end", "slot").repartition(parts, "file", "begin").mapInArrow(released(_read_files(folder, chunk)), _BACK)


def with_starts(back: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all records before, in file and slot order, from per-file totals and running sums."""
    totals = back.groupBy("file").agg(F.sum("n_tokens").alias("_ids"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    running = back.withColumn("start", F.sum("n_tokens").over(inside) - F.col("n_tokens"))
    return running.join(F.broadcast(offsets), "file").withColumn("start", F.col("start") + F.col("_before")).drop("_before")  # a row for each file
