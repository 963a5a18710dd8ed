"""Arrays as compressed bytes."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa

#: Names of arrays that ascend.
SORTED = frozenset({"keys", "sets"})


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; what is named as sorted is stored as gaps, with bytes by rank."""
    out = {}
    for name, x in arrays.items():
        raw = np.diff(x, prepend=x.dtype.type(0)) if name in SORTED else x
        if x.dtype.itemsize > 1:
            raw = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, x.dtype.itemsize).T)
        out[name] = (x.dtype.str, len(x), pa.compress(raw.tobytes(), codec="zstd", asbytes=True))
    return pickle.dumps(out)


def unpack(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, (kind, n, packed) in pickle.loads(data).items():
        kind = np.dtype(kind)
        raw = np.frombuffer(pa.decompress(packed, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True) if n else b"", np.uint8)
        if kind.itemsize > 1:
            raw = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1)
        x = raw.view(kind)
        out[name] = np.cumsum(x, dtype=kind) if name in SORTED else x
    return out
