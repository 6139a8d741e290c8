"""Sorted integer keys with values, shuffled as compressed blocks.

A task sends one block for each range of the key space instead of a row per key; keys must be spread
evenly (hashes), so that ranges are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame

SCHEMA = "kind string, part long, block binary"


def pack(keys: np.ndarray, *cols: np.ndarray) -> bytes:
    """Byte planes of the differences of ascending keys, then of each column (four or eight bytes wide)."""
    d = np.diff(keys.astype("<u8"), prepend=np.uint64(0))
    head = [len(keys), len(cols), *(c.dtype.itemsize for c in cols)]
    planes = [x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes() for x in (d, *cols)]
    return zstd.ZstdCompressor(level=1).compress(np.array(head, "<u8").tobytes() + b"".join(planes))


def unpack(block: bytes) -> list[np.ndarray]:
    raw = zstd.ZstdDecompressor().decompress(block)
    n, k = (int(x) for x in np.frombuffer(raw, "<u8", 2))
    sizes = [8, *(int(x) for x in np.frombuffer(raw, "<u8", k, 16))]
    at, out = 16 + 8 * k, []
    for s in sizes:
        out.append(np.frombuffer(raw, np.uint8, s * n, at).reshape(s, n).T.copy().view(f"<u{s}").ravel())
        at += s * n
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def by_range(kind: str, cols: list[np.ndarray], ranges: int) -> Iterator[tuple[str, int, bytes]]:
    """A block for each range that has keys; ``cols``: ascending keys first."""
    edges = (np.arange(1, ranges, dtype=object) * (2**64 // ranges)).astype(np.uint64)
    cut = np.concatenate([[0], np.searchsorted(cols[0], edges), [len(cols[0])]])
    for r in range(ranges):
        if cut[r] < cut[r + 1]:
            yield kind, r, pack(*(c[cut[r] : cut[r + 1]] for c in cols))


def batch(blocks: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    kind, part, block = zip(*blocks, strict=True) if blocks else ((), (), ())
    return pa.record_batch({"kind": pa.array(kind, pa.string()), "part": pa.array(part, pa.int64()), "block": pa.array(block, pa.binary())})


def shuffled(blocks: DataFrame, ranges: int) -> DataFrame:
    """A range's blocks together, and in order of (kind, part)."""
    return blocks.repartition(ranges, "kind", "part").sortWithinPartitions("kind", "part")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[list[np.ndarray]]]]:
    """The blocks of each (kind, part) of a shuffled partition, one at a time; each group must be read to its end."""
    rows = ((k.as_py(), p.as_py(), x) for b in batches for k, p, x in zip(*(b.column(i) for i in range(3)), strict=True))
    head = next(rows, None)

    def blocks(key: tuple) -> Iterator[list[np.ndarray]]:
        nonlocal head
        while head is not None and head[:2] == key:
            yield unpack(head[2].as_py())
            head = next(rows, None)

    while head is not None:
        key = head[:2]
        yield *key, blocks(key)
