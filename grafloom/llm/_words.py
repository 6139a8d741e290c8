"""Words and hashes of whole Arrow text columns, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 20
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2**64."""
    if "p" not in _POW or len(_POW["p"]) < n + 1:
        m = -(-max(int(n), _STEP) // _STEP) * _STEP
        for key, b in (("p", _BASE), ("q", pow(_BASE, -1, 2**64))):
            x = np.full(m + 1, b, np.uint64)
            x[0] = 1
            _POW[key] = np.multiply.accumulate(x)
    return _POW["p"], _POW["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_INV1, _INV2 = (np.uint64(pow(int(m), -1, 2**64)) for m in (_MIX1, _MIX2))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    x = x.astype(np.uint64, copy=True)
    x ^= (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= _INV2
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= _INV1
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and each row's offsets there; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if offsets is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = _STEP) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about ``most`` bytes of text, or one row."""
    try:
        for b in batches:
            if not b.num_rows:
                continue
            _, offs = buffers(b.column(column))
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
                yield b.slice(lo, hi - lo)
                lo = hi
    finally:
        release()


def release() -> None:
    """Give memory that a task no longer uses back to the system: workers live on between tasks, beside those of other stages."""
    _POW.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than GNU's
        pass


def words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes that are not ASCII white space."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offs] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | first[1:-1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offs, start, "right") - 1


def lower(raw: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    return _LOWER[raw]


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of the bytes; of long texts a piece at a time."""
    if not len(start):
        return np.zeros(0, np.uint64)
    if len(raw) > _STEP:
        # pieces of half a step: with the word that reaches over its end a piece needs no longer tables of powers
        order = np.argsort(start, kind="stable")
        piece, out = start[order] // (_STEP // 2), np.empty(len(start), np.uint64)
        for of in np.split(order, np.flatnonzero(np.diff(piece)) + 1):
            lo, hi = int(start[of[0]]), int(end[of].max())
            out[of] = _span_hashes(raw[lo:hi], start[of] - lo, end[of] - lo)
        return out
    return _span_hashes(raw, start, end)


def _span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p, q = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=total[1:])
    return mix((total[end] - total[start]) * q[start])


_GRAM = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(h: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` words in a row and the row of each; a shorter row is one shingle of all its words."""
    count = np.bincount(row, minlength=rows)
    out, at = [], []
    if len(h) >= n:
        g = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            g += h[k : len(h) - n + 1 + k] * _GRAM[k]
        same = row[: len(g)] == row[n - 1 :]
        out.append(mix(g[same]))
        at.append(row[: len(g)][same])
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        inside = np.isin(row, short)
        hs, rs = h[inside], row[inside]
        place = np.arange(len(rs)) - np.searchsorted(rs, rs, "left")
        part = np.bincount(np.searchsorted(short, rs), minlength=len(short))
        edge = np.concatenate([[0], np.cumsum(part)[:-1]])
        out.append(mix(np.add.reduceat(hs * _GRAM[place], edge) + part.astype(np.uint64)))
        at.append(short)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(at)


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, ascending, rows ascending."""
    if not len(h):
        return h, row
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]
