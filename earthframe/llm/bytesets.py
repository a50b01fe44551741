"""Whole-column byte work for Arrow batches: slices, word hashes and sliding hashes, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_RANDOM = np.random.Generator(np.random.PCG64(20_240_229)).integers(1, 2**64, 320, dtype=np.uint64)
_BYTE, _LOWER_BYTE = _RANDOM[:256] | np.uint64(1), (_RANDOM[:256] | np.uint64(1))[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else _UNBASE
        _powers[kind] = np.concatenate(
            [np.ones(1, np.uint64), np.cumprod(np.full(max(n, 2 * SLICE_BYTES), base, np.uint64))])
    return _powers[kind][:n]


def texts(column: pa.Array) -> pa.Array:
    """The column as strings, null counted as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about SLICE_BYTES: (rows, bytes, offsets)."""
    text = texts(batch.column(column))
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset:text.offset + len(text) + 1]
    data = (np.frombuffer(text.buffers()[2], dtype=np.uint8) if text.buffers()[2] is not None
            else np.zeros(0, np.uint8))
    row = 0
    while row < len(text):
        stop = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        stop = min(len(text), max(row + 1, stop))
        yield (batch.slice(row, stop - row), data[offsets[row]:offsets[stop]],
               offsets[row:stop + 1] - offsets[row])
        row = stop


def prefix_hash(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Running polynomial hash modulo 2^64, one longer than ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_BYTE if lower else _BYTE)[data] * _power("up", len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they stand."""
    return mix((prefix[stop] - prefix[start]) * _power("down", len(prefix))[start]
               + (stop - start).astype(np.uint64) * _RANDOM[300])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the words (runs of non-white-space) and the words per text."""
    kept = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first, last = kept.copy(), kept.copy()
    if len(data):
        first[1:] &= ~kept[:-1] | edge[1:-1]
        last[:-1] &= ~kept[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, stop, np.diff(np.searchsorted(start, offsets))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, A-Z lower-cased, and the words per text."""
    start, stop, count = words(data, offsets)
    return span_hash(prefix_hash(data, lower=True), start, stop), count


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in each full window, the leftmost of equals.

    Values are compared by their upper 33 bits, the place breaks ties, so equal windows
    choose the same place within them.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    packed = (values & np.uint64(0xFFFFFFFF80000000)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = packed
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
    return (least & np.uint64(0x7FFFFFFF)).astype(np.int64)
