"""Words and hashes of whole Arrow batches of texts, as numpy arrays.

A batch's texts lie in one byte buffer.  Separators are ASCII in every
definition used here, so words are cut on bytes and stay valid UTF-8.  A word's
hash is a polynomial over its bytes modulo 2^64 taken from one running sum, then
mixed; a window's hash mixes its words' hashes in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that powers can be divided out
SPACE_BYTES = bytes([9, 10, 11, 12, 13, 32])
NON_ALNUM_BYTES = bytes(b for b in range(128) if not chr(b).isalnum())


def separators(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Byte spans of all words of a batch; document i owns words first[i]..first[i+1]."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word."""
        n = len(self.data)
        power = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
        raw = (total[self.end] - total[self.start]) * inverse_powers(n + 1)[self.start]
        return mix(raw + (self.end - self.start).astype(np.uint64))


_POWERS: dict[str, np.ndarray] = {}


def _geometric(ratio: int, n: int, key: str) -> np.ndarray:
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, ratio, np.uint64)
        out[0] = 1
        have = _POWERS[key] = np.multiply.accumulate(out)
    return have


def powers(n: int) -> np.ndarray:
    return _geometric(int(BASE), n, "up")


def inverse_powers(n: int) -> np.ndarray:
    return _geometric(pow(int(BASE), -1, 1 << 64), n, "down")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type)
                         else pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def words(column: pa.Array, separator: np.ndarray, lower: bool) -> Words:
    data, at = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~separator[data]
    # a word also ends where its document ends
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    change = np.diff(inside)
    starts, ends = change[:-1] == 1, change[1:] == -1
    joined = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
    starts[joined] = True
    ends[joined - 1] = True
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive hashes (across documents too)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = (out + hashes[k:k + n]) * BASE
        out ^= out >> np.uint64(29)
    return mix(out)


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES
           ) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        _, at = text_bytes(column)
        begin = 0
        while begin < batch.num_rows:
            stop = int(np.searchsorted(at, at[begin] + size, "right"))
            stop = min(max(stop - 1, begin + 1), batch.num_rows)
            yield batch.slice(begin, stop - begin)
            begin = stop
