"""Words of Arrow text columns as numpy arrays, a few megabytes of text at a time.

A word is a run of ASCII letters, digits and non-ASCII characters, A-Z taken as a-z. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    byte = np.arange(256)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    word = ((lower >= 48) & (lower <= 57)) | ((lower >= 97) & (lower <= 122)) | (byte >= 128)
    return word, mix((lower + 1).astype(np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


WORD_BYTE, BYTE_VALUE = _tables()


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _powers_for(n: int):
    up, down = _powers(max(20, int(n).bit_length()))
    return up[:n], down


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column in one array, and the offsets of its rows (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the runs of marked bytes; no run crosses a row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """A 64-bit hash of each run of bytes, after `values` has been looked up for each byte."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers_for(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values[raw] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def prefix_sums(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (start, end) that gives 64-bit hashes of these slices of a sequence of 64-bit values."""
    up, down = _powers_for(len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up, out=total[1:])
    return lambda starts, ends: mix((total[ends] - total[starts]) * down[starts])


@dataclass
class Words:
    raw: np.ndarray  #: bytes of all rows
    offsets: np.ndarray  #: byte offset of each row, and the end
    starts: np.ndarray  #: first byte of each word
    ends: np.ndarray  #: byte after each word
    hashes: np.ndarray  #: 64-bit hash of each word
    rows: np.ndarray  #: index of each row's first word, and the end

    def row_of(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def words_of(column: pa.Array) -> Words:
    raw, offsets = text_bytes(column)
    starts, ends = byte_runs(WORD_BYTE[raw], offsets)
    return Words(raw, offsets, starts, ends, run_hashes(raw, starts, ends), np.searchsorted(starts, offsets))


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most `limit` bytes of text each, or of one row. Rows are never cut."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def heads(key: np.ndarray) -> np.ndarray:
    """For each 64-bit number, the place of the first equal one. Scatters to a table, again for what collides there."""
    n = len(key)
    out, waiting = np.arange(n), np.arange(n)
    bits = max(8, int(2 * n).bit_length())
    table, turn = np.zeros(1 << bits, np.int64), 0
    while len(waiting):
        turn += 1
        own = key[waiting]
        slot = ((own ^ (own >> np.uint64(turn % 31 + 7))) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn)) >> np.uint64(64 - bits)
        table[slot[::-1]] = waiting[::-1]  # of equal slots, the first place is written last
        head = table[slot]
        same = key[head] == own
        out[waiting[same]] = head[same]
        waiting = waiting[~same]
    return out
