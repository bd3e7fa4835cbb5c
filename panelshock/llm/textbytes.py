"""Words, hashes and shingles of whole texts as NumPy arrays over their UTF-8 bytes.

Everything here works on one slice of an Arrow batch: a byte buffer and the offsets of its
rows. A slice holds about ``SLICE_BYTES`` or one row, so memory follows the longest text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
#: for steps that keep several words of 64 bits a byte
SMALL_SLICE = 250_000
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
UPPER = np.arange(256, dtype=np.uint8)
UPPER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words with even bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, count: int) -> np.ndarray:
    """``count`` pseudo-random odd 64-bit constants, the same everywhere."""
    step = np.uint64(0x9E3779B97F4A7C15)
    return mix((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 20)) * step) | np.uint64(1)


BYTE_VALUES = stream(1, 256)
PLACES = stream(2, 64)
BASE = int(stream(3, 1)[0])
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < count:
        size = max(count, SLICE_BYTES)
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        have = np.cumprod(factors, dtype=np.uint64)
        if size <= SLICE_BYTES:
            _powers[base] = have
    return have


def row_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, dtype=np.int64 if wide else np.int32) if places is not None and places.size else np.zeros(1, np.int64)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) <= len(column):
        offsets = np.zeros(len(column) + 1, np.int64)
    buffer = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buffer[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a column with their bytes and offsets, each of about ``size`` bytes or one row."""
    data, offsets = row_bytes(column)
    begin, rows, size = 0, len(offsets) - 1, size or SLICE_BYTES
    while begin < rows:
        end = int(np.searchsorted(offsets, offsets[begin] + size, side="right")) - 1
        end = min(rows, max(end, begin + 1))
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of each maximal run of bytes that are no separators."""
    inside = np.zeros(len(data) + 1, dtype=bool)
    np.logical_not(separator[data], out=inside[:-1])
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    begins = np.flatnonzero(inside & (first | ~before))
    ends = np.flatnonzero(before & (first | ~inside))
    rows = np.searchsorted(offsets, begins, side="right") - 1
    return begins, ends, rows


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from one running polynomial per slice."""
    out = np.empty(len(begins), dtype=np.uint64)
    done = 0
    while done < len(begins):
        start = int(begins[done])
        upto = max(done + 1, int(np.searchsorted(ends, start + SLICE_BYTES, side="right")))
        part = data[start : int(ends[upto - 1])]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(values[part] * _power(BASE, len(part))[: len(part)], out=total[1:])
        b, e = begins[done:upto] - start, ends[done:upto] - start
        out[done:upto] = mix((total[e] - total[b]) * _power(INVERSE, len(part) + 1)[b] + (e - b).astype(np.uint64))
        done = upto
    return out


LOWER_VALUES = BYTE_VALUES[UPPER]


def shingle_hashes(words: np.ndarray, rows: np.ndarray, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words inside a row, in order. A row with fewer
    words, but not none, has its whole sequence as its only shingle."""
    per_row = np.bincount(rows, minlength=count) if len(rows) else np.zeros(count, np.int64)
    total = max(0, len(words) - size + 1)
    full = np.zeros(total, dtype=np.uint64)
    for j in range(size):
        full += words[j : j + total] * PLACES[j]
    whole = rows[: total] == rows[size - 1 :] if total else np.zeros(0, bool)
    hashes, owner = mix(full[whole] + PLACES[size]), rows[:total][whole]
    short = np.flatnonzero((per_row > 0) & (per_row < size))
    if len(short):
        starts = np.searchsorted(rows, short)
        sums = PLACES[size] + per_row[short].astype(np.uint64) * PLACES[size + 1]
        for j in range(size - 1):
            has = per_row[short] > j
            sums[has] += words[starts[has] + j] * PLACES[j]
        hashes, owner = np.concatenate([hashes, mix(sums)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each slice the first row and the sorted distinct shingles of its rows; A-Z count as
    a-z, words end at white space of ASCII."""
    for begin, end, data, offsets in slices(column, SMALL_SLICE):
        begins, ends, rows = word_spans(data, offsets)
        hashes, owner = shingle_hashes(word_hashes(data, begins, ends, LOWER_VALUES), rows, end - begin, size)
        cuts = np.searchsorted(owner, np.arange(end - begin + 1))
        yield begin, [np.unique(hashes[cuts[i] : cuts[i + 1]]) for i in range(end - begin)]
