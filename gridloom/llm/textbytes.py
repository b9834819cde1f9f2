"""Arrow text columns as NumPy bytes: words, hashes and slices of bounded size, without a Python loop per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 4 << 20  # bytes of text handled at once
CHUNK = 1 << 20  # bytes whose words are hashed at once

# White space of the word rule: space, and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_RANDOM = np.random.Generator(np.random.PCG64(20240229))
BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 2 * len(_POWERS), 1024), BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the offsets of its rows; null counts as empty."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        values = pc.fill_null(values, "").cast(pa.large_string()).cast(pa.large_binary())
    else:
        values = pc.fill_null(values.cast(pa.large_binary()), b"")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Row ranges of at most ``limit`` bytes, or of one row."""
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, rows)
        i = min(j, rows)


def segment_hashes(data: np.ndarray, starts: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each segment from one start to the next (or the end); bytes in ``skip`` do not count."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(starts, append=len(data))
    within = np.arange(starts[0], len(data)) - np.repeat(starts, sizes)
    values = BYTE[data[starts[0] :]] * powers(int(within.max()) + 1)[within]
    if skip is not None:
        values[skip[starts[0] :]] = 0
    return mixed(np.add.reduceat(values, starts - starts[0]))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words; a word never crosses a row. Long rows are worked through in chunks."""
    size = len(data)
    heads = np.zeros(size + 1, bool)
    heads[offsets] = True
    starts_all, ends_all, hashes_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    at = 0
    while at < size:
        end = min(size, at + CHUNK)
        while end < size and not (heads[end] or SPACE[data[end]]):
            step = min(size, end + 65536)
            cut = np.flatnonzero(heads[end:step] | SPACE[data[end:step]])
            end = end + int(cut[0]) if len(cut) else step
        part = LOWER[data[at:end]] if lower else data[at:end]
        space, head = SPACE[part], heads[at:end].copy()
        head[0] = True
        before = np.empty(len(part), bool)
        before[0], before[1:] = True, space[:-1]
        starts = np.flatnonzero(~space & (before | head))
        after = np.empty(len(part), bool)
        after[-1], after[:-1] = True, space[1:] | head[1:]
        starts_all.append(starts + at)
        ends_all.append(np.flatnonzero(~space & after) + 1 + at)
        hashes_all.append(segment_hashes(part, starts, space))
        at = end
    return np.concatenate(starts_all), np.concatenate(ends_all), np.concatenate(hashes_all)


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of the given segments, one after another."""
    total = int(sizes.sum())
    ahead = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - ahead, sizes) + np.arange(total)]


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The segments as an Arrow text column."""
    sizes = ends - starts
    body = gathered(data, starts, sizes)
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
