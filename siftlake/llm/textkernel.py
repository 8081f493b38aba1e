"""Arrow and numpy kernels shared by the text operators: bounded slices, word positions, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_MASK = (1 << 64) - 1


def string_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column as large_string with nulls replaced by the empty string."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows whose texts take at most so many bytes, or of one longer text."""
    col = string_column(batch, name)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(col))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _splitmix(seed: int, n: int) -> np.ndarray:
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = _splitmix(0xA5A5, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


#: Bytes that belong to a word when punctuation parts words too: letters, digits and all that isn't ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the index of its first word; words are runs without ASCII white space, or of letters."""
    n = len(data)
    if not n:
        zero = np.zeros(0, np.int64)
        return zero, zero, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data] if letters is None else letters[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:n]
    closes[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, A-Z taken as a-z if lower."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        # a run of whole words of at most SLICE_BYTES, or one longer word
        end = max(first + 1, int(np.searchsorted(ends, starts[first] + SLICE_BYTES, "right")))
        low, high = starts[first], ends[end - 1]
        part = data[low:high]
        up, down = _powers(len(part))
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[_LOWER[part] if lower else part] * up[: len(part)], out=sums[1:])
        s, e = starts[first:end] - low, ends[first:end] - low
        out[first:end] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = end
    return out


_PLACE = _splitmix(0x51ED, 64) | np.uint64(1)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n neighbouring values, over the whole array."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total += hashes[k : k + count] * _PLACE[k]
    return mix(total)


def pair_hashes(hashes: np.ndarray, apart: int) -> np.ndarray:
    """A 64-bit hash of each value and the one so many places later; equal pairs agree whatever their distance."""
    return mix(hashes[:-apart] * _PLACE[0] + hashes[apart:] * _PLACE[1])


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """A 64-bit hash of a short whole sequence, apart from the hashes of windows."""
    total = np.array([len(hashes) + 0x777], np.uint64)
    for k in range(len(hashes)):
        total = mix(total + hashes[k : k + 1] * _PLACE[k])
    return total[0]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
