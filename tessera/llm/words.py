"""Word boundaries and word hashes of many texts at once, on the bytes of an Arrow string column."""

import numpy as np
import pyarrow as pa

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VALUES = (np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[_FOLD]
_LETTERS = np.zeros(256, bool)
_LETTERS[48:58] = _LETTERS[97:123] = _LETTERS[65:91] = _LETTERS[128:] = True
_powers: list[np.ndarray] = []


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one behind the other, and the offsets (one more than texts). Nulls are empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of the multiplier and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        _powers[:] = []
        for base in (MULTIPLIER, np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p, dtype=np.uint64))
    return _powers[0], _powers[1]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (excluded) of maximal runs of 0-9, A-Z, a-z and bytes from 128, and the first word's number per text.

    No run crosses from one text to the next.
    """
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = _LETTERS[raw]
    begins, stops = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    begins[edge] = inside[1:-1][edge]
    stops[edge - 1] = inside[1:-1][edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per span of the bytes with A-Z in lower case; equal words have equal hashes, wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * power[: len(raw)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))
