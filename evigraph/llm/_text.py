"""Vectorised byte kernels shared by the training-data operators.

All of them work on the UTF-8 buffers of Arrow string columns, so no Python string is made per row.
Texts are taken whole; a chunk holds several texts or one long one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Texts in a chunk at most, so that a text's place in it fits 16 bits.
MAX_ROWS = 60_000
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)


def fold_case(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the capitals from U+00C0 to U+00DE in lower case; no byte moves."""
    low = LOWER[data]
    if len(low) > 1:
        second = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
        low[second] += 0x20
    return low


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters, digits and bytes of longer code points.
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[48:58] = NOT_WORD[65:91] = NOT_WORD[97:123] = NOT_WORD[128:] = False


def text_chunks(column: pa.Array, limit: int = CHUNK_BYTES, rows: int = MAX_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of runs of texts with about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(n, max(row + 1, end), row + rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(inverse: bool, n: int) -> np.ndarray:
    size = 1 << max(21, int(n).bit_length())
    return _powers(_RINV if inverse else _R, size)[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial hash of bytes i to j, times R**i."""
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(False, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(True, len(prefix))[start])


def window_hash(prefix: np.ndarray, width: int) -> np.ndarray:
    """The hash of each window of ``width`` bytes, by its start."""
    n = max(0, len(prefix) - width)
    return mix((prefix[width : width + n] - prefix[:n]) * powers(True, len(prefix))[:n]) if n else np.zeros(0, U64)


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and how many words stand before each text's start (one more entry than texts)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = ~separator[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    begin = inside[1:] & (~inside[:-1] | cut)
    stop = inside[:-1] & (~inside[1:] | cut)
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop)
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, starts, ends, words before each text)."""
    low = LOWER[data]
    starts, ends, before = words(low, offsets, separator)
    return span_hash(prefix_hash(low), starts, ends), starts, ends, before


_MULT = [U64(m) for m in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of ``width`` words, its text); a text of fewer words gives all of them as one."""
    h, _, _, before = word_hashes(data, offsets)
    count = np.diff(before)
    owner = np.repeat(np.arange(len(count)), count)
    parts, owners = [], []
    if len(h) >= width:
        m = len(h) - width + 1
        s = np.zeros(m, U64)
        for k in range(width):
            s += (h[k : k + m] ^ (h[k : k + m] >> U64(29))) * _MULT[k % 5] * U64(2 * (k // 5) + 1)
        whole = owner[:m] == owner[width - 1 :]
        parts.append(mix(s[whole]))
        owners.append(owner[:m][whole])
    for d in np.flatnonzero((count > 0) & (count < width)):
        x = U64(0x51ED270B ^ int(count[d]))
        with np.errstate(over="ignore"):
            for k in range(before[d], before[d + 1]):
                x = (x ^ h[k]) * _MULT[0]
                x ^= x >> U64(32)
        parts.append(np.array([x], U64))
        owners.append(np.array([d]))
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(parts), np.concatenate(owners).astype(np.int64)


#: Bits of a shingle's hash in a set; two shingles of one text of 1,000 share one with a chance below 1e-8.
TOKEN_BITS = 48


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 48-bit shingle hashes, ordered by text and then hash; how many stand before each text)."""
    h, owner = shingles(data, offsets, width)
    key = np.sort((owner.astype(U64) << U64(TOKEN_BITS)) | (h >> U64(64 - TOKEN_BITS)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    before = np.searchsorted(key, np.arange(len(offsets), dtype=U64) << U64(TOKEN_BITS))
    return key & U64((1 << TOKEN_BITS) - 1), before
