"""Vectorised hashing of words and bytes, over whole Arrow batches at once.

Texts stay in the Arrow buffers; no Python object is made for a word. A hash of a run of items is a polynomial
modulo 2**64 over well-mixed 64-bit item values, so any run is read from two prefix sums. Sixty-four bits make a
chance collision among 10**9 different runs about as likely as one in forty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
STEP_BYTES = 2_000_000  # texts are hashed in runs of documents of about this size, to bound a task's memory


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64): spreads each input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(BASE))
#: The bytes of [\x20\x09-\x0D].
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < n, kept between calls."""
    if len(_powers.get(0, ((), ()))[0]) < n:
        size = max(n, STEP_BYTES + 65536)
        inverse = pow(BASE, -1, 2**64)
        up, down = np.full(size, U(BASE)), np.full(size, U(inverse))
        up[0] = down[0] = 1
        _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    up, down = _powers[0]
    return up[:n], down[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def runs(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of items start..end-1 of the sequence that sums was made of."""
    down = powers(len(sums))[1]
    return mix((sums[end] - sums[start]) * down[start])


def text_slices(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of rows of about `step` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, side="right")) - 1)
        yield row, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of the words [^\\x20\\x09-\\x0D]+, and for each document the index of its first word (one more at the end)."""
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    first[full] = solid[full]
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return runs(prefix_sums(BYTE_VALUES[data]), starts, ends)


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` items within documents, their first items, and each document's bounds among them."""
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    at = np.concatenate([[0], np.cumsum(counts)])
    first = np.arange(at[-1]) + np.repeat(bounds[:-1] - at[:-1], counts)
    return runs(prefix_sums(hashes), first, first + size), first, at
