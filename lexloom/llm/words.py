"""Words of whole texts as integer codes, for numpy work inside Arrow tasks.

A word is a maximal run of characters other than space and U+0009 to U+000D.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20  # text handled at once inside a task
_U64 = np.uint64


def slices(batches, text: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece holds about ``max_bytes`` of text (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // max_bytes
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield batch.slice(int(a), int(b - a))


def split(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, bounds, vocabulary): row i has the words vocabulary[codes[bounds[i]:bounds[i + 1]]].

    A null text has no words. ``lower`` maps A-Z to a-z and nothing else.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    word = pc.greater(pc.binary_length(flat), 0)
    kept = np.r_[0, np.cumsum(word.to_numpy(zero_copy_only=False), dtype=np.int64)]
    coded = flat.filter(word).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), kept[ends], coded.dictionary


def hashes(values: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hash of every string."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(v, seed) for v in values.cast(pa.binary()).to_pylist()), dtype=_U64, count=len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finisher: spreads every input bit over all 64."""
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def rolling(word_hash: np.ndarray, bounds: np.ndarray, width: int, factor: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` consecutive words of one row: (start positions, hashes).

    Positions count over the flat word array; runs never cross rows.
    """
    n = len(word_hash)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, _U64)
    total = np.zeros(n - width + 1, _U64)
    for k in range(width):  # Horner; one pass over the words for each place of the run
        total = total * _U64(factor) + word_hash[k:n - width + 1 + k]
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(np.arange(n - width + 1) + width <= row_end[:n - width + 1])
    return starts, mix(total[starts])


def row_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of every word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
