"""Vectorised text kernels: Arrow text columns as byte arrays, words, and 64-bit hashes.

All functions take a whole block of texts at once; nothing loops over characters
or words in Python. Separators are ASCII, so UTF-8 bytes can be split at them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes handled at a time by one task; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def row_blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``size`` bytes of ``column`` each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (or binary values) in a row, and where each begins; NULL is empty."""
    binary = pa.types.is_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    column = column.cast(pa.large_binary() if binary else pa.large_string())
    _, offset_buffer, data_buffer = column.buffers()
    if len(column) == 0 or offset_buffer is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offset_buffer, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def byte_set(pattern_bytes) -> np.ndarray:
    """Lookup table that is true for the given byte values."""
    table = np.zeros(256, bool)
    table[list(pattern_bytes)] = True
    return table


#: ``[\x20\x09-\x0D]``
SPACES = byte_set([0x20, *range(0x09, 0x0E)])
#: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``, read after A-Z were lower-cased.
NO_WORD = byte_set([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: Byte table that lower-cases A-Z.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit value per byte value, for polynomial hashes."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) * _BASE)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def inverse(base: int) -> int:
    return pow(int(base), -1, 1 << 64)


class PrefixHashes:
    """Polynomial prefix hashes of a byte block: the hash of any span in constant time.

    hash(s, e) = sum over i in [s, e) of code[byte i] * base ** (i - s), modulo 2 ** 64.
    """

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_codes(seed)[data] * powers(len(data)), out=self.sums[1:])
        self.back = powers(len(data) + 1, np.uint64(inverse(_BASE)))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word."""
    inside = ~separators[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin] = inside[begin]
    last[end] = inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash per span, for spans that don't overlap: the sum of a scrambled value of each byte and its place in the span.

    Unlike a polynomial modulo 2 ** 64 it has no strings that always agree, and other seeds give other sums.
    Lengths are part of it.
    """
    sizes = (ends - starts).astype(np.int64)
    before = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
    value = data[place + np.repeat(starts, sizes)].astype(np.uint64)
    value |= place.astype(np.uint64) << np.uint64(8)
    value *= np.uint64(2 * seed + 1)
    value += np.uint64(seed) * _BASE
    value = mixed(value)
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(value, before[some])
    return mixed(out + sizes.astype(np.uint64) * _BASE)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash per word."""
    return span_hashes(data, starts, ends, seed)


def shingle_hashes(words: np.ndarray, word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and the text of each; a text of fewer words, but not none, is one run."""
    counts = np.diff(word_offsets)
    runs = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs) + word_offsets[text]
    end = word_offsets[1:][text]
    out = np.minimum(counts[text], n).astype(np.uint64)
    for k in range(n):
        here = at + k
        there = here < end
        out = mixed(out * _BASE + np.where(there, words[np.where(there, here, 0)], np.uint64(k))) if len(words) else out
    return out, text


def distinct_per_text(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once per text, ordered by text and value."""
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[keep], text[keep]


def binary16(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """128-bit keys as a binary column."""
    data = np.empty((len(high), 2), np.uint64)
    data[:, 0], data[:, 1] = high, low
    offsets = np.arange(len(high) + 1, dtype=np.int32) * 16
    return pa.BinaryArray.from_buffers(pa.binary(), len(high), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
