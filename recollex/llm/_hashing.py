"""Hashes of words and of runs of words, over whole Arrow string columns with numpy.

A word's hash mixes its bytes eight at a time, so equal hashes of different words have no pattern. The hash of a run of
k words is Rabin and Karp's: a polynomial of the words' hashes at a random base, modulo the prime 2**61 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer document is hashed alone.
CHUNK = 1 << 20
PRIME = (1 << 61) - 1
#: The random base of runs, below PRIME.
BASE = 0x13C6EF372FE94F82
#: Words of more bytes are hashed one by one.
LONG_WORD = 256

#: Bytes outside \x20 and \x09-\x0D: the words of most contracts. Bytes of longer UTF-8 characters belong to words.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
#: Masks that keep the first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    n, at = len(column), column.offset
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks_of(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of about limit bytes, at least one row each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_spans(data: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word of some documents, in order."""
    n_bytes = len(data)
    inside = word_byte[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n_bytes)]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool, word_byte: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some documents in order, and n + 1 word offsets of the documents."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ws, we = word_spans(data, offsets, word_byte)
    return span_hashes(_LOWERED[data] if lower else data, ws, we), np.searchsorted(ws, offsets)


def span_hashes(data: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes from ws to we."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = we - ws
    h = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (eight[ws] & _FIRST[np.minimum(size, 8)]))
    more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while len(more):
        h[more] = mix((h[more] + np.uint64(0xD6E8FEB86659FD93)) ^ (eight[ws[more] + done] & _FIRST[np.minimum(size[more] - done, 8)]))
        done += 8
        more = more[size[more] > done]
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = int.from_bytes(hashlib.blake2b(padded[ws[k] : we[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def _times(x: np.ndarray, c: int) -> np.ndarray:
    """x * c modulo PRIME, for x below 2**61."""
    low, high = np.uint64(c & (1 << 31) - 1), np.uint64(c >> 31)
    x0, x1 = x & np.uint64((1 << 31) - 1), x >> np.uint64(31)
    middle = x1 * low + x0 * high  # below 2**62
    out = (x1 * high << np.uint64(1)) + x0 * low + (middle >> np.uint64(30)) + ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31))
    return _reduced(out)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(PRIME)) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - np.uint64(PRIME), x)


def gram_hashes(words: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Hash of every run of k words (runs over document ends included), len(words) - k + 1 of them: runs of 2**i words
    from two of half the length, and k words from such."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    run, size = _reduced(words), 1  # runs of `size` words
    out, done = None, 0  # runs of `done` words
    while True:
        if k & size:
            if out is None:
                out, done = run, size
            else:  # the longer run first
                out, done = _reduced(_times(run[: len(run) - done], pow(base, done, PRIME)) + out[size:]), done + size
        if 2 * size > k:
            return mix(out)
        run = _reduced(_times(run[:-size], pow(base, size, PRIME)) + run[size:])
        size *= 2


def whole_hash(words: np.ndarray) -> np.uint64:
    return gram_hashes(words, len(words))[0]


def starts_in_documents(word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The document and the place of every run of k words that lies in one document."""
    counts = np.maximum(np.diff(word_offsets) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return doc, np.arange(len(doc)) - np.repeat(first, counts)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, len(x) - w + 1 of them."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = w - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out
