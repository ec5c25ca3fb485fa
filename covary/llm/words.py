"""Vectorised words of Arrow text columns: all bytes of a batch at once, no per-word Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240501)
_CELLS = _rng.integers(0, 2**64, (64, 256), dtype=np.uint64).ravel()
STEP = U(0x9E3779B97F4A7C15)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def cells(body: np.ndarray, within: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each byte at its place in its word (a sum of these tells words apart, whatever pattern they have)."""
    out = _CELLS[(within & 63) << 8 | body]
    far = np.flatnonzero(within > 63)
    if len(far):
        out[far] = mix(out[far] ^ (within[far] >> 6).astype(np.uint64) * STEP)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, none of them empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if len(starts) > 1 << 15:  # bounds what is held
        return np.concatenate([span_hashes(data, starts[i : i + (1 << 15)], lengths[i : i + (1 << 15)]) for i in range(0, len(starts), 1 << 15)])
    first = np.cumsum(lengths) - lengths
    at = spread(starts, lengths)
    values = cells(data[at], np.arange(len(at)) - np.repeat(first, lengths))
    return mix(np.add.reduceat(values, first) ^ (lengths.astype(np.uint64) * U(0xD6E8FEB86659FD93)))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes of text each, or of one row."""
    _, at = text_bytes(column)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + limit, "right")) - 1)
        yield start, stop
        start = stop


def word_spans(data: np.ndarray, at: np.ndarray, cut: np.ndarray | None = None, space: np.ndarray = SPACE) -> tuple[np.ndarray, ...]:
    """Words [^\\x20\\x09-\\x0D]+ of every text: (starts, lengths, positions of word bytes, each word's first among them).

    cut marks further bytes at which a word begins; space has the bytes that are in no word.
    """
    inside = ~space[data]
    begins = np.ones(len(data), bool)
    begins[1:] = ~inside[:-1]
    edge = at[:-1]
    begins[edge[edge < len(data)]] = True
    if cut is not None:
        begins |= cut
    begins &= inside
    starts = np.flatnonzero(begins)
    places = np.flatnonzero(inside)
    first = np.searchsorted(places, starts)
    lengths = np.diff(np.append(first, len(places)))
    return starts, lengths, places, first


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True, cut: np.ndarray | None = None, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, text, start, length) of every word, in order; A-Z are lower-cased first if lower."""
    starts, lengths, places, first = word_spans(data, at, cut, space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), starts, lengths
    within = np.arange(len(places)) - np.repeat(first, lengths)
    body = data[places]
    values = cells(LOWER[body] if lower else body, within)
    hashes = mix(np.add.reduceat(values, first) ^ (lengths.astype(np.uint64) * U(0xD6E8FEB86659FD93)))
    return hashes, np.searchsorted(at, starts, "right") - 1, starts, lengths


def per_text(texts: np.ndarray, n: int) -> np.ndarray:
    """n + 1 bounds of each text's words, given every word's text in order."""
    return np.searchsorted(texts, np.arange(n + 1))


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + counts[i] - 1 for all i, one after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
