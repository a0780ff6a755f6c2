"""Words of Arrow text columns as numpy arrays: where they are and a 64-bit hash of each, without a Python object a word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes looked at together, which bounds memory for very long texts.
PIECE = 1 << 20
#: Bytes of text whose words are arrays at a time, about.
SLICE = 8 << 20
#: Bytes that part words: the six ASCII white-space characters; or all of ASCII but digits and lower-case letters.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_ALNUM = (np.arange(256) < 0x80) & ~np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x61, 0x7B)])
#: A-Z to a-z, all else as it is.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)

_rng = np.random.Generator(np.random.PCG64(20))
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_BASE = _rng.integers(0, 1 << 63, 1, np.uint64) * np.uint64(2) + np.uint64(1)


class Words(NamedTuple):
    """``data``: the lower-cased bytes of all texts; of each word its row, first byte, end and hash."""

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about SLICE bytes of the column at."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values over all of theirs."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def combine(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of several columns, in order."""
    h = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            h = mix(h * np.uint64(0xA0761D6478BD642F) + c + np.uint64(1))
    return h


def words_of(column: pa.Array, parting: np.ndarray = SPACE) -> Words:
    """The words of every text; a null has none."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(column) else (0, 0)
    raw = column.buffers()[2]
    data = LOWER[np.frombuffer(raw, np.uint8)[first:last]] if raw is not None and last > first else np.empty(0, np.uint8)
    offsets = offsets - first
    letter = ~parting[data]
    edge = letter.copy()  # a word starts where a letter follows none, or a text begins
    edge[1:] &= ~letter[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    edge[begins] = letter[begins]
    start = np.flatnonzero(edge)
    stop = letter.copy()
    stop[:-1] &= ~letter[1:]
    before = begins[begins > 0] - 1
    stop[before] = letter[before]
    end = np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, row, start, end, _hashes(data, start, end))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial in an odd base over random values of the bytes, spread. Words are taken in groups of about PIECE bytes;
    one that is longer alone is taken in pieces."""
    out = np.zeros(len(start), np.uint64)
    size = end - start
    groups = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + PIECE, PIECE), side="left") if len(size) else np.zeros(1, np.int64)
    cuts = np.unique(np.concatenate([[0], groups, [len(size)]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a == 1 and size[a] > PIECE:
            out[a] = _long(data[start[a] : end[a]])
            continue
        sizes = size[a:b]
        if int(sizes.sum()) > 4 * PIECE:  # one long word among short ones
            for k in range(a, b):
                out[k] = _long(data[start[k] : end[k]])
            continue
        at = np.cumsum(sizes) - sizes
        within = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
        where = within + np.repeat(start[a:b], sizes)
        with np.errstate(over="ignore"):
            out[a:b] = np.add.reduceat(_BYTE[data[where]] * _powers(int(sizes.max()))[within], at)
    with np.errstate(over="ignore"):
        return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _BASE[0], np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(p)


def _long(data: np.ndarray) -> np.uint64:
    total, scale, powers = np.uint64(0), np.uint64(1), _powers(min(len(data), PIECE))
    with np.errstate(over="ignore"):
        for at in range(0, len(data), PIECE):
            piece = data[at : at + PIECE]
            total = total + scale * np.add.reduce(_BYTE[piece] * powers[: len(piece)])
            scale = scale * powers[-1] * _BASE[0]
    return total


def counted(h: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of h in order, the place of one of each in h, and how often (or with what weight) it occurs."""
    if not len(h):
        return h, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    n = np.diff(np.append(head, len(s))) if weights is None else np.add.reduceat(weights[order], head)
    return s[head], order[head], n.astype(np.int64)


def distinct_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values of h in order, the place of one of each in h, and for each of h where its value is among them."""
    if not len(h):
        return h, np.empty(0, np.int64), np.empty(0, np.int64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    where = np.empty(len(h), np.int64)
    where[order] = np.cumsum(first) - 1
    return s[first], order[first], where
