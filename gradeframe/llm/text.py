"""Words and their hashes over whole Arrow batches, without a Python object per word.

A batch of texts is one byte buffer with row offsets. Words are found by a byte table, each gets a 64-bit hash from
a prefix sum of its bytes' terms, and runs of words get theirs from the words' hashes. Work goes over pieces of
bounded size, so that long texts need no more memory than their own buffer and word list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 32
PIECE = 1 << 20

_RANDOM = np.random.default_rng(20240229)
_BYTE_TERMS = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def byte_table(separators: bytes, lower: bool) -> np.ndarray:
    """What each byte counts as: separators as a space, A-Z in lower case if asked for."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    table[list(separators)] = SPACE
    # a byte that is no separator must not look like one
    assert SPACE in separators
    return table


BLANKS = bytes([0x20, *range(0x09, 0x0E)])
CASED_WORDS = byte_table(BLANKS, lower=False)
LOWER_WORDS = byte_table(BLANKS, lower=True)
LETTER_WORDS = byte_table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]), lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        steps = np.full(max(n, PIECE), _STEP if kind == "up" else _STEP_BACK)
        steps[0] = 1
        made = np.cumprod(steps, dtype=np.uint64)
        if n > 4 * PIECE:
            return made  # not kept: one word or text of unusual length
        _powers[kind] = made
    return _powers[kind]


def buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut by rows so that each holds about `most` bytes of the column, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        off, _ = buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            to = min(to, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a batch: byte ranges, and for each row its first word's number (and one entry more)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    folded: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def left(self) -> np.ndarray:
        """Words from each word to its row's end, itself included."""
        return np.repeat(self.first[1:], self.counts) - np.arange(len(self.start))


def words(off: np.ndarray, data: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> Words:
    """cuts: a kind for each byte; between two bytes of kinds above 0 that differ, a word ends and another begins."""
    folded = table[data]
    n = len(folded)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(off), np.int64), folded)
    gap = folded == SPACE
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = edge[:-1].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    after[-1] = True
    if cuts is not None:
        kind = cuts[folded]
        between = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        before[1:] |= between
        after[:-1] |= between
    start = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(after & ~gap) + 1
    return Words(start, end, np.searchsorted(start, off), folded)


def _sums(folded: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges that lie in order."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        low, high = int(start[at]), int(end[to - 1])
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE_TERMS[folded[low:high]] * _power("up", high - low)[: high - low], out=sums[1:])
        s, e = start[at:to] - low, end[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * _power("down", high - low + 1)[s]
        at = to
    return out


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    return mix(_sums(w.folded, w.start, w.end) + (w.end - w.start).astype(np.uint64) * _STEP)


def byte_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which range_hashes takes the hash of any range of bytes."""
    return value_sums(_BYTE_TERMS[data])


def value_sums(h: np.ndarray) -> np.ndarray:
    """The same for 64-bit values."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power("up", len(h))[: len(h)], out=out[1:])
    return out


def range_hashes(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of ranges: equal for equal contents, wherever they lie."""
    return mix((sums[high] - sums[low]) * _power("down", len(sums))[low] + (high - low).astype(np.uint64))


def window_terms(sums: np.ndarray, k: int) -> np.ndarray:
    """For every range of k values what `mix`, after k is added, makes its `range_hashes`."""
    out = sums[k:] - sums[:-k]
    out *= _power("down", len(sums))[: len(out)]
    return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k values that begin at each place; the last k - 1 places hold what is left and mean nothing."""
    out = h * _PLACES[0]
    for j in range(1, k):
        if len(h) > j:
            out[:-j] += h[j:] * _PLACES[j]
    return mix(out + np.uint64(k))


def short_rows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one to k - 1 words, and a hash of each such row's whole sequence."""
    rows, out = [], []
    counts = np.diff(first)
    for n in range(1, k):
        at = np.flatnonzero(counts == n)
        if len(at):
            whole = sum((h[first[at] + j] * _PLACES[j] for j in range(n)), np.zeros(len(at), np.uint64))
            rows.append(at)
            out.append(mix(whole + np.uint64(n)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(out)


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count values each, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)
