"""How often 64-bit keys occur in a corpus, in coarse steps and bounded memory.

Tasks send each distinct key once with its count (255 at most), cut to 32 bits and dealt into buckets by its leading
bits; a bucket's task sums the counts and sets the bits of the keys that reach a threshold in its own slice of that
threshold's filter. The driver puts the slices side by side: the filters' size has a fixed bound, whatever the corpus. A
filter lets every key that reaches its threshold pass and some others, the more the fuller it is; callers count on the
first only, or on the answer being the same everywhere, so that a full filter costs time and not results.

Keys may come with a 64-bit value each; a filter then also tells the keys that came with several values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.rows import written

MOST_BITS = 1 << 28
_FLUSH = 1_200_000
#: Of a key, the bits that tell no bucket.
_BELOW = np.uint64((1 << 52) - 1)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Filter:
    shift: int  # of a key, down to its bucket
    bits: list[np.ndarray]  # for each threshold, bytes, slice after slice
    sizes: list[int]  # bits of a slice

    def reaches(self, keys: np.ndarray, threshold: int = 0) -> np.ndarray:
        """Whether each key may have reached the threshold of that number."""
        bits, size = self.bits[threshold], self.sizes[threshold]
        bucket = (keys >> np.uint64(self.shift)).astype(np.int64) * size
        out = np.zeros(len(keys), bool)
        # most keys miss their first bit, so that the others are looked at for few
        live, low = np.arange(len(keys)), keys.astype(np.uint32)
        for c in _SPREAD:
            at = bucket[live] + _place(low[live], c, size)
            live = live[bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1]
        out[live] = True
        return out

    def level(self, keys: np.ndarray) -> np.ndarray:
        """How many thresholds each key has reached, one after the other."""
        out = np.zeros(len(keys), np.int8)
        live = np.arange(len(keys))
        for i in range(len(self.bits)):
            live = live[self.reaches(keys[live], i)]
            out[live] = i + 1
        return out


#: Bits that a key sets: a set's many keys must all be told apart from repeated ones.
_SPREAD = [np.uint32(c) for c in (1, 2654435769, 2246822519, 3266489917)]


def _place(low: np.ndarray, c: np.uint32, size: int) -> np.ndarray:
    spread = low * c
    return ((spread ^ (spread >> np.uint32(15))) & np.uint32(size - 1)).astype(np.int64)


def _send(keys_of: Callable, column: str, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in tx.slices(batches, column):
            made = keys_of(batch)
            held.append(made if isinstance(made, tuple) else (made, None))
            n += len(held[-1][0])
            if n > _FLUSH:
                yield _dealt(held, shift)
                held, n = [], 0
        if n:
            yield _dealt(held, shift)

    return run


def _dealt(held: list[tuple[np.ndarray, np.ndarray | None]], shift: int) -> pa.RecordBatch:
    keys = np.concatenate([k for k, _ in held])
    if held[0][1] is None:
        keys, values = np.sort(keys), None
        new = np.append(True, keys[1:] != keys[:-1])
    else:
        values = np.concatenate([v for _, v in held])
        # by bucket, and equal pairs side by side
        order = np.argsort(keys & ~_BELOW | tx.mix(keys * _MIX + values) & _BELOW)
        keys, values = keys[order], values[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (values[1:] != values[:-1]))
    first = np.flatnonzero(new)
    times = np.minimum(255, np.diff(np.append(first, len(keys)))).astype(np.uint8)
    keys = keys[first]
    bucket = (keys >> np.uint64(shift)).astype(np.int32)
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ranges = list(zip(heads.tolist(), np.append(heads[1:], len(keys)).tolist(), strict=True))
    sent = [keys.astype("<u4"), times, values[first].astype("<u4") if values is not None else None]
    columns = [pa.array(bucket[heads])]
    for x in sent:
        columns.append(pa.array([None if x is None else x[a:b].tobytes() for a, b in ranges], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "keys", "times", "values_"])


def _slice(thresholds: tuple[int, ...], sizes: list[int], valued: int | None):
    def run(rows: pa.Table) -> pa.Table:
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), "<u4")
        times = np.frombuffer(b"".join(rows.column("times").to_pylist()), np.uint8)
        if valued is None:
            order = np.argsort(keys)
        else:
            values = np.frombuffer(b"".join(rows.column("values_").to_pylist()), "<u4")
            order = np.argsort((keys.astype(np.uint64) << np.uint64(32)) | values)
            values = values[order]
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.add.reduceat(times[order].astype(np.int64), first)
        several = np.ones(len(first), bool)
        if valued is not None:
            change = np.append(False, (values[1:] != values[:-1]) & (keys[1:] == keys[:-1]))
            several = np.add.reduceat(change.astype(np.int64), first) > 0
        keys = keys[first]
        bodies = []
        for i, (threshold, size) in enumerate(zip(thresholds, sizes, strict=True)):
            reached = times >= threshold
            if valued is not None and i >= valued:
                reached &= several
            bits = np.zeros(size, bool)
            for c in _SPREAD:
                bits[_place(keys[reached], c, size)] = True
            bodies.append(np.packbits(bits, bitorder="little").tobytes())
        columns = {"bucket": rows.column("bucket").slice(0, 1), "bits": pa.array([bodies], pa.list_(pa.binary()))}
        return pa.table(columns)

    return run


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def repeated(
    docs: DataFrame,
    keys_of: Callable,
    size: int,
    thresholds: tuple[int, ...] = (2,),
    valued: int | None = None,
    column: str = "text",
    most_bits: int = MOST_BITS,
) -> Filter:
    """keys_of: from a record batch to its keys, or keys and values; size: bytes of text in all, from which the parts are
    counted. Filters from number `valued` on take only keys with several values, and have a quarter of the bits; those of
    thresholds above 8 have an eighth, as far fewer keys reach them."""
    buckets = 1 << int(np.clip(np.ceil(np.log2(max(1, size / (4 << 20)))), 6, 12))
    shift = 64 - buckets.bit_length() + 1
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, size / 4))), 20, np.log2(most_bits)))
    part = [8 if t > 8 else 4 if valued is not None and i >= valued else 1 for i, t in enumerate(thresholds)]
    sizes = [bits // buckets // p for p in part]
    sent = docs.mapInArrow(_send(keys_of, column, shift), "bucket int, keys binary, times binary, values_ binary")
    made = sent.groupBy("bucket").applyInArrow(_slice(thresholds, sizes, valued), "bucket int, bits array<binary>")
    # written, as an iterator alone would have the partitions made one after the other
    made = written(made, "filter")
    out = [np.zeros(s * buckets // 8, np.uint8) for s in sizes]
    for row in made.toLocalIterator():
        for to, body in zip(out, row.bits, strict=True):
            to[row.bucket * len(body) : (row.bucket + 1) * len(body)] = np.frombuffer(body, np.uint8)
    return Filter(shift, out, sizes)
