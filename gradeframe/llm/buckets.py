"""Packing by power-of-two decomposition: no sequence crosses documents, and none is padded.

A document's tokens are cut into pieces whose lengths are powers of two, the longest first: as many of the full length
as there are, then the binary digits of what is left. Every piece is a sequence of its own, and sequences of equal
length share a bucket, from which batches of a constant number of tokens are taken.

Tokenizing and cutting is work of a row alone. Pieces get their place in the bucket without a shuffle: each task numbers
its pieces of each length, and only the counts by task and length are summed up, a window over a row per task in each of
the buckets.

Null and empty texts have the end token alone and are a sequence of length 1. Repeated rows and rows with equal or missing
ids are packed each. Extra columns are left out. A table without rows gives none. A long text is one row's work and memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.rows import prepared, written
from gradeframe.llm.units import ByteLevel, Known, cut, whole

CAPACITY, END = 2048, 1
#: The bucket's number stands above this bit of a sequence's number, the place in the bucket below.
PLACE_BITS = 56
#: Units that a Python worker remembers.
CACHE = 800_000


class Encoder:
    """Token ids of whole texts."""

    def __init__(self, path: str):
        self.level = ByteLevel(path, special=True)
        self.known = Known(self._learn, self._forget, CACHE)

    def _forget(self) -> None:
        self.first, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, first: int, bodies: list[bytes]) -> None:
        count, ids = self.level.encode(bodies)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, off: np.ndarray, data: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets and ids; each row ends with the end token."""
        if self.level.cuts:
            # a special token's string must stay in one unit
            w = cut(off, data, fine=not any(s in data.tobytes() for s in self.level.special))
        else:
            w = whole(off, data)
        number = self.known.find(w)
        first, count = self.first[number], self.count[number]
        sums = np.concatenate([[0], np.cumsum(count)])
        rows = sums[w.first] + np.arange(len(w.first))
        ids = np.full(rows[-1], end, np.uint32)
        place = np.ones(rows[-1], bool)
        place[rows[1:] - 1] = False
        ids[place] = self.ids[tx.ragged(first, count)]
        return rows, ids


def decompose(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The row and the length of each piece, for rows of the given sizes: the full length as often as it fits, then
    descending powers of two. capacity: a power of two."""
    if capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    bits = np.arange(capacity.bit_length() - 2, -1, -1)
    times = np.empty((len(sizes), len(bits) + 1), np.int64)
    times[:, 0] = sizes // capacity
    times[:, 1:] = (sizes[:, None] >> bits) & 1
    lengths = np.append(capacity, np.int64(1) << bits)
    row = np.repeat(np.arange(len(sizes)), times.sum(axis=1))
    return row, np.repeat(np.tile(lengths, len(sizes)), times.ravel())


_encoders: dict[str, Encoder] = {}


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        seen = np.zeros(64, np.int64)
        for batch in tx.slices(batches, "text"):
            rows, ids = _encoders[path].encode(*tx.buffer(batch.column("text")), end)
            sizes = np.diff(rows)
            row, length = decompose(sizes, capacity)
            # pieces of a row lie side by side
            before = np.cumsum(length) - length
            low = before  # rows too lie side by side
            start = before - rows[row]
            level = np.log2(length).astype(np.int64)
            order = np.argsort(level, kind="stable")
            counts = np.bincount(level, minlength=64)
            nth = np.empty(len(row), np.int64)
            nth[order] = tx.ragged(seen, counts)
            seen += counts
            raw = ids.astype("<u4").tobytes()
            bodies = [raw[a:b] for a, b in zip((4 * low).tolist(), (4 * (low + length)).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length)]
            columns += [pa.array([zlib.crc32(b) for b in bodies], pa.int64()), pa.array(sizes[row])]
            columns += [pa.array(np.full(len(row), part, np.int64)), pa.array(nth)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"]
            if with_ids:
                columns.append(pa.array(bodies, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length),
    position (dense within the bucket), and on request the ids as little-endian 32-bit numbers. The pieces are written
    to the shared folder. `tokenizer`: path of a tokenizers file that all executors can read."""
    prepared(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part long, nth long"
    made = written(rows.mapInArrow(_cut(tokenizer, capacity, end, with_ids), schema + ", ids binary" * with_ids), "pieces")
    counts = made.groupBy("length", "part").count()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    bucket, position = F.log2("length").cast("int"), F.col("before") + F.col("nth")
    return made.join(counts, ["length", "part"]).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.shiftleft(bucket.cast("long"), PLACE_BITS) + position).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        bucket.alias("bucket"),
        position.alias("position"),
        *["ids"] * with_ids,
    )


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pieces(docs, tokenizer)


def batches(packed: DataFrame, tokens: int) -> DataFrame:
    """The sequences with `batch`, dense within the bucket: as many of one length as `tokens` hold. A bucket's last batch
    may hold fewer."""
    return packed.withColumn("batch", F.floor(F.col("position") / F.greatest(F.lit(1), F.lit(tokens) / F.col("length"))))


def write_buckets(packed: DataFrame, path: str) -> None:
    """A folder per bucket, so that a reader of one length opens that length's files only."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)
