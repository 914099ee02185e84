"""JSON arrays of objects in single files, read by many tasks.

A file is read as chunks that end at closing braces, which a reader can find from any byte on. A task joins its chunks to
blocks of about a megabyte. Which braces close an object of the array, and which stand in a string or further down, follows
from what comes before a block: whether it begins in a string, how deep, and after how many objects. For either answer to
the first a block tells what it opens less what it closes and at which depths its braces close. Running sums over these
numbers, a row per block, then settle all three, and each block is cut into objects where it lies. Only what stands before
the first and behind the last end of a block is moved, to be put together with its neighbours': about an object per block.
An object's text, or a block, is the most that is held at once.

The blocks, their sums and the objects are written to the shared folder when a reader is made, so that nothing is cut twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.plans.ordered import before
from gradeframe.session import fresh_dir

#: Bytes from which a block ends.
BLOCK_BYTES = 1 << 20
_PLACE = ["file", "start", "nth"]
_BLOCKS = (
    "file string, start long, nth long, text binary, quotes long, change array<long>, levels array<array<long>>, "
    "counts array<array<long>>"
)
_PARTS = "file string, pos long, start long, nth long, text binary, inside boolean, ends boolean"

_Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tasks(block_bytes: int) -> tuple[_Task, _Task]:
    """What tasks do: chunks to blocks, and blocks to parts. Nested functions travel to the workers by value, so that
    executors need not have this package."""
    quote, brace = 1, 4
    kinds = np.zeros(256, np.uint8)
    kinds[list(b'"{[]}')] = [quote, 2, 2, 3, brace]
    steps = np.array([0, 0, 1, -1, -1])
    blank, mark = b" \t\n\x0b\f\r,[", b"\xef\xbb\xbf"

    def signs(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and kind of quotes, brackets and braces, and the quotes so far."""
        raw = np.frombuffer(text, np.uint8)
        kind = kinds[raw]
        slash = np.flatnonzero(raw == ord("\\"))
        if len(slash):
            # an odd run of backslashes escapes what follows; escaped signs neither begin nor end anything, and no escape
            # goes across a closing brace
            first = np.flatnonzero(np.diff(slash, prepend=-2) != 1)
            last = np.append(first[1:], len(slash)) - 1
            escaped = slash[last[(last - first) % 2 == 0]] + 1
            kind[escaped[kind[escaped] != brace]] = 0
        at = np.flatnonzero(kind)
        kind = kind[at]
        return at, kind, np.cumsum(kind == quote)

    def depths(kind: np.ndarray, quotes: np.ndarray, parity: int) -> tuple[np.ndarray, np.ndarray]:
        """The depth behind each sign, from that of the block's begin, and which signs are braces that close."""
        outside = (quotes + parity) % 2 == 0
        return np.cumsum(np.where(outside, steps[kind], 0)), outside & (kind == brace)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "start", "nth", "text", "quotes", "change", "levels", "counts"]
        piece, nth, held, size = None, 0, [], 0

        def made() -> pa.RecordBatch:
            joined = (pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c), "}")[0] for c in held)
            text = b"".join(part for j in joined for part in (j.as_buffer().to_pybytes(), b"}"))
            _, kind, quotes = signs(text)
            change, levels, counts = [], [], []
            for parity in (0, 1):
                depth, closing = depths(kind, quotes, parity)
                level, count = np.unique(depth[closing], return_counts=True)
                change.append(int(depth[-1]))
                levels.append(level.tolist())
                counts.append(count.tolist())
            one, lists = pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64()))
            types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), one, lists, lists]
            row = [*piece, nth, text, int(quotes[-1]), change, levels, counts]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            file, start, chunk = (batch.column(c) for c in ("file", "start", "chunk"))
            if not len(batch):
                continue
            first = start.to_numpy()
            ends = np.cumsum(pc.binary_length(chunk).to_numpy().astype(np.int64) + 1)
            other = (first[1:] != first[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)
            cut = other | (np.diff(ends // block_bytes) > 0)
            cuts = [0, *(np.flatnonzero(cut) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                mine = [file[a].as_py(), int(first[a])]
                if held and (mine != piece or size >= block_bytes):
                    yield made()
                    nth, held, size = nth + 1, [], 0
                if mine != piece:
                    piece, nth = mine, 0
                held.append(chunk[a:b])
                size += int(ends[b - 1] - (ends[a - 1] if a else 0))
        if held:
            yield made()

    def bare(text: bytes) -> bytes:
        text = text.lstrip(blank)
        while text.startswith(mark):
            text = text[len(mark) :].lstrip(blank)
        return text

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "pos", "start", "nth", "text", "inside", "ends"]
        for batch in batches:
            places = zip(*(batch.column(c).to_pylist() for c in ("file", "start", "nth", "parity", "depth", "pos")), strict=True)
            for (file, start, nth, parity, depth, pos), body in zip(places, batch.column("text"), strict=True):
                text = body.as_py()
                at, kind, quotes = signs(text)
                level, closing = depths(kind, quotes, parity)
                cuts = [0, *(at[closing & (level + depth == 1)] + 1).tolist(), len(text)]
                found = [text[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                n = len(found)
                inside = np.zeros(n, bool)
                inside[1:-1] = True
                rows = [
                    pa.array([file] * n, pa.string()),
                    pa.array(pos + np.arange(n)),
                    pa.array([start] * n, pa.int64()),
                    pa.array([nth] * n, pa.int64()),
                    pa.array([bare(t) if i else t for t, i in zip(found, inside.tolist(), strict=True)], pa.binary()),
                    pa.array(inside),
                    pa.array(np.arange(n) < n - 1),
                ]
                made = pa.RecordBatch.from_arrays(rows, names=names)
                yield made if found[-1] else made[:-1]

    return blocks, parts


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, text) of every object that is an entry of a file's array, in the file's order."""
    to_blocks, to_parts = _tasks(BLOCK_BYTES)
    chunks = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("chunk"),
    )
    blocks = _written(chunks.mapInArrow(to_blocks, _BLOCKS), "array-blocks")
    earlier = before(["file"], ["start", "nth"])

    def running(c: str) -> Column:
        return F.coalesce(F.sum(c).over(earlier), F.lit(0))

    sums = blocks.drop("text").withColumn("parity", (running("quotes") % 2).cast("int"))
    sums = sums.withColumn("_change", F.get("change", F.col("parity"))).withColumn("depth", running("_change"))
    place = F.array_position(F.get("levels", F.col("parity")), 1 - F.col("depth"))
    n = F.coalesce(F.get(F.get("counts", F.col("parity")), (place - 1).cast("int")), F.lit(0))
    sums = sums.withColumn("_n", n).withColumn("pos", running("_n")).select(*_PLACE, "parity", "depth", "pos")
    placed = blocks.select(*_PLACE, "text").join(_written(sums, "array-sums"), _PLACE)
    parts = _written(placed.mapInArrow(to_parts, _PARTS), "array-parts")
    inside = parts.where("inside").select("file", "pos", F.col("text").cast("string").alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("start", "nth", F.col("text").cast("string").alias("text"))))
    text = F.array_join(F.transform(listed, lambda p: p["text"]), "")
    torn = parts.where("NOT inside").groupBy("file", "pos").agg(text.alias("text"), F.bool_or("ends").alias("_whole"))
    torn = torn.where("_whole").select("file", "pos", F.regexp_replace("text", r"^[\s,\[\x{FEFF}]+", "").alias("text"))
    return inside.unionByName(torn)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, pos, the schema's columns) of the arrays' objects."""
    rows = array_objects(spark, path).withColumn("_o", F.from_json("text", schema))
    return rows.select("file", "pos", "_o.*")
