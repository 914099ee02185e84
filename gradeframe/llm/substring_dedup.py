"""Substring dedup by recompression.

Every document's word sequence is recompressed in rounds: maximal runs of one symbol get a name, then pairs of a left
and a right symbol do, sides being given by a bit of the name. Names are hashes of what they stand for, so that all tasks
name globally without talking to each other. Each symbol carries the range of words that its making depended on; equal
substrings thus get the same symbols wherever such a range lies inside. A window's anchor is the symbol of the highest
level whose range lies in it (of several, the one with the least hash), a function of the window's words alone. An anchor
is told from others by its level and the words of its range, so that a symbol of frequent words is no repeat as long as
its surroundings are not; a window without any symbol but its words is its own anchor.

Symbols that occur once cannot be in a repeat. A first pass over the corpus finds the repeated anchors (a filter of
bounded size), a second takes the windows of repeated anchors, settles those that the same task saw earlier, and sends
the rest, one for each distinct window and task, to be compared across the corpus by the hash of the window's words. A
window whose words also start earlier (smaller key, or the same document further left) has its words removed.

Null and empty texts have no words. Rows of equal doc_id are taken as separate documents in the order of a hash of their
texts, null doc_ids first. Documents shorter than the window keep all their words. Runs longer than a window are
compared word by word, as their symbols reach beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.repeats import Filter, repeated, total_bytes
from gradeframe.llm.rows import KEY, keyed

WINDOW = 20
ROUNDS = 3
_FLUSH = 2_000_000
_C = [np.uint64(c) for c in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass
class Symbols:
    """Symbols of one level in text order: name, row, and the words [low, high) that they depend on."""

    name: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _named_runs(s: Symbols, first: np.ndarray) -> Symbols:
    joined = (s.name[1:] == s.name[:-1]) & (s.row[1:] == s.row[:-1])
    heads = np.flatnonzero(np.append(True, ~joined))
    tails = np.append(heads[1:], len(s.name)) - 1
    n = (tails - heads + 1).astype(np.uint64)
    name = np.where(n > 1, tx.mix(s.name[heads] * _C[0] + n * _C[1]), s.name[heads])
    # that a run ends is seen by the neighbours; a row's edge is seen by no window
    row = s.row[heads]
    low, high = first[row] - 1, first[row + 1] + 1
    inner = np.append(False, row[1:] == row[:-1])
    low[inner] = s.low[heads[inner] - 1]
    inner = np.append(row[1:] == row[:-1], False)
    high[inner] = s.high[tails[inner] + 1]
    return Symbols(name, row, low, high)


def _named_pairs(s: Symbols, first: np.ndarray, round_: int) -> Symbols:
    left = tx.mix(s.name ^ np.uint64(int(_C[2]) * (round_ + 1) % (1 << 64))) & np.uint64(1) == 1
    near = np.append(s.row[1:] == s.row[:-1], False)  # has a next symbol in its row
    pair = np.zeros(len(left), bool)
    pair[:-1] = left[:-1] & ~left[1:] & near[:-1]
    second = np.append(False, pair[:-1])
    # an unpaired left symbol has seen what follows, an unpaired right one what comes before
    low, high = s.low.copy(), s.high.copy()
    at = np.flatnonzero(left & ~pair)
    high[at] = np.where(near[at], s.high[np.minimum(at + 1, len(left) - 1)], first[s.row[at] + 1] + 1)
    at = np.flatnonzero(~left & ~second)
    before = np.append(False, near[:-1])[at]
    low[at] = np.where(before, s.low[np.maximum(at - 1, 0)], first[s.row[at]] - 1)
    name = s.name.copy()
    at = np.flatnonzero(pair)
    name[at] = tx.mix(s.name[at] * _C[0] + s.name[at + 1] * _C[3] + _C[1])
    high[at] = s.high[at + 1]
    kept = ~second
    return Symbols(name[kept], s.row[kept], low[kept], high[kept])


def recompress(h: np.ndarray, w: tx.Words, rounds: int = ROUNDS) -> list[Symbols]:
    """The symbols of each level, words first."""
    at = np.arange(len(h))
    levels = [Symbols(h, w.rows(), at, at + 1)]
    for r in range(rounds if len(h) else 0):
        levels.append(_named_pairs(_named_runs(levels[-1], w.first), w.first, r))
    return levels


def _least(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The place of the least value in each range [a, b), the first of equal ones."""
    spans = b - a
    out = np.empty(len(a), np.int64)
    table, width = np.arange(len(value)), 1
    while len(a):
        use = (spans >= width) & (spans < 2 * width)
        if use.any():
            x, y = table[a[use]], table[b[use] - width]
            out[use] = np.where(value[y] < value[x], y, x)
        if not (spans >= 2 * width).any():
            break
        x, y = table[:-width], table[width:]
        table = np.where(value[y] < value[x], y, x)
        width *= 2
    return out


def anchors(h: np.ndarray, w: tx.Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows, the name of each one's anchor, and a number of the symbol itself."""
    at = np.flatnonzero(w.left() >= window)
    name, number = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    sums = tx.value_sums(h)
    for level, s in reversed(list(enumerate(recompress(h, w)))):
        if not len(todo):
            break
        if not level:
            name[todo], number[todo] = tx.range_hashes(sums, at[todo], at[todo] + window), at[todo] * (ROUNDS + 1)
            break
        # ranges grow from left to right, so that the symbols inside a window are neighbours
        before = np.cumsum(np.bincount(s.low + 1, minlength=len(h) + 2))
        upto = np.cumsum(np.bincount(s.high, minlength=len(h) + 2))
        i = at[todo]
        a, b = before[i], upto[i + window]
        inside = b > a
        seen = tx.range_hashes(sums, np.clip(s.low, 0, len(h)), np.clip(s.high, 0, len(h)))
        value = tx.mix(seen + s.name + np.uint64(level))
        symbol = _least(value, a[inside], b[inside])
        name[todo[inside]], number[todo[inside]] = value[symbol], symbol * (ROUNDS + 1) + level
        todo = todo[~inside]
    return at, name, number


def _names(batch: pa.RecordBatch) -> np.ndarray:
    w = tx.words(*tx.buffer(batch.column("text")), tx.CASED_WORDS)
    _, name, number = anchors(tx.hashes(w), w)
    # neighbouring windows of one symbol are one occurrence
    return name[np.append(True, number[1:] != number[:-1])] if len(name) else name


def _windows(shared):
    def flush(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        value, key, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, key, value))
        value, key, at = value[order], key[order], at[order]
        first = np.append(True, value[1:] != value[:-1])
        n = int(first.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(tx.signed(value[first])), pa.array(key[first]), pa.array(at[first]), pa.nulls(n, pa.list_(pa.int32()))],
            names=["value", "key", "at", "settled"],
        )
        # the others are repeats; a row per document, dealt by its key
        key, at = key[~first], at[~first]
        if len(key):
            order = np.argsort(key, kind="stable")
            key, at = key[order], at[order]
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lists = pa.ListArray.from_arrays(np.append(heads, len(key)).astype(np.int32), pa.array(at))
            dealt = tx.signed(tx.mix(key[heads].astype(np.uint64) + _C[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(dealt), pa.array(key[heads]), pa.nulls(len(heads), pa.int32()), lists],
                names=["value", "key", "at", "settled"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = shared.value
        held, n = [], 0
        for batch in tx.slices(batches, "text"):
            w = tx.words(*tx.buffer(batch.column("text")), tx.CASED_WORDS)
            h = tx.hashes(w)
            at, name, _ = anchors(h, w)
            at = at[known.reaches(name)]
            if not len(at):
                continue
            row = np.searchsorted(w.first, at, "right") - 1
            key = batch.column("key").to_numpy()[row]
            held.append((tx.range_hashes(tx.value_sums(h), at, at + WINDOW), key, (at - w.first[row]).astype(np.int32)))
            n += len(at)
            if n > _FLUSH:
                yield from flush(held)
                held, n = [], 0
        if n:
            yield from flush(held)

    return run


def repeats(rows: DataFrame) -> DataFrame:
    """(key, starts): first words of the windows whose words also start earlier. rows: key, text."""
    size = total_bytes(rows)
    shared = rows.sparkSession.sparkContext.broadcast(repeated(rows, _names, size))
    open_ = rows.mapInArrow(_windows(shared), "value long, key long, at int, settled array<int>")
    # at most one row for each task and distinct window: a window that a third of all documents share is no larger
    least = F.min(F.when(F.col("settled").isNull(), F.col("key"))).over(Window.partitionBy("value"))
    later = open_.withColumn("least", least).filter("settled IS NOT NULL OR key > least")
    lists = later.groupBy("key").agg(F.collect_list("at").alias("at"), F.collect_list("settled").alias("settled"))
    return lists.select("key", F.concat("at", F.flatten("settled")).alias("starts"))


def removed(w: tx.Words, starts: pa.Array, window: int = WINDOW) -> np.ndarray:
    """Whether each word lies in one of its row's windows."""
    starts = starts.fill_null([])
    counts = starts.value_lengths().to_numpy()
    at = starts.flatten().to_numpy().astype(np.int64) + np.repeat(w.first[:-1], counts)
    edge = np.bincount(at, minlength=len(w.start) + 1) - np.bincount(at + window, minlength=len(w.start) + 1)
    return np.cumsum(edge)[: len(w.start)] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.slices(batches, "text"):
        w = tx.words(*tx.buffer(batch.column("text")), tx.CASED_WORDS)
        keep = ~removed(w, batch.column("starts"))
        start, sizes = w.start[keep], (w.end - w.start)[keep] + 1
        place = tx.ragged(start, sizes)
        body = w.folded[np.minimum(place, max(0, len(w.folded) - 1))]
        ends = np.cumsum(sizes)
        body[ends - 1] = tx.SPACE
        row = w.rows()
        kept = np.bincount(row[keep], minlength=batch.num_rows)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(kept)])]
        raw = body.tobytes()
        texts = [raw[a : max(a, b - 1)] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(w.counts), pa.array(w.counts - kept), pa.array(texts, pa.binary())],
            names=["id", "n_words", "n_removed", "kept"],
        )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (id, n_words, n_removed, kept), kept being the words left, joined by a blank, in UTF-8."""
    rows = keyed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id")
    rows = rows.withColumnRenamed(KEY, "key")
    joined = rows.join(repeats(rows.select("key", "text")), "key", "left")
    kind = dict(rows.dtypes)["id"]
    return joined.select("id", "text", "starts").mapInArrow(
        _cut, f"id {kind}, n_words long, n_removed long, kept binary"
    )


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )
