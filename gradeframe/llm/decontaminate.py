"""Benchmark decontamination: an FM-index for each training shard, searched backwards for the test phrases.

A shard is a slice of a partition's documents. Words that no test phrase holds can be in no occurrence; they and the
ends of documents part the shard's text into segments, and segments shorter than the shortest phrase are left out.
What remains is indexed whole: suffix array, Burrows-Wheeler transform in a wavelet tree, sampled suffix places. All
phrases are searched backwards at once by wavelet-tree ranks, occurrences located by the sampled places, and the
covered words merged to spans. Documents stay in their rows: nothing is shuffled.

The phrases are broadcast in blocks of at most `BLOCK_BYTES` of benchmark text. A larger benchmark takes more blocks,
one after the other over the same rows, each adding to the row's spans and items.

Null texts have no words. Null item ids are one item, spelled "null". Items of equal id are one item. Items without
words have no phrase. Repeated documents each get their own row; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.rows import apart, prepared
from gradeframe.llm.suffixes import FMIndex

WINDOW = 10
BLOCK_BYTES = 8 << 20
_SPANS, _ITEMS, _WORDS = "__spans", "__items", "__n_words"


class Phrases:
    """The windows of benchmark items as rows of word numbers, each with the items it is from."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        texts = pa.array([t for _, t in items], pa.binary())
        w = tx.words(*tx.buffer(texts), tx.LETTER_WORDS)
        h = tx.hashes(w)
        self.vocabulary = np.unique(h)
        number = np.searchsorted(self.vocabulary, h) + 1
        owners: dict[tuple[int, ...], set[str]] = {}
        for (name, _), low, high in zip(items, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            for at in range(low, max(low, high - window) + 1) if high > low else ():
                owners.setdefault(tuple(number[at : min(at + window, high)].tolist()), set()).add(name)
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.rows = np.zeros((len(owners), window), np.int64)
        for i, p in enumerate(owners):
            self.rows[i, : len(p)] = p
        self.names = np.array(sorted({n for s in owners.values() for n in s}), object)
        where = {n: i for i, n in enumerate(self.names)}
        sets = [sorted(where[n] for n in s) for s in owners.values()]
        self.owner = np.array([i for s in sets for i in s], np.int64)
        self.owned = np.array([len(s) for s in sets], np.int64)
        self.owner_first = np.concatenate([[0], np.cumsum(self.owned)[:-1]]) if sets else np.zeros(0, np.int64)


def occurrences(w: tx.Words, h: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of each occurrence in a shard."""
    none = np.zeros(0, np.int64)
    if not len(phrases.rows) or not len(h):
        return none, none
    at = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == h
    # segments: maximal runs of known words of one document
    row = w.rows()
    cut = np.ones(len(h), bool)
    cut[1:] = (row[1:] != row[:-1]) | ~known[:-1]
    heads = np.flatnonzero(cut & known)
    last = np.ones(len(h), bool)
    last[:-1] = (row[1:] != row[:-1]) | ~known[1:]
    sizes = np.flatnonzero(last & known) + 1 - heads
    long = sizes >= phrases.lengths.min()
    heads, sizes = heads[long], sizes[long]
    if not len(heads):
        return none, none
    # the text: 0, segment, 0, segment, ..., 0
    taken = tx.ragged(heads, sizes)
    places = 1 + np.arange(len(taken)) + np.repeat(np.arange(len(sizes)), sizes)
    symbols = np.zeros(1 + len(taken) + len(sizes), np.int64)
    symbols[places] = at[taken] + 1
    word = np.zeros(len(symbols), np.int64)
    word[places] = taken
    index = FMIndex(symbols, len(phrases.vocabulary))
    low, high = index.search(phrases.rows, phrases.lengths)
    found = index.locate(tx.ragged(low, high - low))
    return word[found], np.repeat(np.arange(len(low)), high - low)


def _shards(phrases, text: str, schema: pa.Schema, first_block: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ph: Phrases = phrases.value
        for batch in tx.slices(batches, text):
            w = tx.words(*tx.buffer(batch.column(text)), tx.LETTER_WORDS)
            start, phrase = occurrences(w, tx.hashes(w), ph)
            n_rows = batch.num_rows
            # covered words, then the covered runs of each row
            cover = np.zeros(len(w.start) + 1, np.int64)
            cover += np.bincount(start, minlength=len(cover))
            cover -= np.bincount(start + ph.lengths[phrase], minlength=len(cover))
            hit = np.cumsum(cover)[:-1] > 0
            row = w.rows()
            edge = np.ones(len(hit), bool)
            edge[1:] = row[1:] != row[:-1]
            heads = np.flatnonzero(hit & (edge | ~np.append(False, hit[:-1])))
            tails = np.flatnonzero(hit & (np.append(edge[1:], True) | ~np.append(hit[1:], False))) + 1
            ranges = np.stack([heads, tails], 1) - w.first[row[heads]][:, None]
            span_first = np.searchsorted(row[heads], np.arange(n_rows + 1)) * 2
            spans = pa.ListArray.from_arrays(span_first.astype(np.int32), ranges.astype(np.int64).ravel())
            # distinct items of each row
            pairs = np.unique(np.stack([row[start], phrase], 1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
            counts = ph.owned[pairs[:, 1]]
            items = ph.owner[tx.ragged(ph.owner_first[pairs[:, 1]], counts)]
            each = np.repeat(pairs[:, 0], counts)
            both = np.unique(each * max(1, len(ph.names)) + items)
            each, items = np.divmod(both, max(1, len(ph.names)))
            item_first = np.searchsorted(each, np.arange(n_rows + 1)).astype(np.int32)
            names = pa.ListArray.from_arrays(item_first, pa.array(ph.names[items].tolist(), pa.string()))
            columns = {f: batch.column(f) for f in batch.schema.names}
            if first_block:
                columns |= {_WORDS: pa.array(w.counts), _SPANS: spans, _ITEMS: names}
            else:
                columns |= {_SPANS: _joined(columns[_SPANS], spans), _ITEMS: _joined(columns[_ITEMS], names)}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def _joined(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([x + y for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], b.type)


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str, bytes]]]:
    """Benchmark items in lists of about BLOCK_BYTES of text; the driver holds one list at a time."""
    rows = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.coalesce(F.col(text), F.lit("")).cast("binary")
    )
    block, size = [], 0
    for name, body in rows.toLocalIterator():
        block.append((name, bytes(body)))
        size += len(body)
        if size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """The documents with three more columns: `__n_words`, `__spans` (flat list of [first, end) word numbers of
    covered runs; runs of several benchmark blocks may overlap) and `__items` (ids with an occurrence)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, LongType, StringType, StructType

    spark = prepared(docs.sparkSession)
    wide = StructType([*docs.schema.fields]).add(_WORDS, LongType()).add(_SPANS, ArrayType(LongType()))
    wide = wide.add(_ITEMS, ArrayType(StringType()))
    first, out = True, docs
    for block in _blocks(benchmark, item_id, item_text):
        shared = spark.sparkContext.broadcast(Phrases(block, window))
        out = out.mapInArrow(_shards(shared, text, to_arrow_schema(wide), first), wide)
        first = False
    if first:
        shared = spark.sparkContext.broadcast(Phrases([], window))
        out = docs.mapInArrow(_shards(shared, text, to_arrow_schema(wide), True), wide)
    return out


def _covered(spans: str):
    """Words in the union of the runs."""
    pairs = F.array_sort(
        F.transform(
            F.filter(spans, lambda _, i: i % 2 == 0), lambda low, i: F.struct(low.alias("low"), F.get(spans, i * 2 + 1).alias("high"))
        )
    )
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("upto"))
    return F.aggregate(
        pairs,
        start,
        lambda acc, run: F.struct(
            (acc["total"] + F.greatest(F.lit(0), run["high"] - F.greatest(run["low"], acc["upto"]))).alias("total"),
            F.greatest(acc["upto"], run["high"]).alias("upto"),
        ),
        lambda acc: acc["total"],
    )


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, words hit, items that occur, and whether any does."""
    found = find(docs.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.array_distinct(_ITEMS))
    return found.select(
        "doc_id",
        F.col(_WORDS).alias("n_words"),
        _covered(_SPANS).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(_SPANS) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any occurrence, columns as they were, whatever their names."""
    found = find(apart(docs, "text"), benchmark).filter(F.size(_SPANS) == 0)
    return found.drop(_WORDS, _SPANS, _ITEMS).toDF(*docs.columns)
