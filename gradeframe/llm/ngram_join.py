"""N-gram Jaccard join with set-relation skipping.

A document's set are its distinct five-word shingles; equal sets are one class. Shingles are ordered from rare to
frequent (by coarse counts over the whole corpus, then by hash), and two sets can only be similar if they share one of
the first shingles of each (prefix filter). A set whose first shingles all occur once is alone and goes no further.

Index lists hold, for a shingle and a block of set sizes, the sets that have it among their first ones, with size and
position. Lists are read block by block: sizes that are too far apart and positions that leave too little to share are
skipped together.

Sets whose first shingles are frequent belong to large families of near copies, whose lists would pair all with all.
Each such set is first compared with a highly similar representative r (the set with the most frequent shingles among
those that share one of its last shingles), and its answers are derived from r's. Two sets of one family that are both
linked with r need no comparison: they are connected. Otherwise |x & y| is |x & y & r| plus what they share outside r, so
that either they meet in the list of a shingle outside r, or min(|x & r|, |y & r|) must reach the overlap asked for, which
the sizes of a list decide for whole blocks. Remaining pairs are verified exactly on the sets.

Empty and null texts have an empty set and are alone. Texts of one to four words have their whole sequence as the one
shingle. Null doc_ids join like others, but an id of null is no component id while there is another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.repeats import Filter, repeated, total_bytes
from gradeframe.llm.rows import KEY, apart, components, keyed, written

SHINGLE = 5
#: Counts from which a shingle comes later in the order; the first tells repeated ones, the second frequent ones.
STEPS = (2, 64, 1024, 16384)
#: Similarity 0.8 as overlap: 9 * shared >= 4 * (sizes of both), 5 * shared >= 4 * size.
_LAST = 3
#: A set is derived from a representative that has at least this share of it.
NEAR = 0.4


def needed(n, m):
    """The least overlap of sets of n and m shingles that are linked."""
    return -(-4 * (n + m) // 9)


def shingle_sets(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all rows, sorted in each, and row offsets."""
    w = tx.words(off, data, tx.LOWER_WORDS)
    h = tx.hashes(w)
    full = w.left() >= SHINGLE
    short_row, short = tx.short_rows(h, w.first, SHINGLE)
    row = np.concatenate([w.rows()[full], short_row])
    value = np.concatenate([tx.runs(h, SHINGLE)[full], short])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.append(True, (row[1:] != row[:-1]) | (value[1:] != value[:-1])) if len(row) else np.zeros(0, bool)
    row, value = row[keep], value[keep]
    return value, np.searchsorted(row, np.arange(len(off)))


def _all(batch: pa.RecordBatch) -> np.ndarray:
    return shingle_sets(*tx.buffer(batch.column("text")))[0]


def _prefix(n: np.ndarray) -> np.ndarray:
    """How many first shingles of a set of n must be indexed."""
    return np.where(n > 0, n - -(-4 * n // 5) + 1, 0)


def _ordered(value: np.ndarray, first: np.ndarray, known: Filter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row's shingles from rare to frequent: the order, levels in it, and position in the row."""
    level = known.level(value)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((value, level, row))
    return order, level[order], np.arange(len(value)) - first[:-1][row]


def _sets(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = shared.value
        for batch in tx.slices(batches, "text"):
            value, first = shingle_sets(*tx.buffer(batch.column("text")))
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            total = np.zeros(len(n), np.uint64)
            spread = tx.mix(value + np.uint64(0x9E3779B97F4A7C15))
            full = np.flatnonzero(n)
            if len(full):
                total[full] = np.add.reduceat(spread, first[:-1][full])
            sid = tx.mix(total + n.astype(np.uint64))
            _, level, position = _ordered(value, first, known)
            # the first shingles of a set that are repeated somewhere, and those that are frequent
            early = position < _prefix(n)[row]
            shared_ones = np.bincount(row[early & (level > 0)], minlength=len(n)) > 0
            frequent = np.bincount(row[early & (level > 1)], minlength=len(n)) > 0
            _, once = np.unique(sid, return_index=True)
            sent = np.zeros(len(n), bool)
            sent[once] = True
            sent &= shared_ones
            raw = value.astype("<u8")
            bodies = [
                raw[a:b].tobytes() if s else None
                for a, b, s in zip(first[:-1].tolist(), first[1:].tolist(), sent.tolist(), strict=True)
            ]
            columns = [batch.column("key"), pa.array(n), pa.array(tx.signed(sid)), pa.array(frequent)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bodies, pa.binary())], names=["key", "n", "sid", "family", "body"]
            )

    return run


def _bodies(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of all rows, and row offsets."""
    off, data = tx.buffer(column)
    return data.view("<u8") if len(data) else np.zeros(0, np.uint64), off // 8


def _heads(shared):
    """For sets of families: their last shingles in the order, with the count of frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "body"):
            value, first = _bodies(batch.column("body"))
            order, level, position = _ordered(value, first, shared.value)
            n = np.diff(first)
            row = np.repeat(np.arange(len(n)), n)
            weight = np.bincount(row[level > 1], minlength=len(n))
            last = np.flatnonzero(position >= n[row] - _LAST)
            sid = batch.column("sid").to_numpy()[row[last]]
            columns = [pa.array(tx.signed(value[order[last]])), pa.array(sid), pa.array(weight[row[last]])]
            yield pa.RecordBatch.from_arrays(columns, names=["shingle", "sid", "weight"])

    return run


def _common(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The overlap of the sets in each row."""
    x, fx = _bodies(a)
    y, fy = _bodies(b)
    rows = np.concatenate([np.repeat(np.arange(len(f) - 1), np.diff(f)) for f in (fx, fy)])
    values = np.concatenate([x, y])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    twice = np.flatnonzero((values[1:] == values[:-1]) & (rows[1:] == rows[:-1]))
    return np.bincount(rows[twice], minlength=len(fx) - 1)


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.slices(batches, "body_a", 1 << 20):
        shared = _common(batch.column("body_a"), batch.column("body_b"))
        columns = [batch.column(c) for c in ("a", "b", "n_a", "n_b")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(shared)], names=["a", "b", "n_a", "n_b", "shared"])


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) for pairs (a, b) of set numbers."""
    for side in ("a", "b"):
        named = sets.select(F.col("sid").alias(side), F.col("n").alias(f"n_{side}"), F.col("body").alias(f"body_{side}"))
        pairs = pairs.join(named, side)
    columns = ["a", "b", "n_a", "n_b", "body_a", "body_b"]
    return pairs.select(*columns).mapInArrow(_overlaps, "a long, b long, n_a long, n_b long, shared long")


_ENTRY = """list long, block int, home boolean, sid long, n long, position int, r long, o long, linked boolean,
first boolean, inside boolean"""


def _block(n: np.ndarray) -> np.ndarray:
    """Blocks of sizes so wide that sizes that may be linked are in the same or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.25) + 1e-9).astype(np.int32)


def _entries(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = shared.value
        for batch in tx.slices(batches, "body", 1 << 20):
            value, first = _bodies(batch.column("body"))
            near, near_first = _bodies(batch.column("near"))
            n = np.diff(first)
            order, level, position = _ordered(value, first, known)
            row = np.repeat(np.arange(len(n)), n)
            value = value[order]
            # whether the representative has the shingle; a set of its own has all
            alone = batch.column("near").is_null().to_numpy(zero_copy_only=False)
            rows = np.concatenate([row, np.repeat(np.arange(len(n)), np.diff(near_first))])
            both = np.concatenate([value, near])
            side = np.concatenate([np.zeros(len(row), np.int8), np.ones(len(near), np.int8)])
            at = np.lexsort((side, both, rows))
            match = np.flatnonzero((both[at][1:] == both[at][:-1]) & (rows[at][1:] == rows[at][:-1]))
            inside = alone[row]
            inside[at[match]] = True
            early = position < _prefix(n)[row]
            taken = np.flatnonzero((early | ~inside) & (level > 0))
            r = row[taken]
            sid, o = batch.column("sid").to_numpy(), batch.column("o").to_numpy()
            linked = np.array(batch.column("linked").to_pylist(), bool)
            names = ["list", "block", "home", "sid", "n", "position", "r", "o", "linked", "first", "inside"]
            block = _block(n)[r]
            for home in (True, False):
                columns = [tx.signed(value[taken]), block + (not home), np.full(len(r), home), sid[r], n[r]]
                columns += [position[taken].astype(np.int32), batch.column("r").to_numpy()[r], o[r], linked[r]]
                columns += [early[taken], inside[taken]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return run


def _in_family(e: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one family, of which at least one is not linked with its representative.

    In the list of one of the representative's shingles a pair has to reach its overlap inside the representative. That
    bounds the size of the partner; sets that leave room for none are skipped at once."""
    n, o, linked = e["n"], e["o"], e["linked"]
    if e["inside"].all():
        most = 9 * o // 4 - n
        for i in np.flatnonzero(~linked & (most >= n[0])).tolist():
            low = np.searchsorted(n, -(-4 * n[i] // 5))
            high = np.searchsorted(n, min(5 * n[i] // 4, most[i]), "right")
            j = np.arange(low, high)
            j = j[(9 * o[j] >= 4 * (n[i] + n[j])) & (linked[j] | (j > i))]
            yield np.full(len(j), i), j
        return
    for i in range(len(n) - 1):
        j = np.arange(i + 1, np.searchsorted(n, 5 * n[i] // 4, "right"))
        j = j[~(linked[i] & linked[j])]
        reach = np.minimum(o[i], o[j]) + np.minimum(n[i] - o[i], n[j] - o[j])
        j = j[9 * reach >= 4 * (n[i] + n[j])]
        yield np.full(len(j), i), j


def _across(e: dict[str, np.ndarray], members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of different families: each set outside the largest one against sizes and positions that can be enough."""
    n, left = e["n"], e["n"] - e["position"]
    largest = np.bincount(members).argmax()
    first = e["first"]
    for i in np.flatnonzero((members != largest) & first).tolist():
        j = np.arange(np.searchsorted(n, -(-4 * n[i] // 5)), np.searchsorted(n, 5 * n[i] // 4, "right"))
        j = j[(members[j] != members[i]) & first[j] & ((j > i) | (members[j] == largest))]
        j = j[9 * np.minimum(left[i], left[j]) >= 4 * (n[i] + n[j])]
        yield np.full(len(j), i), j


def _pairs_of(e: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one list and block that may be linked; entries come sorted by size."""
    _, members = np.unique(e["r"], return_inverse=True)
    sizes = np.bincount(members)
    for family in np.flatnonzero(sizes > 1).tolist():
        at = np.flatnonzero(members == family)
        for i, j in _in_family({f: x[at] for f, x in e.items()}):
            yield at[i], at[j]
    if len(sizes) > 1:
        yield from _across(e, members)


def _lists(rows: pa.Table) -> pa.Table:
    c = {f: rows.column(f).to_numpy() for f in rows.schema.names}
    order = np.lexsort((c["sid"], c["n"], c["block"], c["list"]))
    c = {f: x[order].astype(bool if x.dtype == object else x.dtype) for f, x in c.items()}
    heads = np.flatnonzero(np.append(True, (c["list"][1:] != c["list"][:-1]) | (c["block"][1:] != c["block"][:-1])))
    ends = np.append(heads[1:], len(order))
    found = [np.zeros((0, 2), np.int64)]
    for a, b in zip(heads[ends - heads > 1].tolist(), ends[ends - heads > 1].tolist(), strict=True):
        part = {f: x[a:b] for f, x in c.items()}
        sid, home = part["sid"], part["home"]
        for i, j in _pairs_of(part):
            # two guests from smaller sizes have met in their own block
            keep = home[i] | home[j]
            found.append(np.stack([sid[i[keep]], sid[j[keep]]], 1))
    pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def link_sets(sets: DataFrame, known, buckets: int) -> DataFrame:
    """(a, b): links between different sets (sid, n, family, body); every pair that is linked is connected by them."""
    linked = F.col("shared") * 9 >= (F.col("n_a") + F.col("n_b")) * 4
    heads = sets.filter("family").mapInArrow(_heads(known), "shingle long, sid long, weight long")
    best = heads.groupBy("shingle").agg(F.max_by("sid", F.struct("weight", "sid")).alias("b"))
    near = heads.select("shingle", F.col("sid").alias("a")).join(best, "shingle").filter("a != b").select("a", "b")
    near = written(overlaps(near.distinct(), sets).withColumn("linked", linked), "ngram_near")
    derived = near.filter(F.col("shared") >= F.col("n_a") * NEAR).groupBy("a")
    derived = derived.agg(F.max_by(F.struct("b", "shared", "linked"), F.struct("shared", "b")).alias("r"))
    derived = derived.select(
        F.col("a").alias("sid"), F.col("r.b").alias("r"), F.col("r.shared").alias("o"), F.col("r.linked").alias("linked")
    )
    named = sets.select(F.col("sid").alias("r"), F.col("body").alias("near"))
    described = sets.join(derived, "sid", "left").join(named, "r", "left").select(
        "sid",
        F.coalesce("r", "sid").alias("r"),
        F.coalesce("o", "n").alias("o"),
        F.coalesce("linked", F.lit(True)).alias("linked"),
        "body",
        "near",
    )
    entries = described.mapInArrow(_entries(known), _ENTRY)
    dealt = entries.withColumn("bucket", F.pmod(F.xxhash64("list", "block"), F.lit(buckets)))
    pairs = dealt.groupBy("bucket").applyInArrow(lambda t: _lists(t.drop(["bucket"])), "a long, b long").distinct()
    found = overlaps(pairs, sets).withColumn("linked", linked)
    return found.unionByName(near).filter("linked").select("a", "b")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, id, n_shingles, set_id, component_id)."""
    rows = keyed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id").withColumnRenamed(KEY, "key")
    size = total_bytes(rows)
    known = rows.sparkSession.sparkContext.broadcast(repeated(rows.select("text"), _all, size, STEPS))
    made = rows.select("key", "text").mapInArrow(_sets(known), "key long, n long, sid long, family boolean, body binary")
    made = written(made, "ngram_sets")
    sets = made.filter("body IS NOT NULL").dropDuplicates(["sid"]).select("sid", "n", "family", "body")
    sets = written(sets, "ngram_distinct")
    links = link_sets(sets, known, int(max(64, size >> 22)))
    classes = components(links)
    ids = rows.select("key", "id")
    told = made.select("key", "n", "sid").join(classes.withColumnRenamed("node", "sid"), "sid", "left")
    told = told.withColumn("class", F.coalesce("component", "sid")).join(ids, "key")
    least = told.filter("n > 0").groupBy("class").agg(F.min("id").alias("least"))
    return told.join(least, "class", "left").select(
        "key",
        "id",
        F.col("n").alias("n_shingles"),
        F.col("sid").alias("set_id"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return join(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id; columns as they were, whatever their
    names."""
    rows = keyed(apart(docs, "doc_id", "text"))
    told = join(rows.select(F.col(KEY).alias("id"), "text"), "id", "text")
    kept = told.filter("id = component_id").select(F.col("id").alias(KEY))
    return rows.join(kept, KEY, "left_semi").drop(KEY).toDF(*docs.columns)
