"""Token groups of two tokenizers over the same texts, by diagonal run skipping.

Both token rows of a text are arrays of byte offsets where tokens end. While ends agree at the current shift of indices,
tokens are one to one: exponential probing compares ever longer stretches of both arrays, halving finds where they part,
and the stretch is jumped. There the ends are advanced one by one until two agree, which closes an irregular group of
several tokens and gives the new shift. Places where both arrays end a token cut them into groups.

Texts are cut into units in which both tokenizers begin anew (`units`), so a unit's end is a group's end; the ends of all
units that a worker has not met yet are aligned as one pair of arrays, and a unit's groups are remembered with it.

A document links each A token with each B token of its group. How many documents hold a pair of ids linked is counted over
the whole corpus from the documents' distinct pairs, which are written once, numbered by document. A document's sums are
taken from the `COMMON` most frequent pairs in its own row; its other pairs are joined with the table of counts and
summed per document.

Null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens and no pairs. Repeated
rows and rows with equal or missing ids are documents each. Extra columns are left out. A table without rows gives
none. A long text is one row's work and memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.rows import prepared, written
from gradeframe.llm.units import ByteLevel, Known, cut, whole

#: Pairs that all tasks are told the counts of, at most.
COMMON = 500_000
#: Groups of more links than this are counted by distinct ids.
WIDE = 4096
#: Units that a Python worker remembers.
CACHE = 400_000


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group the index after its last A token and after its last B token.

    ends_a, ends_b: ascending ends of the same text, so that the last ones agree."""
    a, b = np.ascontiguousarray(ends_a, np.int64), np.ascontiguousarray(ends_b, np.int64)
    raw_a, raw_b = a.tobytes(), b.tobytes()
    list_a, list_b = a.tolist(), b.tolist()
    out_a: list[int] = []
    out_b: list[int] = []
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if list_a[i] == list_b[j]:
            # probe: twice as far each time while all of the stretch agrees
            step = run = 1
            most = min(n - i, m - j)
            while run < most:
                step = min(step, most - run)
                low = 8 * (i + run)
                at = 8 * (j + run)
                if raw_a[low : low + 8 * step] == raw_b[at : at + 8 * step]:
                    run += step
                    step *= 2
                elif step == 1:
                    break
                else:
                    step //= 2
                    most = run + 2 * step  # they part before
            out_a.extend(range(i + 1, i + run + 1))
            out_b.extend(range(j + 1, j + run + 1))
            i += run
            j += run
            continue
        # irregular: go on at the side that is behind until both end a token
        x, y = list_a[i], list_b[j]
        while x != y:
            if x < y:
                i += 1
                x = list_a[i]
            else:
                j += 1
                y = list_b[j]
        i += 1
        j += 1
        out_a.append(i)
        out_b.append(j)
    return np.array(out_a, np.int64), np.array(out_b, np.int64)


class Pieces:
    """A sentencepiece model with byte fallback; a text is encoded with a blank in front, which the model adds."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.bytes = []
        for i, p in enumerate(pieces):
            if self.model.is_byte(i):
                self.bytes.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes.append(p.replace("▁", " ").encode())
        # units hold if no piece goes across a cut, and a line end is one token of its own
        across = re.compile(r"\n|[^▁]▁|[A-Za-z][!-&(-@\[-`{-~]|[!-&(-@\[-`{-~][A-Za-z]|[0-9][!-&(-/:-@\[-`{-~]|[!-&(-/:-@\[-`{-~][0-9]")
        line = self.model.encode("\n")
        self.cuts = len(line) == 2 and self.bytes[line[0]] == b" " and not any(across.search(p) for p in plain)
        self.head = line

    def encode(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each unit, and all ids in a row. A unit brings its own blank along: it is encoded after a
        line end, and the blank that the model adds and the line end are taken off."""
        ids = self.model.encode(["\n" + b.decode() for b in bodies], num_threads=1)
        count = np.array([len(x) - 2 for x in ids], np.int64)
        if any(x[:2] != self.head for x in ids):
            raise ValueError("a line end is no piece of its own")
        return count, np.array([i for x in ids for i in x[2:]], np.int64)

    def encode_whole(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for whole texts with a blank in front."""
        ids = self.model.encode([b[1:].decode() for b in bodies], num_threads=1)
        return np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.int64)


class Ragged:
    """Lists that are added at the end."""

    def __init__(self, kind):
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)

    def add(self, count: np.ndarray, flat: np.ndarray) -> None:
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, flat.astype(self.flat.dtype)])


class Aligner:
    """Groups and links of whole texts under two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a, special=False), Pieces(path_b)
        bytes_a = self.a.token_bytes()
        self.size_b = len(self.b.bytes)
        self.len_a = np.array([len(x) for x in bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.bytes_a = bytes_a
        self.cuts = self.a.cuts and self.b.cuts
        self.known = Known(self._learn, self._forget, CACHE)

    def _forget(self) -> None:
        self.good = np.zeros(0, bool)
        self.numbers = np.zeros((0, 4), np.int64)  # A tokens, B tokens, groups, links
        self.texts: list[bytes] = []
        self.links = Ragged(np.int64)  # pairs of a unit, as often as linked
        self.times = np.zeros(0, np.int64)

    def _learn(self, first: int, bodies: list[bytes]) -> None:
        count_a, ids_a = self.a.encode(bodies)
        count_b, ids_b = self.b.encode(bodies) if self.cuts else self.b.encode_whole(bodies)
        ids_a = ids_a.astype(np.int64)
        units = len(bodies)
        good = _same(bodies, count_a, ids_a, self.bytes_a) & _same(bodies, count_b, ids_b, self.b.bytes)
        keep_a, keep_b = np.repeat(good, count_a), np.repeat(good, count_b)
        ids_a, ids_b = ids_a[keep_a], ids_b[keep_b]
        count_a, count_b = np.where(good, count_a, 0), np.where(good, count_b, 0)
        ga, gb = align(np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b]))
        from_a, from_b = np.append(0, ga[:-1]) if len(ga) else ga, np.append(0, gb[:-1]) if len(gb) else gb
        n_a, n_b = ga - from_a, gb - from_b
        # the unit of each group, by its first A token
        unit = np.repeat(np.arange(units), count_a)[from_a]
        n_groups = np.bincount(unit, minlength=units)
        n_links = np.bincount(unit, weights=n_a * n_b, minlength=units).astype(np.int64)
        self.good = np.concatenate([self.good, good])
        self.numbers = np.concatenate([self.numbers, np.stack([count_a, count_b, n_groups, n_links], axis=1)])
        self._spell(ids_a, ids_b, n_a, n_b, n_groups)
        self._link(ids_a, ids_b, from_a, from_b, n_a, n_b, unit, units)

    def _spell(self, ids_a, ids_b, n_a, n_b, n_groups) -> None:
        words_a, words_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        i = j = 0
        spelled = []
        for x, y in zip(n_a.tolist(), n_b.tolist(), strict=True):
            if x == 1 and y == 1:
                spelled.append(f"{words_a[i]}|{words_b[j]}")
            else:
                spelled.append(f"{','.join(words_a[i : i + x])}|{','.join(words_b[j : j + y])}")
            i += x
            j += y
        at = 0
        for n in n_groups.tolist():
            self.texts.append(";".join(spelled[at : at + n]).encode())
            at += n

    def _link(self, ids_a, ids_b, from_a, from_b, n_a, n_b, unit, units) -> None:
        """All pairs of each group; those of wide groups by distinct ids, with how often each is linked."""
        wide = n_a * n_b > WIDE
        group = np.flatnonzero(~wide)
        sizes = n_a[group] * n_b[group]
        each = np.repeat(group, sizes)
        nth = tx.ragged(np.zeros(len(group), np.int64), sizes)
        pairs = ids_a[from_a[each] + nth // n_b[each]] * self.size_b + ids_b[from_b[each] + nth % n_b[each]]
        of, times = unit[each], np.ones(len(each), np.int64)
        for g in np.flatnonzero(wide).tolist():
            a, m = np.unique(ids_a[from_a[g] : from_a[g] + n_a[g]], return_counts=True)
            b, n = np.unique(ids_b[from_b[g] : from_b[g] + n_b[g]], return_counts=True)
            pairs = np.append(pairs, (a[:, None] * self.size_b + b).ravel())
            times = np.append(times, (m[:, None] * n).ravel())
            of = np.append(of, np.full(len(a) * len(b), unit[g]))
        if wide.any():
            order = np.argsort(of, kind="stable")
            pairs, times, of = pairs[order], times[order], of[order]
        self.links.add(np.bincount(of, minlength=units), pairs)
        self.times = np.concatenate([self.times, times])

    def rows(self, column: pa.Array, with_groups: bool) -> list[pa.Array]:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs, times, and the groups on request, of each text."""
        off, data = tx.buffer(column)
        # a blank in front of each text that is not empty
        size = np.diff(off)
        filled = size > 0
        gaps = off[:-1][filled]
        data = np.insert(data, gaps, 32)
        off = off + np.append(0, np.cumsum(filled))
        w = cut(off, data) if self.cuts else whole(off, data)
        number = self.known.find(w)
        bad = np.append(0, np.cumsum(~self.good[number]))
        good = bad[w.first[1:]] == bad[w.first[:-1]]
        row = w.rows()
        number, row = number[good[row]], row[good[row]]
        n = len(size)
        totals = np.stack([np.bincount(row, weights=self.numbers[number, k], minlength=n) for k in range(4)]).astype(np.int64)
        ends = np.searchsorted(row, np.arange(n + 1))
        texts = list(map(self.texts.__getitem__, number.tolist()))
        groups = [b";".join(texts[s:e]) for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        shas = [sha256(g).hexdigest() if g else "" for g in groups]
        first, count = self.links.first[number], self.links.count[number]
        at = tx.ragged(first, count)
        of = np.repeat(row, count)
        pair, times, per_row = _distinct(of, self.links.flat[at], self.times[at], n)
        offsets = pa.array(np.append(0, np.cumsum(per_row)).astype(np.int32))
        out = [pa.array(t) for t in totals] + [pa.array(shas, pa.string())]
        out += [pa.ListArray.from_arrays(offsets, pa.array(pair)), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
        return out + ([pa.array([g.decode() for g in groups], pa.string())] if with_groups else [])


def _same(bodies: list[bytes], count: np.ndarray, ids: np.ndarray, known: list[bytes]) -> np.ndarray:
    """Whether the tokens' bytes are each unit's own."""
    spelled = list(map(known.__getitem__, ids.tolist()))
    ends = np.cumsum(count).tolist()
    out, at = np.empty(len(bodies), bool), 0
    for i, (body, end) in enumerate(zip(bodies, ends, strict=True)):
        out[i] = b"".join(spelled[at:end]) == body
        at = end
    return out


def _distinct(row: np.ndarray, pair: np.ndarray, times: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct pairs in ascending order, how often each is linked, and their number per row."""
    order = np.lexsort((pair, row)) if len(pair) and int(pair.max()) >= 1 << 42 else np.argsort(row * (1 << 42) + pair)
    row, pair, times = row[order], pair[order], times[order]
    new = np.ones(len(pair), bool)
    new[1:] = (row[1:] != row[:-1]) | (pair[1:] != pair[:-1])
    at = np.flatnonzero(new)
    totals = np.add.reduceat(times, at) if len(at) else times
    return pair[at], totals, np.bincount(row[at], minlength=rows)


_aligners: dict[tuple[str, str], Aligner] = {}
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _align(path_a: str, path_b: str, with_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _aligners:
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _aligners[path_a, path_b]
        names = ["number", "doc_id", *_NUMBERS, "groups_sha256", "pairs", "times"] + ["groups"] * with_groups
        task = TaskContext.get()
        at = (task.partitionId() if task else 0) << 33
        for batch in tx.slices(batches, "text"):
            number = pa.array(np.arange(at, at + batch.num_rows, dtype=np.int64))
            at += batch.num_rows
            columns = [number, batch.column("doc_id"), *aligner.rows(batch.column("text"), with_groups)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def alignments(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """A row per document, written: number (unique), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, its distinct
    linked pairs (A id times B's vocabulary size, plus B id) and how often it links each, and on request the groups as
    `a1,a2|b1;a3|b2,b3`. path_a: a byte-level tokenizers file, path_b: a sentencepiece model, where all executors can
    read them."""
    prepared(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"number long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    schema += ", pairs array<long>, times array<int>" + ", groups string" * with_groups
    return written(rows.mapInArrow(_align(path_a, path_b, with_groups), schema), "alignments")


def pair_counts(made: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, b, n, best), written: the documents that hold each pair linked; best: n is the highest of its A id."""
    counts = made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    a = F.floor(F.col("pair") / size_b)
    counts = counts.select("pair", a.alias("a"), (F.col("pair") % size_b).alias("b"), "n")
    # an A id has at most as many pairs as B has ids
    best = F.col("n") == F.max("n").over(Window.partitionBy("a"))
    return written(counts.withColumn("best", best), "pair_counts")


#: Steps per doubling of counts by which the common pairs are told from the others.
_STEPS = 8


def _step() -> Column:
    return F.floor(F.log2("n") * _STEPS)


def common_step(counts: DataFrame, most: int) -> int:
    """The least step of counts such that at most `most` pairs are at it or above; there are some 50 times _STEPS."""
    held = sorted(((r["step"], r["count"]) for r in counts.groupBy(_step().alias("step")).count().collect()), reverse=True)
    total, least = 0, 1 << 30
    for step, count in held:
        total += count
        if total > most:
            break
        least = step
    return least


def _sums(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            flat, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), pairs.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            hit = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            n = batch.num_rows
            total = np.bincount(row[hit], weights=count[at[hit]] * often[hit], minlength=n).astype(np.int64)
            n_best = np.bincount(row[hit], weights=best[at[hit]] * often[hit], minlength=n).astype(np.int64)
            rest = np.append(0, np.cumsum(np.bincount(row[~hit], minlength=n))).astype(np.int32)
            columns = [batch.column("number"), pa.array(n_best), pa.array(total)]
            columns.append(pa.ListArray.from_arrays(pa.array(rest), pa.array(flat[~hit])))
            columns.append(pa.ListArray.from_arrays(pa.array(rest), pa.array(often[~hit].astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["number", "n_best", "count_sum", "pairs", "times"])

    return run


def scored(made: DataFrame, counts: DataFrame, common: int | None = None) -> DataFrame:
    """(number, n_best, count_sum) of each document that has pairs."""
    spark = made.sparkSession
    step = common_step(counts, COMMON if common is None else common)
    told = counts.filter(_step() >= step).select("pair", "n", "best").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(
        (told.column("pair").to_numpy(), told.column("n").to_numpy(), told.column("best").to_numpy(zero_copy_only=False))
    )
    schema = "number long, n_best long, count_sum long, pairs array<long>, times array<int>"
    sums = made.filter(F.size("pairs") > 0).select("number", "pairs", "times").mapInArrow(_sums(shared), schema)
    rare = counts.filter(_step() < step)
    if rare.isEmpty():
        return sums.drop("pairs", "times")
    sums = written(sums, "sums")
    asked = sums.select("number", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    asked = asked.select("number", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    found = asked.join(rare.select("pair", "n", "best"), "pair").groupBy("number").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("n") * F.col("times")).alias("count_sum"),
    )
    both = sums.drop("pairs", "times").unionByName(found)
    return both.groupBy("number").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def digest(docs: DataFrame, path_a: str, path_b: str, common: int | None = None) -> DataFrame:
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    made = alignments(docs, path_a, path_b)
    sums = scored(made, pair_counts(made, size_b), common)
    told = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return made.drop("pairs", "times").join(sums, "number", "left").select("doc_id", *_NUMBERS, *told, "groups_sha256")
