"""Language-model scoring with a probabilistic suffix tree over words.

The tree's symbols are the words seen at least `OWN` times in training, the end of a text, its start (as context only),
and a class for each ending of the other words. A state is the longest retained suffix of the symbols before a token, up
to `DEPTH` of them. A context is a candidate if its suffix is retained and it was seen `LEAST` times, whatever the
corpus's size, and is retained if its next-symbol counts diverge from those of its suffix state by at least `DIVERGENCE`
nats in total; each distribution is smoothed with its suffix state's by as many counts as it has distinct next symbols.
A word of a class has its share of the class: (c + 0.1) / (class count + 0.1 * (class words + 1)). The root thus agrees
with the base model, in which an unseen word counts 0.1, and states sharpen it.

The rows are written in parts of about `PART` bytes of text, as numbers of the part's distinct words. For each depth a
part asks for its distinct pairs of context and next symbol, with their training counts, a row for each bucket of the
contexts' hashes. A bucket's task sums the counts of all parts, tests its contexts, and answers each part with the counts
of the retained ones. How often a context was seen is the count of its last symbol in the state before that symbol, or at
most that if the state is shorter, so that a part has it from the answers before and asks for candidates alone. No task and not the driver holds the tree: what is gathered, asked and answered grows with the
corpus, and a context that every text has is a row per part. Broadcast are the classes and the counts of the `COMMON`
most frequent words; a part asks for its other words' counts by a join with the word table.

Words and contexts are known by 64-bit hashes. Null and empty texts have the end token alone. Null doc_ids are training
rows. Repeated rows are scored each. Without training rows all counts are 0.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.rows import KEY, keyed, written

DEPTH = 3
DIVERGENCE = 10.0
#: Training counts from which a context may be a state, and from which a word has a symbol of its own.
LEAST, OWN = 8, 20
CLASSES = 1024
COMMON = 250_000
#: Bytes of text of a part, and training tokens for each bucket of contexts.
PART, BUCKET = 4 << 20, 1_000_000
_START, _END, _FIRST_CLASS = 0, 1, 2
_FIRST_OWN = _FIRST_CLASS + CLASSES
_FLUSH = 1_500_000


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


def endings(w: tx.Words, at: np.ndarray | None = None) -> np.ndarray:
    """The class symbol of words: a hash of the last two bytes."""
    start, end = (w.start, w.end) if at is None else (w.start[at], w.end[at])
    last = w.folded[end - 1].astype(np.uint32) if len(end) else np.zeros(0, np.uint32)
    before = np.where(end - start > 1, w.folded[end - 2], 0).astype(np.uint32) if len(end) else last
    mixed = ((before << np.uint32(8)) | last) * np.uint32(2654435761)
    return (mixed >> np.uint32(16)).astype(np.int64) % CLASSES + _FIRST_CLASS


class _Distinct:
    """Distinct keys of a partition with their counts (a second value goes with the key)."""

    def __init__(self, names: list[str]):
        self.names, self.parts, self.size = names, [], 0

    def add(self, key: np.ndarray, also: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((key, also, n))
        self.size += len(key)
        if self.size > _FLUSH:
            self._merge()
            if self.size > _FLUSH // 2:
                yield from self.drain()

    def _merge(self) -> None:
        key, also, n = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        distinct, sample, each = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(each, weights=n, minlength=len(distinct)).astype(np.int64)
        self.parts, self.size = [(distinct, also[sample], total)], len(distinct)

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            self._merge()
            key, also, n = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(key)), pa.array(also), pa.array(n)], names=self.names)
        self.parts, self.size = [], 0


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in their least width, byte by byte of their values."""
    out = []
    for a in arrays:
        if a.dtype.kind in "iu" and len(a) and a.min() >= 0:
            a = a.astype(np.min_scalar_type(a.max()))
        raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
        body = pa.compress(raw, codec="zstd", asbytes=True)
        out.append(struct.pack("<cII", a.dtype.char.encode(), len(raw), len(body)) + body)
    return b"".join(out)


def _unpack(body: bytes) -> list[np.ndarray]:
    """Whole numbers come back signed; those of 64 bits without a sign stay."""
    out, at = [], 0
    while at < len(body):
        char, size, n = struct.unpack_from("<cII", body, at)
        at += 9
        kind = np.dtype(char.decode())
        raw = pa.decompress(body[at : at + n], decompressed_size=size, codec="zstd", asbytes=True)
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
        out.append(a.astype(np.int64) if kind.kind in "iu" and kind.char not in "LQ" else a)
        at += n
    return out


#: What a row of a part holds, if not the answers of a depth.
_TEXT, _HASHES, _WORDS = -1, -2, 0
_ROWS = "part long, depth int, bucket int, body binary"


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    names = ["part", "depth", "bucket", "body"]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows per part: keys, whether each row trains, words of each row and their numbers; hashes and classes of the
    numbered words."""

    def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        w = tx.words(*tx.buffer(rows.column("text")), tx.LOWER_WORDS)
        distinct, sample, index = np.unique(tx.hashes(w), return_index=True, return_inverse=True)
        train = ~rows.column("held_out").to_numpy()
        part = int.from_bytes(os.urandom(8), "little") >> 1
        body = _pack(rows.column("key").to_numpy(), train, w.counts, index)
        n = np.bincount(index, weights=np.repeat(train, w.counts), minlength=len(distinct)).astype(np.int64)
        known = _pack(distinct, endings(w, sample), n)
        yield from _table([(part, _TEXT, 0, body), (part, _HASHES, 0, known)]).to_batches()

    held, size = [], 0
    for batch in tx.slices(batches, "text"):
        held.append(batch)
        size += tx.buffer(batch.column("text"))[0][-1]
        if size >= PART:
            yield from made(held)
            held, size = [], 0
    if held:
        yield from made(held)


def parts(rows: DataFrame) -> DataFrame:
    """rows: key, held_out, text."""
    return written(rows.select("key", "held_out", "text").mapInArrow(_parts, _ROWS), "lm_parts")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = _Distinct(["h", "class", "n"])
    for batch in batches:
        for body in batch.column("body").to_pylist():
            distinct, classes, n = _unpack(body)
            yield from seen.add(distinct[n > 0].astype(np.uint64), classes[n > 0], n[n > 0])
    yield from seen.drain()


def vocabulary(rows: DataFrame) -> DataFrame:
    """(h, class, n, number): the distinct training words by hash, with class, count and a number of their own."""
    made = rows.filter(F.col("depth") == _HASHES).mapInArrow(_count_words, "h long, class long, n long")
    made = made.groupBy("h", "class").agg(F.sum("n").alias("n"))
    return _written(made.withColumn("number", F.monotonically_increasing_id()), "lm_words")


@dataclass
class Words:
    """What all tasks know: frequent words by sorted hash, with count and symbol; the log10 of the classes' and the
    end's weight, and of the sum of all weights; the training count from which a context is a candidate."""

    known: np.ndarray
    count: np.ndarray
    symbol: np.ndarray
    classes: np.ndarray
    end: float
    all: float
    least: int = 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.known, h), max(0, len(self.known) - 1))
        return at, self.known[at] == h if len(self.known) else np.zeros(len(h), bool)


def _unknown(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body").to_pylist(), strict=True):
                h = _unpack(body)[0].astype(np.uint64)
                h = h[~shared.value.find(h)[1]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), part)), pa.array(tx.signed(h))], names=["part", "h"])

    return run


def _rare(rows: pa.Table) -> pa.Table:
    h = rows.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    body = _pack(h[order], rows.column("n").to_numpy()[order], rows.column("number").to_numpy()[order])
    return _table([(rows.column("part")[0].as_py(), _WORDS, 0, body)])


def _told(shared, own: int, first: int):
    """Training count and symbol of a part's words."""

    def run(rows: pa.Table) -> pa.Table:
        got = dict(zip(rows.column("depth").to_pylist(), rows.column("body").to_pylist(), strict=True))
        h, classes, _ = _unpack(got[_HASHES])
        h, symbol = h.astype(np.uint64), np.zeros(len(h), np.int64)
        n = np.zeros(len(h), shared.value.count.dtype)
        at, hit = shared.value.find(h)
        n[hit], symbol[hit] = shared.value.count[at[hit]], shared.value.symbol[at[hit]]
        if _WORDS in got:
            known, count, number = _unpack(got[_WORDS])
            at = np.searchsorted(h, known.astype(np.uint64))
            n[at], symbol[at] = count, np.where(count >= own, number + first, 0)
        body = _pack(n, np.where(symbol > 0, symbol, classes))
        return _table([(rows.column("part")[0].as_py(), _WORDS, 0, body)])

    return run


def _words(made: DataFrame, vocab: DataFrame | None, shared) -> list[DataFrame]:
    """The parts' texts and words. vocab: where to find the words that are not broadcast, if there are any."""
    hashes = made.filter(F.col("depth") == _HASHES)
    asked = hashes
    if vocab is not None:
        rare = hashes.mapInArrow(_unknown(shared), "part long, h long").join(vocab.select("h", "n", "number"), "h")
        asked = hashes.unionByName(rare.groupBy("part").applyInArrow(lambda t: _rare(t), _ROWS))
    told = asked.groupBy("part").applyInArrow(_told(shared, OWN, _FIRST_OWN + COMMON), _ROWS)
    return [made.filter(F.col("depth") == _TEXT), _written(told, "lm_told")]


def _name(before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The hash of a context, from its suffix's and its first symbol."""
    return tx.mix(before * np.uint64(0x9E3779B97F4A7C15) + (symbol.astype(np.uint64) + np.uint64(1)) * tx._PLACES[0])


class _Walk:
    """The symbols of a part between start and end of each row, and the log10 probability of each in the longest state
    that has been answered; `down` goes to the contexts that are longer by one symbol."""

    def __init__(self, text: bytes, told: bytes, words: Words, buckets: int):
        self.keys, self.train, self.counts, self.index = _unpack(text)
        self.n, symbol = _unpack(told)
        self.in_class = symbol < _FIRST_OWN
        self.class_weight = np.where(self.in_class, words.classes[np.where(self.in_class, symbol, _FIRST_CLASS) - _FIRST_CLASS], 0.0)
        root = np.where(self.in_class, self.class_weight, np.log10(self.n + 0.1)) - words.all
        self.symbols, sample, local = np.unique(np.append([_START, _END], symbol), return_index=True, return_inverse=True)
        root = np.append([0.0, words.end - words.all], root)[sample]
        rows = len(self.counts)
        self.loc = np.ones(len(self.index) + 2 * rows, np.int64)
        self.first = np.cumsum(self.counts + 2) - self.counts - 2
        self.loc[self.first] = 0
        self.loc[tx.ragged(self.first + 1, self.counts)] = local[2:][self.index]
        self.place = tx.ragged(np.zeros(rows, np.int64), self.counts + 2)
        self.trains = np.repeat(self.train, self.counts + 2)
        self.log10 = root[self.loc]
        self.buckets, self.depth = buckets, 0
        # the training count of each symbol with the state before it, at least that of any longer context that ends in it
        self.least, self.most = words.least, np.full(len(self.loc), np.inf)
        self.at, self.context, self.names = np.flatnonzero(self.place > 0), None, None

    def down(self) -> None:
        self.depth += 1
        size = len(self.symbols)
        if self.context is not None:
            often = self.most[self.at - 1] >= self.least
            self.at, self.context = self.at[often], self.context[often]
        back = self.loc[self.at - self.depth]
        if self.context is None:
            self.context, self.names = back, _name(np.zeros(size, np.uint64), self.symbols)
            self.spelled = [self.symbols]
        else:
            key, self.context = np.unique(self.context * size + back, return_inverse=True)
            self.names = _name(self.names[key // size], self.symbols[key % size])
            self.spelled = [*(s[key // size] for s in self.spelled), self.symbols[key % size]]
        pair, self.sample, self.pair = np.unique(
            self.context * size + self.loc[self.at], return_index=True, return_inverse=True
        )
        self.of, self.next = pair // size, pair % size
        # contexts and pairs by bucket
        bucket = (self.names % np.uint64(self.buckets)).astype(np.int64)
        self.contexts = np.argsort(bucket, kind="stable")
        self.pairs = np.argsort(bucket[self.of], kind="stable")
        cuts = np.arange(self.buckets + 1)
        self.context_cuts = np.searchsorted(bucket[self.contexts], cuts).tolist()
        self.pair_cuts = np.searchsorted(bucket[self.of][self.pairs], cuts).tolist()

    def asked(self) -> Iterator[tuple[int, bytes]]:
        """For each bucket: contexts, the ln of the training symbols' chances in the state so far, pairs, next symbols
        and training counts."""
        n = np.bincount(self.pair, weights=self.trains[self.at], minlength=len(self.of)).astype(np.int64)
        logs = np.bincount(self.of, weights=n * self.log10[self.at][self.sample] * np.log(10), minlength=len(self.names))
        sizes = np.bincount(self.of, minlength=len(self.names))
        for b in range(self.buckets):
            c = self.contexts[self.context_cuts[b] : self.context_cuts[b + 1]]
            p = self.pairs[self.pair_cuts[b] : self.pair_cuts[b + 1]]
            c = c[sizes[c] > 0]
            if len(c):
                spelled = (s[c] for s in self.spelled)
                yield b, _pack(logs[c].astype(np.float32), sizes[c], self.symbols[self.next[p]], n[p], *spelled)

    def answered(self, answers: list[tuple[int, bytes]]) -> None:
        asked = np.bincount(self.of, minlength=len(self.names)) > 0
        kept, sums, kinds = np.zeros(len(self.names), bool), np.zeros(len(self.names)), np.zeros(len(self.names))
        n = np.zeros(len(self.of))
        for b, body in answers:
            flags, own_sums, own_kinds, own_n = _unpack(body)
            c = self.contexts[self.context_cuts[b] : self.context_cuts[b + 1]]
            c = c[asked[c]]
            c = c[np.unpackbits(flags.astype(np.uint8), count=len(c)) > 0]
            kept[c], sums[c], kinds[c] = True, own_sums, own_kinds
            p = self.pairs[self.pair_cuts[b] : self.pair_cuts[b + 1]]
            n[p[kept[self.of[p]]]] = own_n
        live = kept[self.context]
        self.at, self.context, pair = self.at[live], self.context[live], self.pair[live]
        sums, kinds = sums[self.context], kinds[self.context]
        self.most[self.at] = n[pair]
        self.log10[self.at] = np.log10((n[pair] + kinds * 10.0 ** self.log10[self.at]) / (sums + kinds))
        more = self.place[self.at] > self.depth
        self.at, self.context = self.at[more], self.context[more]


def _ask(shared, buckets: int, depth: int):
    def run(rows: pa.Table) -> pa.Table:
        walk = _answered(rows, shared, buckets, depth - 1)
        walk.down()
        part = rows.column("part")[0].as_py()
        return _table([(part, depth, b, body) for b, body in walk.asked()])

    return run


def _answered(rows: pa.Table, shared, buckets: int, depth: int) -> _Walk:
    """A part with the answers up to a depth."""
    given: dict[int, list[tuple[int, bytes]]] = {}
    for d, bucket, body in zip(*(rows.column(c).to_pylist() for c in ("depth", "bucket", "body")), strict=True):
        given.setdefault(d, []).append((bucket, body))
    walk = _Walk(given[_TEXT][0][1], given[_WORDS][0][1], shared.value, buckets)
    for d in range(1, depth + 1):
        walk.down()
        walk.answered(given.get(d, []))
    return walk


def _settle(depth: int, least: int, divergence: float, states: bool):
    """From what all parts ask of a bucket to the answers: flags of the contexts retained, their sums and kinds of next
    symbols, and the counts of their pairs. states: the retained contexts themselves instead."""

    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        asked = [_unpack(x) for x in rows.column("body").to_pylist()]
        logs, sizes, symbol, n, *spelled = (np.concatenate(x) for x in zip(*asked, strict=True))
        context = np.zeros(len(sizes), np.uint64)
        for s in spelled:
            context = _name(context, s)
        distinct, owner = np.unique(context, return_inverse=True)
        of_pair = np.repeat(owner, sizes.astype(np.int64))
        codes, code = None, symbol.astype(np.int64)
        wide = int(code.max()) + 1
        if wide > 1 << 32:
            codes, code = np.unique(code, return_inverse=True)
            wide = len(codes)
        pair, each = np.unique(of_pair * wide + code, return_inverse=True)
        total = np.bincount(each, weights=n)
        of = pair // wide
        seen = total > 0
        sums = np.bincount(of, weights=total, minlength=len(distinct))
        kinds = np.bincount(of[seen], minlength=len(distinct))
        gain = np.bincount(of[seen], weights=total[seen] * np.log(total[seen] / sums[of[seen]]), minlength=len(distinct))
        kept = (sums >= least) & (gain - np.bincount(owner, weights=logs, minlength=len(distinct)) >= divergence)
        sums = sums.astype(np.int64)
        if states:
            live = kept[of] & seen
            next_ = (pair % wide if codes is None else codes[pair % wide])[live]
            body = _pack(distinct[kept], sums[kept], kinds[kept], (np.cumsum(kept) - 1)[of[live]], next_, total[live])
            return _table([(-1, depth, bucket, body)])
        total = total.astype(np.int64)
        out, c, p = [], 0, 0
        for part, own in zip(rows.column("part").to_pylist(), asked, strict=True):
            mine, pairs = owner[c : c + len(own[1])], slice(p, p + len(own[3]))
            c, p = c + len(own[1]), p + len(own[3])
            flags = kept[mine]
            if flags.any():
                mine = mine[flags]
                counts = total[each[pairs]][kept[of_pair[pairs]]]
                out.append((part, depth, bucket, _pack(np.packbits(flags), sums[mine], kinds[mine], counts)))
        return _table(out)

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written, with the shuffles behind it removed at once."""
    conf, clean = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(clean)
    conf.set(clean, "true")
    try:
        return written(df, name)
    finally:
        conf.set(clean, before)


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _asks(tables: list[DataFrame], shared, buckets: int, depth: int) -> DataFrame:
    return _together(tables).groupBy("part").applyInArrow(_ask(shared, buckets, depth), _ROWS)


def _settled(asks: DataFrame, depth: int, states: bool = False) -> DataFrame:
    answers = asks.groupBy("bucket").applyInArrow(_settle(depth, LEAST, DIVERGENCE, states), _ROWS)
    return _written(answers, f"lm_states_{depth}")


@dataclass
class Tree:
    """The retained states of a small corpus in memory: what parts are answered, to be looked at as a whole."""

    own: np.ndarray  # sorted hashes of words with a symbol of their own
    root: np.ndarray  # log10 probability of each symbol
    # of each depth: contexts by hash, sums and kinds of next symbols, (context, symbol) and its count
    contexts: list[np.ndarray] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)
    kinds: list[np.ndarray] = field(default_factory=list)
    pairs: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    @property
    def size(self) -> int:
        return len(self.root)

    def log10(self, sym: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each symbol at its place; 0 for starts."""
        out = np.where(place > 0, self.root[sym], 0.0)
        at = np.flatnonzero(place > 0)
        name = np.zeros(len(at), np.uint64)
        for i, contexts in enumerate(self.contexts):
            more = place[at] > i
            at, name = at[more], name[more]
            name = _name(name, sym[at - i - 1])
            if not len(contexts) or not len(at):
                break
            where = np.minimum(np.searchsorted(contexts, name), len(contexts) - 1)
            hit = contexts[where] == name
            at, name, where = at[hit], name[hit], where[hit]
            pair = where * self.size + sym[at]
            near = np.minimum(np.searchsorted(self.pairs[i], pair), len(self.pairs[i]) - 1)
            n = np.where(self.pairs[i][near] == pair, self.counts[i][near], 0.0)
            kinds = self.kinds[i][where]
            out[at] = np.log10((n + kinds * 10.0 ** out[at]) / (self.sums[i][where] + kinds))
        return out


def grow(train: DataFrame, tree: Tree, total: int, depth: int = DEPTH) -> Tree:
    """Adds the retained contexts of each depth, for trees that fit the driver. train: text."""
    rows = train.select(F.monotonically_increasing_id().alias("key"), F.lit(False).alias("held_out"), "text")
    root = 10.0**tree.root
    symbol = np.arange(len(tree.own)) + _FIRST_OWN
    words = Words(tree.own, root[_FIRST_OWN:] - 0.1, symbol, tree.root[_FIRST_CLASS:_FIRST_OWN], tree.root[_END], 0.0, LEAST)
    shared = train.sparkSession.sparkContext.broadcast(words)
    tables, buckets = _words(parts(rows), None, shared), max(64, total // BUCKET)
    for d in range(1, depth + 1):
        asks = _asks(tables, shared, buckets, d)
        got = [_unpack(x) for x in _settled(asks, d, True).toArrow().column("body").to_pylist()]
        name, sums, kinds, owner, symbol, n = (
            [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 6
        )
        name = name.astype(np.uint64)
        firsts = np.cumsum([0, *(len(x[0]) for x in got)])[:-1]
        owner = owner + np.repeat(firsts, [len(x[3]) for x in got]) if got else owner
        order = np.argsort(name)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        pair = rank[owner] * tree.size + symbol
        by = np.argsort(pair)
        tree.contexts.append(name[order])
        tree.sums.append(sums[order])
        tree.kinds.append(kinds[order])
        tree.pairs.append(pair[by])
        tree.counts.append(n[by])
        if d < depth:
            tables.append(_settled(asks, d))
    return tree


def _sum(shared, buckets: int, depth: int):
    def run(rows: pa.Table) -> pa.Table:
        walk = _answered(rows, shared, buckets, depth)
        logs = np.log10(walk.n + 0.1)
        row = np.repeat(np.arange(len(walk.counts)), walk.counts)
        in_class = np.where(walk.in_class, logs - walk.class_weight, 0.0)
        size = len(walk.counts)
        walk.log10[walk.first] = 0.0
        each = lambda values: np.bincount(row, weights=values[walk.index], minlength=size)
        columns = {
            "key": pa.array(walk.keys),
            "words": pa.array(walk.counts),
            "known": pa.array(each(walk.n > 0).astype(np.int64)),
            "logs": pa.array(each(logs)),
            "chance": pa.array(np.add.reduceat(walk.log10, walk.first) + each(in_class)),
        }
        return pa.table(columns)

    return run


def _frequent(vocab: DataFrame, most: int) -> DataFrame:
    """The words at or above the least count step that at most `most` words reach."""
    step = F.floor(F.log2("n") * 16)
    reached, least = 0, 1 << 30
    for row in vocab.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        reached += row["count"]
        if reached > most:
            break
        least = row["step"]
    return vocab.filter(step >= least)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, id, held_out, n_tokens, n_known, train_tokens, base_score, score)."""
    rows = keyed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id")
    rows = rows.withColumn("held_out", held_out("id"))
    sc = rows.sparkSession.sparkContext
    made = parts(rows.select(F.col(KEY).alias("key"), "held_out", "text"))
    vocab, ends = vocabulary(made), rows.filter("NOT held_out").count()
    words, kinds = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, kinds = words + ends, kinds + (ends > 0)
    floor = total + 0.1 * (kinds + 1)

    # words without a symbol of their own make up the classes
    class_n, class_kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for c, s, k in vocab.filter(F.col("n") < OWN).groupBy("class").agg(F.sum("n"), F.count("*")).collect():
        class_n[c - _FIRST_CLASS], class_kinds[c - _FIRST_CLASS] = s, k
    class_weight = class_n + 0.1 * (class_kinds + 1)
    own_n = vocab.filter(F.col("n") >= OWN).agg(F.coalesce(F.sum(F.col("n") + 0.1), F.lit(0.0))).first()[0]
    whole = ends + 0.1 + class_weight.sum() + float(own_n)

    got = _frequent(vocab, COMMON).select("h", "n").toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    symbol = np.zeros(len(h), np.int64)
    ranked = np.lexsort((h, -n))
    symbol[ranked] = np.arange(len(h)) + _FIRST_OWN
    symbol[n < OWN] = 0
    order = np.argsort(h)
    shared = sc.broadcast(
        Words(h[order], n[order], symbol[order], np.log10(class_weight), float(np.log10(ends + 0.1)), float(np.log10(whole)), LEAST)
    )
    tables, buckets = _words(made, vocab, shared), max(64, total // BUCKET)
    for d in range(1, DEPTH + 1):
        tables.append(_settled(_asks(tables, shared, buckets, d), d))
    summed = _together(tables).groupBy("part").applyInArrow(
        _sum(shared, buckets, DEPTH), "key long, words long, known long, logs double, chance double"
    )
    n_tokens = F.col("words") + 1
    out = summed.join(rows.select(F.col(KEY).alias("key"), "id", "held_out"), "key")
    return out.select(
        "key",
        "id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(ends + 0.1)) - n_tokens * float(np.log10(floor))).alias("base_score"),
        F.col("chance").alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    got = score(docs)
    columns = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return got.select(F.col("id").alias("doc_id"), *columns)
