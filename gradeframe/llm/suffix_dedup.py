"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of enhanced suffix arrays.

A byte string of at least `SPAN` bytes that occurs in several documents is found in the shard of its anchor: the least of
the hashed `GRAM`-byte strings inside each window of SPAN bytes, a function of the window's bytes alone. The windows of one
anchor cover a piece of text. A first pass finds the anchors that repeat, and those that repeat with different pieces
(filters of bounded size). A second settles pieces that the same task saw in a smaller document, and deals the rest to
shards by the anchor's name: as a hash where all pieces of an anchor are equal, so that equality is all that matters,
with their bytes where they differ. Anchors that occur very often are dealt window by window instead, by the window's own
bytes, so that a passage or line that a third of all documents share is spread out and each of its windows is a row per
task; their pieces are reduced to distinct ones before. What a task sends is a row for `TOGETHER` shards, as the number
of such rows grows with the tasks and the shards.

A shard joins its distinct pieces to one text, sorts the suffixes of its stretches of repeated windows (no other can be in
a repeat), and computes the common prefix of neighbours. A stack
scan over the array yields the intervals of its common-prefix tree with at least SPAN bytes; those whose occurrences
differ in the byte before (or start a piece) are maximal repeat groups, with all their occurrences. In each group the
bytes of every occurrence in a document larger than the group's smallest are covered. Any repeated string lies in a
maximal one, so the union of these ranges is exactly the bytes that a repeat from a smaller document covers.

Null and empty texts have no bytes. Rows of equal doc_id are separate documents in the order of a hash of their texts,
null doc_ids first. Repeats inside one document count only where a smaller document has the string, too. Texts shorter
than SPAN keep all their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.repeats import Filter, repeated, total_bytes
from gradeframe.llm.rows import KEY, keyed
from gradeframe.llm.suffixes import suffix_array

SPAN, GRAM = 50, 20
HOT = 2000
#: Bytes of a text that are worked on at once (arrays of that length stay in a core's cache), and of text in all for each
#: shard; shards that are sent together.
SEGMENT, SHARD, TOGETHER = 1 << 16, 2 << 20, 8
_FLUSH = 400_000
#: Of the filter of repeated anchors.
MOST_BITS = 1 << 29
_NO_BYTE, _MANY = 256, 257
_LENGTH_BITS = 24
_PLACE = np.uint64((1 << 24) - 1)


def segments(off: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, bytes, row of each window start or -1): together the segments have every window once.

    A text is cut at its own multiples of SEGMENT only, whatever texts lie before it, so that its pieces are the same in
    every pass."""
    first, rows = 0, len(off) - 1
    while first < rows:
        # texts that fit a segment together, or one text
        to = min(rows, max(first + 1, int(np.searchsorted(off, off[first] + SEGMENT, "right")) - 1))
        begin, end = int(off[first]), int(off[to])
        for at in range(begin, end, SEGMENT):
            part = data[at : min(at + SEGMENT + SPAN - 1, end)]
            n = len(part) - SPAN + 1
            if n <= 0:
                continue
            if to == first + 1:
                yield at, part, np.full(n, first, np.int32)
                continue
            # the places in a text where windows begin, then those too close to its end
            sizes = np.diff(off[first : to + 1])
            starts = np.maximum(sizes - SPAN + 1, 0)
            row = np.full((to - first, 2), -1, np.int32)
            row[:, 0] = np.arange(first, to)
            yield at, part, np.repeat(row.ravel(), np.stack([starts, sizes - starts], 1).ravel())[:n]
        first = to


def anchors(part: np.ndarray, sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the n windows of a segment: its anchor's place; and the grams' hashes before they are mixed."""
    gram = tx.window_terms(sums, GRAM)
    # the hash's leading bits, then the place: the least is the leftmost of the least
    least = gram & ~_PLACE
    least |= np.arange(len(gram), dtype=np.uint64)
    width = 1
    wanted = SPAN - GRAM + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = wanted - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return (least[:n] & _PLACE).view(np.int64), gram


def _groups(place: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First windows and counts of runs of windows of one row with one anchor."""
    change = np.append(True, (place[1:] != place[:-1]) | (row[1:] != row[:-1]))
    heads = np.flatnonzero(change)
    counts = np.diff(np.append(heads, len(row)))
    ok = row[heads] >= 0
    return heads[ok], counts[ok]


def _found(part: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of a segment's bytes; first windows, numbers of windows, anchor's places and anchor's names of its pieces."""
    sums = tx.byte_sums(part)
    place, gram = anchors(part, sums, len(row))
    heads, counts = _groups(place, row)
    place = place[heads]
    return sums, heads, counts, place, tx.mix(gram[place] + np.uint64(GRAM))


def _names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    names, values = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for _, part, row in segments(*tx.buffer(batch.column("text"))):
        sums, heads, counts, place, name = _found(part, row)
        names.append(name)
        values.append(_piece_hashes(sums, heads, heads + counts + SPAN - 1, place))
    return np.concatenate(names), np.concatenate(values)


def _piece_hashes(sums: np.ndarray, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Of the bytes and of the anchor's place in them."""
    return tx.mix(tx.range_hashes(sums, low, high) + (place - low).astype(np.uint64))


def merged(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each key, joined where they touch."""
    if not len(key):
        return key, low, high
    order = np.lexsort((low, key))
    key, low, high = key[order], low[order], high[order]
    # reach of the ranges before, with keys set apart
    number = np.cumsum(np.append(0, key[1:] != key[:-1]))
    wide = int(high.max()) + 1
    reach = np.maximum.accumulate(high + number * wide)
    head = np.append(True, low[1:] + number[1:] * wide > reach[:-1])
    ends = np.append(np.flatnonzero(head)[1:], len(key)) - 1
    return key[head], low[head], reach[ends] - number[ends] * wide


def _packed(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """One list of ranges a key, each range as one number: first byte and length."""
    key, low, high = merged(key, low, high)
    parts = []
    most = (1 << _LENGTH_BITS) - 1
    while len(key):  # ranges too long for the length's bits are cut
        cut = np.minimum(high, low + most)
        parts.append((key, low, cut))
        more = high > cut
        key, low, high = key[more], cut[more], high[more]
    if not parts:
        return np.zeros(0, np.int64), pa.array([], pa.list_(pa.int64()))
    key, low, high = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(key, kind="stable")
    key, low, high = key[order], low[order], high[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    values = (low << _LENGTH_BITS) | (high - low)
    return key[heads], pa.ListArray.from_arrays(np.append(heads, len(key)).astype(np.int32), pa.array(values))


_PIECES = pa.schema(
    [
        ("value", pa.uint64()),  # of the piece
        ("own", pa.uint8()),  # which of the shards that are sent together
        ("key", pa.int64()),
        ("starts", pa.list_(pa.int64())),
        ("size", pa.int32()),
        ("body", pa.binary()),  # null where the piece's hash is all that matters
    ]
)
_SENT = "shards int, pieces binary, key long, settled array<long>"
_CODEC = pa.ipc.IpcWriteOptions(compression="zstd")
#: What is sent of a piece: its hash, its bytes too, or its windows' hashes.
_HASH, _BODY, _WINDOWS = 0, 1, 2


def _stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_CODEC) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _classes(value: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order by value, the first of each value's rows in it, the number of each row's value, each value's least key."""
    order = np.argsort(value)
    head = np.append(True, value[order[1:]] != value[order[:-1]])
    heads = np.flatnonzero(head)
    return order, heads, np.cumsum(head) - 1, np.minimum.reduceat(key[order], heads)


class _Held:
    """Pieces of a task until they are sent, a row for shards that lie together; of equal ones the smallest document's."""

    def __init__(self, shards: int):
        self.shards, self.parts, self.size = shards, [], 0

    def add(self, part, value, name, key, start, low, high, kind) -> None:
        sizes = high - low
        whole = kind > _HASH
        body = part[tx.ragged(low[whole], sizes[whole])]
        self.parts.append((value, name, key, start, sizes, kind, body))
        self.size += len(value)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        value, name, key, start, sizes, kind, body = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        held = np.where(kind > _HASH, sizes, 0)
        first = np.where(kind > _HASH, np.cumsum(held) - held, -1)
        row, least, counts, starts, later = self._settled(value, key, start, sizes)
        yield from later
        windows = kind[row] == _WINDOWS
        of = np.repeat(windows, counts)
        at = row[~windows]
        yield self._dealt(value[at], name[at], least[~windows], counts[~windows], starts[~of], sizes[at], first[at], body)
        at = np.repeat(row, counts)[of]
        yield from self._windows(name[at], np.repeat(least, counts)[of], starts[of], sizes[at], first[at], body)

    def _settled(self, value, key, start, sizes) -> tuple:
        """A row of each value, its least key, and how many and which places it has there; the other places' ranges, which
        are covered."""
        order, heads, number, least = _classes(value, key)
        own = key[order] == least[number]
        later = order[~own]
        counts = np.bincount(number[own], minlength=len(heads))
        return order[heads], least, counts, start[order[own]], self._ranges(key[later], start[later], start[later] + sizes[later])

    def _ranges(self, key, low, high) -> Iterator[pa.RecordBatch]:
        keys, ranges = _packed(key, low, high)
        if len(keys):
            own = (tx.mix(keys.astype(np.uint64)) % np.uint64(self.shards)).astype(np.int32) // TOGETHER
            columns = [pa.array(own), pa.nulls(len(keys), pa.binary()), pa.array(keys), ranges]
            yield pa.RecordBatch.from_arrays(columns, names=["shards", "pieces", "key", "settled"])

    def _windows(self, name, key, start, sizes, first, body) -> Iterator[pa.RecordBatch]:
        """The windows of pieces by their hashes, anchor by anchor."""
        order = np.argsort(name, kind="stable")
        for a in range(0, len(order), _FLUSH // SPAN):
            some = order[a : a + _FLUSH // SPAN]
            sums = tx.byte_sums(body[tx.ragged(first[some], sizes[some])])
            counts = sizes[some] - SPAN + 1
            low = tx.ragged(np.cumsum(sizes[some]) - sizes[some], counts)
            value = _piece_hashes(sums, low, low + SPAN, low)
            spans = np.full(len(low), SPAN)
            row, least, n, starts, later = self._settled(value, np.repeat(key[some], counts), tx.ragged(start[some], counts), spans)
            yield from later
            yield self._dealt(value[row], value[row], least, n, starts, spans[row], None, body)

    def _dealt(self, value, deal, key, counts, starts, sizes, first, body) -> pa.RecordBatch:
        """Distinct pieces, a row for shards that lie together. starts: the places of all one after the other; first: of
        the bytes in `body`, none going along without it."""
        shard = (deal % np.uint64(self.shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        shard = shard[order]
        starts = starts[tx.ragged((np.cumsum(counts) - counts)[order], counts[order])]
        columns = [
            pa.array(value[order]),
            pa.array((shard % TOGETHER).astype(np.uint8)),
            pa.array(key[order]),
            pa.ListArray.from_arrays(np.append(0, np.cumsum(counts[order])).astype(np.int32), pa.array(starts)),
            pa.array(sizes[order].astype(np.int32)),
            pa.nulls(len(order), pa.binary()) if first is None else _bodies(first[order], sizes[order], body),
        ]
        rows = pa.RecordBatch.from_arrays(columns, schema=_PIECES)
        own = shard // TOGETHER
        heads = np.flatnonzero(np.append(own[:1] >= 0, own[1:] != own[:-1]))
        cuts = np.append(heads, len(own)).tolist()
        sent = [_stream(rows.slice(a, b - a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        n = len(sent)
        return pa.RecordBatch.from_arrays(
            [pa.array(own[heads]), pa.array(sent, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64()))],
            names=["shards", "pieces", "key", "settled"],
        )


def _bodies(first: np.ndarray, sizes: np.ndarray, body: np.ndarray) -> pa.Array:
    """The pieces' bytes, null where they have no first byte."""
    held = np.where(first >= 0, sizes, 0)
    ends = np.append(0, np.cumsum(held)).astype(np.int32)
    out = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(body[tx.ragged(first, held)])])
    return pc.if_else(pa.array(first >= 0), out, pa.scalar(None, pa.binary()))


def _pieces(shared, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Filter = shared.value
        held = _Held(shards)
        for batch in tx.slices(batches, "text"):
            off, data = tx.buffer(batch.column("text"))
            keys = batch.column("key").to_numpy()
            for at, part, row in segments(off, data):
                sums, heads, counts, place, name = _found(part, row)
                taken = np.flatnonzero(known.reaches(name))
                if not len(taken):
                    continue
                low, counts, name = heads[taken], counts[taken], name[taken]
                kind = np.full(len(taken), _HASH, np.int8)
                differ = np.flatnonzero(known.reaches(name, 1))
                kind[differ] = np.where(known.reaches(name[differ], 2), _WINDOWS, _BODY)
                high = low + counts + SPAN - 1
                value = _piece_hashes(sums, low, high, place[taken])
                held.add(part, value, name, keys[row[low]], low + at - off[row[low]], low, high, kind)
            if held.size > _FLUSH:
                yield from held.flush()
        yield from held.flush()

    return run


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, `least` being known; ends at zeros."""
    out = np.full(len(a), least, np.int64)
    live, a, b = np.arange(len(a)), a + least, b + least
    while len(live):
        same = (text[a] == text[b]) & (text[a] != 0)
        live, a, b = live[same], a[same] + 1, b[same] + 1
        out[live] += 1
    return out


def intervals(prefix: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix tree's intervals of at least `least`, by a scan with a stack."""
    stack: list[tuple[int, int]] = []  # length, first
    for i, length in enumerate([*prefix[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][0] > length:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, first))


def _hashed(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Where `least` symbols without a 0 begin, and their hashes."""
    sums = tx.byte_sums((text & 255).astype(np.uint8))
    gap = np.append(0, np.cumsum(text == 0))
    n = max(0, len(text) - least + 1)
    low = np.flatnonzero(gap[least:] == gap[:n])
    return low, tx.range_hashes(sums, low, low + least)


def _stretches(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's stretches of repeated windows, each with the place after it, and whether they are inside: a
    repeat has repeated windows only, so that all repeats lie in these."""
    low, value = _hashed(text, least)
    order = np.argsort(value)
    same = value[order[1:]] == value[order[:-1]]
    low = low[order[np.append(False, same) | np.append(same, False)]] if len(low) else low
    edge = np.bincount(low, minlength=len(text) + 1) - np.bincount(low + least, minlength=len(text) + 1)
    inside = np.cumsum(edge) > 0
    at = np.flatnonzero(inside | np.append(False, inside[:-1]))
    return at, inside[at]


def maximal_repeats(text: np.ndarray, before: np.ndarray, least: int = SPAN) -> tuple[np.ndarray, ...]:
    """(lengths, counts, places): the repeats in a text of parts that end with 0, the places of all one after the other.

    `before`: the symbol left of each place, _NO_BYTE or _MANY where it is not one symbol; a repeat counts if its places
    do not all follow the same symbol."""
    at, inside = _stretches(text, least)
    text, before = np.where(inside, text[at], 0).astype(text.dtype), before[at]
    order = suffix_array(text, by_place=False)
    # suffixes that share `least` symbols with a neighbour; each run of them is one subtree
    fits, value = np.zeros(len(text), bool), np.zeros(len(text), np.uint64)
    low, hashed = _hashed(text, least)
    fits[low], value[low] = True, hashed
    joined = np.zeros(len(order) + 1, bool)
    joined[1:-1] = fits[order[1:]] & fits[order[:-1]] & (value[order[1:]] == value[order[:-1]])
    heads = np.flatnonzero(~joined[:-1] & joined[1:])
    tails = np.flatnonzero(joined[:-1] & ~joined[1:])
    # left-extension: a run whose suffixes all follow one symbol is part of a repeat further left
    left = before[order]
    differs = np.concatenate([[0], np.cumsum(np.append(False, left[1:] != left[:-1]) | (left >= _NO_BYTE))])
    diverse = (differs[tails + 1] - differs[heads + 1] > 0) | (left[heads] >= _NO_BYTE)
    heads, sizes = heads[diverse], (tails - heads + 1)[diverse]
    second = tx.ragged(heads + 1, sizes - 1)
    prefix = np.zeros(len(order), np.int64)
    prefix[second] = common_prefixes(text, order[second - 1], order[second], least)
    # a run of two is one interval; the tree of a larger one comes from the scan
    two = heads[sizes == 2]
    lengths, counts, places = [prefix[two + 1]], [np.full(len(two), 2)], [order[tx.ragged(two, np.full(len(two), 2))]]
    for head, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        found = [
            (length, first, last)
            for length, first, last in intervals([0, *prefix[head + 1 : head + size].tolist()], least)
            if differs[head + last + 1] - differs[head + first + 1] > 0 or left[head + first] >= _NO_BYTE
        ]
        lengths.append([length for length, _, _ in found])
        counts.append([last - first + 1 for _, first, last in found])
        places += [order[head + first : head + last + 1] for _, first, last in found]
    lengths, counts, places = (np.concatenate([np.asarray(x, np.int64) for x in each]) for each in (lengths, counts, places))
    return lengths, counts, at[places]


def _shards(rows: pa.Table) -> pa.Table:
    """Covered byte ranges of the documents of shards that lie together."""
    keys, lists = [], []
    settled = rows.filter(rows.column("settled").is_valid())
    if len(settled):
        keys += settled.column("key").chunks
        lists += settled.column("settled").chunks
    sent = rows.column("pieces").drop_null()
    if len(sent):
        pieces = pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in sent).combine_chunks()
        own = pieces.column("own").to_numpy()
        for i in np.unique(own):
            found, ranges = _packed(*_covered(pieces.take(pa.array(np.flatnonzero(own == i)))))
            keys.append(pa.array(found))
            lists.append(ranges)
    return pa.table({"key": pa.chunked_array(keys, pa.int64()), "ranges": pa.chunked_array(lists, pa.list_(pa.int64()))})


def _covered(pieces: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, value = pieces.column("key").to_numpy(), pieces.column("value").to_numpy()
    sizes = pieces.column("size").to_numpy().astype(np.int64)
    whole = pieces.column("body").is_valid().to_numpy()
    off, data = tx.buffer(pieces.column("body"))
    starts = pieces.column("starts").combine_chunks()
    n_starts, start = starts.value_lengths().to_numpy(), starts.flatten().to_numpy()
    start_first = np.cumsum(n_starts) - n_starts
    # equal pieces are one class; its rows in larger documents than the smallest are covered whole
    order, heads, number, least = _classes(value, key)
    owner = np.empty(len(key), np.int64)
    owner[order] = number
    covered = np.flatnonzero(key > least[owner])
    at = tx.ragged(start_first[covered], n_starts[covered])
    where = start[at]
    out = [(np.repeat(key[covered], n_starts[covered]), where, where + np.repeat(sizes[covered], n_starts[covered]))]
    # one text of the bytes of the classes that have some
    sample = order[heads]
    class_of = np.flatnonzero(whole[sample])
    if not len(class_of):
        return out[0]
    size = sizes[sample[class_of]]
    first = np.cumsum(size + 1) - size - 1
    text = np.zeros(int((size + 1).sum()), np.int16)
    text[tx.ragged(first, size)] = data[tx.ragged(off[:-1][sample[class_of]], size)].astype(np.int16) + 1
    left = np.full(len(text), _NO_BYTE, np.int16)
    left[1:] = text[:-1] - 1
    # a repeat may go on in the piece before
    left[first] = _MANY
    piece_of = np.repeat(class_of.astype(np.int32), size + 1)
    begin = np.repeat(first.astype(np.int32), size + 1)
    # rows of each class in its smallest document
    own = np.flatnonzero(key == least[owner])
    own = own[np.argsort(owner[own], kind="stable")]
    own_count = np.bincount(owner[own], minlength=len(heads))
    own_first = np.cumsum(own_count) - own_count
    lengths, counts, places = maximal_repeats(text, left)
    if len(lengths):
        # of each group, the places in documents larger than its smallest
        group = least[piece_of[places]]
        smallest = np.minimum.reduceat(group, np.cumsum(counts) - counts)
        later = np.flatnonzero(group > np.repeat(smallest, counts))
        spot, length = places[later], np.repeat(lengths, counts)[later]
        c = piece_of[spot]
        row = own[tx.ragged(own_first[c], own_count[c])]
        shift = np.repeat(spot - begin[spot], own_count[c])
        length = np.repeat(length, own_count[c])
        n = n_starts[row]
        where = start[tx.ragged(start_first[row], n)] + np.repeat(shift, n)
        out.append((np.repeat(key[row], n), where, where + np.repeat(length, n)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeats(rows: DataFrame) -> DataFrame:
    """(key, ranges): the covered byte ranges of each document, packed. rows: key, text."""
    size = total_bytes(rows)
    shared = rows.sparkSession.sparkContext.broadcast(
        repeated(rows, _names, size, (2, 2, HOT), valued=1, most_bits=MOST_BITS)
    )
    shards = int(min(max(64 * TOGETHER, size // SHARD), 1 << 30))
    pieces = rows.mapInArrow(_pieces(shared, shards), _SENT)
    found = pieces.groupBy("shards").applyInArrow(lambda t: _shards(t), "key long, ranges array<long>")
    return found.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    most = (1 << _LENGTH_BITS) - 1
    for batch in tx.slices(batches, "text"):
        off, data = tx.buffer(batch.column("text"))
        ranges = batch.column("ranges").fill_null([])
        counts = ranges.value_lengths().to_numpy()
        packed = ranges.flatten().to_numpy()
        low = (packed >> _LENGTH_BITS) + np.repeat(off[:-1], counts)
        edge = np.bincount(low, minlength=len(data) + 1) - np.bincount(low + (packed & most), minlength=len(data) + 1)
        gone = np.cumsum(edge)[: len(data)] > 0
        inside = np.append(False, gone[:-1])
        inside[off[:-1][off[:-1] < len(data)]] = False
        upto = np.concatenate([[0], np.cumsum(gone)])
        spans = np.concatenate([[0], np.cumsum(gone & ~inside)])
        kept, kept_off = data[~gone].tobytes(), off - upto[off]
        texts = [kept[a:b] for a, b in zip(kept_off[:-1].tolist(), kept_off[1:].tolist(), strict=True)]
        columns = [batch.column("id"), pa.array(np.diff(off)), pa.array(np.diff(upto[off])), pa.array(np.diff(spans[off]))]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(texts, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"]
        )


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (id, n_bytes, n_removed, n_spans, kept), kept being the bytes left."""
    rows = keyed(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")), "id")
    rows = rows.withColumnRenamed(KEY, "key")
    joined = rows.join(repeats(rows.select("key", "text")), "key", "left")
    kind = dict(rows.dtypes)["id"]
    return joined.select("id", "text", "ranges").mapInArrow(
        _cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
