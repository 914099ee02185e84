"""Best-fit packing with swap-based local search.

Documents are turned into tokens and cut into pieces in their own rows; from there on only piece lengths move. Pieces
are numbered and dealt into groups of bounded size by a hash of the number, each group is packed in one task: best-fit decreasing first, then a
local search that exchanges one piece for one, two for one, or moves pieces between underfull bins, taking only steps
that increase the sum of squared fills, until the bound of the total length is met or no step helps. Bins that stay light
are taken apart and their pieces dealt anew, all groups' together, in rounds with ever fewer groups; a piece alone in its
bin that no other remaining piece fits is done. When a round settles fewer than a tenth of its pieces, the lengths
themselves leave the bins light (two pieces of 1,800 in each, say): all bins stay then as their groups' searches left
them. Groups never become larger.

Null and empty texts are one piece with the end token alone. Repeated rows are packed each. Pieces of equal length are
taken in the order of doc_id and piece.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gradeframe.llm import text as tx
from gradeframe.llm.rows import prepared, written

CAPACITY, END = 4096, 1
GROUP = 20_000
LIGHT = 0.9
#: The part of a round's pieces that may be left for another round.
SETTLED = 0.9
#: Cached words of a Python worker.
CACHE = 800_000


def _byte_letters() -> dict[int, int]:
    """How byte-level tokenizers spell bytes: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}


class WordTokens:
    """Token ids of whole texts, each distinct word encoded once while it is remembered.

    The tokenizer drops white space, never joins what it parts, and parts ASCII letters from ASCII signs (an apostrophe
    aside, which may begin a contraction), so a text's ids are its units' ids in a row; case is folded first, as the
    tokenizer does. Texts that may hold a special token are cut at blanks only and keep their case. Units of plain Latin
    letters go straight to the tokenizer's model, all others through the whole tokenizer.
    """

    _SLOTS = 1 << 21

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.kinds = np.zeros(256, np.uint8)
        self.kinds[[b for b in range(33, 127) if b != 39 and not 48 <= b < 58]] = 2
        self.kinds[[*range(65, 91), *range(97, 123)]] = 1
        self._forget()

    def _forget(self) -> None:
        """Entries are numbered as they come; found by slot, or else by sorted hash."""
        self.slot_hash = np.zeros(self._SLOTS, np.uint64)
        self.slot_entry = np.zeros(self._SLOTS, np.int32)
        self.hashes, self.entries = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, off: np.ndarray, data: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Row offsets and ids; each row ends with the end token."""
        if b"<|" in data.tobytes():
            w = tx.words(off, data, tx.CASED_WORDS)
        else:
            w = tx.words(off, data, tx.LOWER_WORDS, self.kinds)
        entry = self._entries(w, tx.hashes(w))
        first, count = self.first[entry], self.count[entry]
        sums = np.concatenate([[0], np.cumsum(count)])
        rows = sums[w.first] + np.arange(len(w.first))
        ids = np.full(rows[-1], end, np.uint32)
        place = np.ones(rows[-1], bool)
        place[rows[1:] - 1] = False
        ids[place] = self.ids[tx.ragged(first, count)]
        return rows, ids

    def _entries(self, w: tx.Words, h: np.ndarray) -> np.ndarray:
        if len(self.first) > CACHE:
            self._forget()
        slot = (h & np.uint64(self._SLOTS - 1)).astype(np.int64)
        entry = self.slot_entry[slot]
        rest = np.flatnonzero(self.slot_hash[slot] != h)
        if not len(rest) or not len(h):
            return entry
        distinct, sample, each = np.unique(h[rest], return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        found = np.empty(len(distinct), np.int32)
        found[known] = self.entries[at[known]]
        new = ~known
        if new.any():
            found[new] = self._learn(w, rest[sample[new]])
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.entries = np.insert(self.entries, at[new], found[new])
        entry[rest] = found[each]
        self.slot_hash[slot[rest]], self.slot_entry[slot[rest]] = h[rest], entry[rest]
        return entry

    def _learn(self, w: tx.Words, where: np.ndarray) -> np.ndarray:
        raw = w.folded.tobytes()
        counts, flat = [], []
        for s, e in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True):
            body = raw[s:e]
            word = body.decode()
            if word.isalpha() and max(word) < "\u0130":
                spelled = word.lower().encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.model.tokenize(spelled)]
            else:
                ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            counts.append(len(ids))
            flat += ids
        count = np.array(counts, np.int64)
        number = np.arange(len(self.first), len(self.first) + len(count), dtype=np.int32)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, np.array(flat, np.uint32)])
        return number


_encoders: dict[str, WordTokens] = {}


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _encoders:
            _encoders[path] = WordTokens(path)
        for batch in tx.slices(batches, "text"):
            rows, ids = _encoders[path].encode(*tx.buffer(batch.column("text")), end)
            sizes = np.diff(rows)
            counts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = tx.ragged(np.zeros(len(sizes), np.int64), counts)
            start = piece * capacity
            length = np.minimum(capacity, sizes[row] - start)
            raw = ids.astype("<u4").tobytes()
            ranges = zip((4 * (rows[row] + start)).tolist(), (4 * (rows[row] + start + length)).tolist(), strict=True)
            bodies = [raw[a:b] for a, b in ranges]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start)]
            columns += [pa.array(length), pa.array([zlib.crc32(b) for b in bodies], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(bodies, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """A row per piece of each document: doc_id, piece, start, length, ids_crc32, and on request the ids themselves as
    little-endian 32-bit numbers. `tokenizer`: path of a tokenizers file that all executors can read."""
    prepared(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(_pieces(tokenizer, capacity, end, with_ids), schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers; pieces must come from long to short. Each goes where the least room is left."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the rooms that some bin has, sorted
    for i, size in enumerate(lengths):
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([])
            b, room = len(bins) - 1, capacity
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        bins[b].append(i)
        room -= size
        if room:
            if room not in by_room:
                by_room[room] = []
                bisect.insort(rooms, room)
            by_room[room].append(b)
    return bins


class Search:
    """Local search over the underfull bins of one group."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins = bins
        self.room = np.array([capacity - sum(lengths[i] for i in b) for b in bins], np.int64)

    def run(self) -> list[list[int]]:
        """Bins after the search: lighter bins give, fuller ones take; ends when no step helps, or at the least number."""
        least, left, changed = -(-sum(self.lengths) // self.capacity), sum(map(bool, self.bins)), True
        while changed and left > least:
            changed = False
            live = sorted((b for b in range(len(self.bins)) if self.bins[b] and self.room[b]), key=lambda b: (-self.room[b], b))
            # what may come back from a taker: one of its pieces, or nothing
            self.back = [i for b in live for i in self.bins[b]] + [-1] * len(live)
            self.size = np.array([self.lengths[i] if i >= 0 else 0 for i in self.back], np.int64)
            self.of = np.array([b for b in live for _ in self.bins[b]] + live, np.int64)
            self.entry = {i: n for n, i in enumerate(self.back) if i >= 0}
            for a in live:
                while self.bins[a] and self.improve(a):
                    changed = True
                left -= not self.bins[a]
                if left <= least:
                    break
        return [b for b in self.bins if b]

    def improve(self, a: int) -> bool:
        """The step from a to a fuller bin that raises the squared fills most. Any that makes the taker fuller does."""
        own: dict[int, list[int]] = {}
        for i in self.bins[a]:
            own.setdefault(self.lengths[i], []).append(i)
        sizes = np.array(sorted(own), np.int64)
        twice = sizes[[len(own[x]) > 1 for x in sizes.tolist()]]
        m, n = np.triu_indices(len(sizes), 1)
        totals = np.concatenate([sizes, sizes[m] + sizes[n], 2 * twice])
        # the largest total up to each number
        upto = np.zeros(self.capacity + 1, np.int64)
        totals = totals[totals <= self.capacity]
        upto[totals] = totals
        upto = np.maximum.accumulate(upto)
        room = self.room[self.of]
        more = upto[self.size + room] - self.size
        gain = np.where((more > 0) & (room <= self.room[a]) & (self.of != a), more * (self.room[a] - room + more), 0)
        at = int(gain.argmax())
        if gain[at] <= 0:
            return False
        b, total, taken = int(self.of[at]), int(upto[self.size[at] + room[at]]), self.back[at]
        given = own[total][:1] if total in own else None
        for x in own if given is None else ():
            y = total - x
            if y in own and (x != y or len(own[x]) > 1):
                given = own[x][:2] if x == y else [own[x][0], own[y][0]]
                break
        back = [taken] if taken >= 0 else []
        self.bins[a] = [i for i in self.bins[a] if i not in given] + back
        self.bins[b] = [i for i in self.bins[b] if i not in back] + given
        for i in given:
            self.of[self.entry[i]] = b
        for i in back:
            self.of[self.entry[i]] = a
        self.room[a] += more[at]
        self.room[b] -= more[at]
        return True


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of piece numbers, for lengths of at most the capacity in any order."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    sizes = [lengths[i] for i in order]
    return [[order[i] for i in b] for b in Search(sizes, best_fit(sizes, capacity), capacity).run()]


def _pack_group(capacity: int, round_: int):
    def run(rows: pa.Table) -> pa.Table:
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("doc_id", "piece", "ids_crc32")])
        rows = rows.take(order)
        lengths = rows.column("length").to_pylist()
        bins = pack(lengths, capacity)
        number, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        light, alone = np.zeros(len(rows), bool), np.zeros(len(rows), bool)
        for b, members in enumerate(bins):
            ends = np.cumsum([lengths[i] for i in members])
            number[members] = b
            offset[members] = np.concatenate([[0], ends[:-1]])
            light[members] = ends[-1] < LIGHT * capacity
            alone[members] = len(members) == 1
        group = rows.column("group")[0].as_py()
        ids = (round_ << 56) + (group << 24) + number
        for name, values in (("sequence_id", ids), ("offset", offset), ("light", light), ("alone", alone)):
            rows = rows.append_column(name, pa.array(values))
        return rows

    return run


def place(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset."""
    names = [*rows.columns, "sequence_id", "offset"]
    rows = written(rows.withColumn("deal", F.monotonically_increasing_id()), "pieces")
    n, done, round_ = rows.count(), None, 0
    while True:
        groups = max(1, -(-n // group))
        dealt = rows.withColumn("group", F.pmod(F.xxhash64("deal", F.lit(round_)), groups))
        schema = dealt.selectExpr("*", "0L AS sequence_id", "0L AS offset", "false AS light", "false AS alone").schema
        packed = dealt.groupBy("group").applyInArrow(_pack_group(capacity, round_), schema)
        left = 0
        if groups > 1:
            packed = written(packed, "packed")
            # a piece alone stays so if not even the shortest of the rest fits
            least = packed.filter("light").agg(F.min("length")).first()[0] or 0
            open_ = F.col("light") & ~(F.col("alone") & (F.col("length") + least > capacity))
            left = packed.filter(open_).count()
        again = 0 < left <= SETTLED * n
        full = packed.filter(~open_) if again else packed
        done = full.select(*names) if done is None else done.unionByName(full.select(*names))
        if not again:
            return done
        n, rows, round_ = left, packed.filter(open_).select(*rows.columns), round_ + 1


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    return place(pieces(docs, tokenizer))


def sequences(placed: DataFrame) -> DataFrame:
    """A row per sequence: its ids as little-endian 32-bit numbers, for pieces placed with their ids. A sequence has at
    most `capacity` tokens, so that the collected pieces are bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(
        F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids")
    )
