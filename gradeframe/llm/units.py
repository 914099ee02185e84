"""Texts cut into units that tokenizers treat independently, each distinct unit encoded once while it is remembered.

A unit begins where blanks or line ends follow something else, and where ASCII letters, digits and signs meet (an
apostrophe aside, which may begin a contraction). Where it is not certain that a tokenizer begins anew there is no cut,
so that a text's tokens are its units' tokens in a row: after bytes that may be a blank beyond ASCII nothing is cut.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

from gradeframe.llm import text as tx

#: Units that a Python worker remembers.
CACHE = 400_000
_SLOTS = 1 << 20
#: A unit of one line with no blank but perhaps one in front.
_LINE = re.compile(rb" ?[^\x00-\x20\xC2\xE1-\xE3](?:[^\n]*[^\x00-\x20\x80-\x8A\x8E\x9F\xA0\xA8\xA9\xAF]|[^\n]*\xC3[\x80-\xBF])?\Z")


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[[b for b in range(33, 127) if b != 39]] = 2
    kinds[[*range(65, 91), *range(97, 123)]] = 1
    kinds[48:58] = 3
    return kinds


KINDS = _kinds()
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True
#: Blanks beyond ASCII have two bytes, the first 0xC2, or three, the first one of these, and end so.
_LEADS = np.zeros(256, bool)
_LEADS[[0xE1, 0xE2, 0xE3]] = True
_TAILS = np.zeros(256, bool)
_TAILS[[*range(0x80, 0x8B), 0x8E, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True


def _blank_before(data: np.ndarray) -> np.ndarray:
    """For each byte but the first, whether the one before it is or may be the end of a blank or a control sign."""
    last = data[:-1]
    wide = _TAILS[last]
    lead = np.zeros(len(last), bool)
    lead[1:] = data[:-2] == 0xC2
    lead[2:] |= _LEADS[data[:-3]]
    return (last < 0x21) | (wide & lead)


def cut(off: np.ndarray, data: np.ndarray, fine: bool = True) -> tx.Words:
    """Units as byte ranges that cover each row; rows without bytes have none. fine: also where kinds of signs meet."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return tx.Words(none, none, np.zeros(len(off), np.int64), data)
    begin = np.zeros(n + 1, bool)
    begin[1:n] = _BLANK[data[1:]] & ~_blank_before(data)
    if fine:
        kind = KINDS[data]
        begin[1:n] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    begin[off] = True
    start = np.flatnonzero(begin[:n])
    end = np.append(start[1:], n)
    return tx.Words(start, end, np.searchsorted(start, off), data)


def whole(off: np.ndarray, data: np.ndarray) -> tx.Words:
    """Each row that has bytes is one unit."""
    start, end = off[:-1][np.diff(off) > 0], off[1:][np.diff(off) > 0]
    return tx.Words(start, end, np.searchsorted(start, off), data)


class Known:
    """Numbers of distinct units in the order they come; what belongs to them is kept by `learn`.

    learn(first, bodies): is told the units numbered from `first` on. forget(): all numbers begin anew.
    """

    def __init__(self, learn: Callable[[int, list[bytes]], None], forget: Callable[[], None], most: int = CACHE):
        self.learn, self.forget, self.most = learn, forget, most
        self._empty()

    def _empty(self) -> None:
        self.slot_hash, self.slot_number = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32)
        self.hashes, self.numbers, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int32), 0
        self.forget()

    def find(self, w: tx.Words) -> np.ndarray:
        """The number of each unit."""
        if self.size > self.most:
            self._empty()
        h = tx.hashes(w)
        slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
        number = self.slot_number[slot]
        rest = np.flatnonzero((self.slot_hash[slot] != h) | (number < 0))
        if not len(rest):
            return number
        distinct, sample, each = np.unique(h[rest], return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        found = np.empty(len(distinct), np.int32)
        found[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = w.folded.tobytes()
            where = rest[sample[new]]
            bodies = [raw[s:e] for s, e in zip(w.start[where].tolist(), w.end[where].tolist(), strict=True)]
            self.learn(self.size, bodies)
            found[new] = np.arange(self.size, self.size + len(new))
            self.size += len(new)
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.numbers = np.insert(self.numbers, at[new], found[new])
        number[rest] = found[each]
        self.slot_hash[slot[rest]], self.slot_number[slot[rest]] = h[rest], number[rest]
        return number


def byte_letters() -> dict[int, str]:
    """How byte-level tokenizers spell bytes: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level tokenizer of the `tokenizers` library. special: its special tokens' strings in a text are tokens."""

    def __init__(self, path: str, special: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        # units hold for the plain byte-level split only
        self.cuts = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.line_end = (self.tokenizer.encode("\n", add_special_tokens=False).ids or [None])[0]
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each unit, and all ids in a row.

        Units without line ends that begin with one blank at most and end with none are encoded as the lines of one text:
        a line end is a token of its own before each of them.
        """
        joined = np.array([self.cuts and bool(_LINE.match(b)) and not any(s in b for s in self.special) for b in bodies], bool)
        lines = [b for b, one in zip(bodies, joined.tolist(), strict=True) if one]
        count = np.zeros(len(bodies), np.int64)
        others = {}
        if lines:
            text = b"\n" + b"\n".join(lines)
            ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.line_end)
            if len(at) != len(lines):
                raise ValueError("a line end is no token of its own")
            count[joined] = np.diff(np.append(at, len(ids))) - 1
            flat = ids[ids != self.line_end]
        else:
            flat = np.zeros(0, np.uint32)
        for i in np.flatnonzero(~joined).tolist():
            others[i] = self.tokenizer.encode_batch_fast([bodies[i].decode()], add_special_tokens=False)[0].ids
            count[i] = len(others[i])
        if not others:
            return count, flat
        out = np.empty(count.sum(), np.uint32)
        out[np.repeat(joined, count)] = flat
        out[np.repeat(~joined, count)] = [x for ids in others.values() for x in ids]
        return count, out

    def token_bytes(self) -> list[bytes]:
        """The bytes of each token, byte-level decoded; a special token's are its own string's."""
        letters = {ord(c): b for b, c in byte_letters().items()}
        added = self.tokenizer.get_added_tokens_decoder()
        out = []
        for i in range(self.tokenizer.get_vocab_size()):
            if i in added:
                out.append(added[i].content.encode())
            else:
                piece = self.tokenizer.id_to_token(i) or ""
                out.append(bytes(letters[ord(c)] for c in piece))
        return out
