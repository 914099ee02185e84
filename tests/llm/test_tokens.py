"""Token alignment and power-of-two packing against the tokenizers themselves."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from gradeframe.llm import alignment, buckets, text as tx, units
from gradeframe.llm.queries import BYTE_TOKENIZER, PIECE_TOKENIZER, QUERIES, tokenizer_path
from tests.llm import brute

A, B = tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER)
SF = "/root/testdata/sf0.001"
#: Signs about which a tokenizer may begin anew, or may not.
SIGNS = [" ", "  ", "\n", "\t", "\r\n", ";\r", "\u00a0", "\u2009", "\u3000", "\u202f", "\u1680", "\u2028", "\u200b", "\u180e"]
SIGNS += ["\x85", "\x1c", "\x00", "a", "Bc", "é", "à", "ß", "x\u0301"]
SIGNS += ["12", "7", "'s", "don't", "''", ",", ". ", "_-", "日本", "😀", "<|endoftext|>", "<s>", "<0x41>", "hello", "tokenization", "café "]


def odd_texts(seed, n=200, length=30, signs=SIGNS):
    r = random.Random(seed)
    return ["".join(r.choice(signs) for _ in range(r.randrange(length))) for _ in range(n)]


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(3)
    return " ".join("".join(r.choice("abcdeé, ") for _ in range(r.randrange(1, 12))) for _ in range(200_000))


def test_units_cover_every_row():
    texts = [*odd_texts(1), "", None, "one"]
    off, data = tx.buffer(pa.array(texts))
    w = units.cut(off, data)
    for i, text in enumerate(texts):
        parts = [data[s:e].tobytes() for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
        assert b"".join(parts) == (text or "").encode() and all(parts)


def test_known_units_keep_their_numbers_and_are_forgotten():
    told, forgotten = {}, []

    def learn(first, bodies):
        told.update({first + i: b for i, b in enumerate(bodies)})

    known = units.Known(learn, lambda: forgotten.append(told.clear()), most=30)
    for seed in range(20):
        off, data = tx.buffer(pa.array(odd_texts(seed, 20)))
        w = units.cut(off, data)
        for number, s, e in zip(known.find(w).tolist(), w.start, w.end, strict=True):
            assert told[number] == data[s:e].tobytes()
    assert len(forgotten) > 2


@pytest.mark.parametrize("seed", range(3))
def test_ids_are_the_tokenizers(seed):
    texts = [*odd_texts(seed), "", "<|endoftext|>", " <|endoftext|> a<|endoftext|>"]
    rows, ids = buckets.Encoder(A).encode(*tx.buffer(pa.array(texts)), 1)
    tokenizer = Tokenizer.from_file(A)
    for i, text in enumerate(texts):
        assert ids[rows[i] : rows[i + 1]].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_decompose():
    sizes = np.arange(1, 5000)
    row, length = buckets.decompose(sizes)
    assert (np.bincount(row, length)[:] == np.append(np.zeros(0), sizes)).all()
    assert (length & (length - 1) == 0).all() and length.max() == 2048
    same = row[1:] == row[:-1]
    assert (length[1:][same] <= length[:-1][same]).all()
    # no length below the full one is met twice in a row
    assert ((length[1:] < length[:-1]) | (length[:-1] == 2048))[same].all()
    with pytest.raises(ValueError):
        buckets.decompose(sizes, 1000)


def check_packing(rows, texts, capacity=2048):
    """rows of the operator against the ids of [(doc_id, text)], which may repeat."""
    tokenizer = Tokenizer.from_file(A)
    want = sorted(
        (doc, len(ids), at, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))
        for doc, text in texts
        for ids in [tokenizer.encode(text or "", add_special_tokens=False).ids + [1]]
        for at, n in pieces_of(len(ids), capacity)
    )
    assert sorted((r.doc_id, r.doc_tokens, r.start, r.ids_crc32) for r in rows) == want
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} <= {0}
    places = defaultdict(list)
    for r in rows:
        assert r.length == 1 << r.bucket
        places[r.length].append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def pieces_of(n, capacity):
    at, step = 0, capacity
    while at < n:
        while step > n - at:
            step //= 2
        yield at, step
        at += step


def test_packing(spark, frame, corpus):
    check_packing(buckets.pieces(frame(corpus), A).collect(), list(enumerate(corpus)))


def test_packing_of_repeated_and_empty_rows(spark, frame):
    texts = [(1, "a b c d"), (1, "a b c d"), (2, None), (2, ""), (7, "x" * 50), (7, "the " * 9)]
    docs = frame(texts).withColumnRenamed("source", "nth")
    check_packing(buckets.pieces(docs, A).collect(), texts)
    assert buckets.pieces(frame([(None, "a")]), A).first().doc_id is None
    assert buckets.digest(frame([]), A).collect() == []


def test_packing_of_equal_lengths_and_a_long_text(spark, frame, long_text):
    texts = [(i, "word " * 300) for i in range(2000)] + [(-1, long_text)]
    check_packing(buckets.pieces(frame(texts, 7), A).collect(), texts)


def test_batches_hold_one_length(spark, frame, corpus, tmp_path):
    packed = buckets.pieces(frame(corpus * 3), A, capacity=64, with_ids=True)
    rows = buckets.batches(packed, 128).collect()
    held = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        held[r.bucket, r.batch].append(r.length)
    for (bucket, batch), lengths in held.items():
        last = max(b for k, b in held if k == bucket)
        assert sum(lengths) == 128 or (batch == last and sum(lengths) < 128)
    buckets.write_buckets(packed, str(tmp_path / "b"))
    read = spark.read.parquet(str(tmp_path / "b"))
    assert read.filter("bucket = 3").count() == packed.filter("length = 8").count() > 0


def plain_align(a, b):
    common = sorted(set(a) & set(b))
    return [a.index(x) + 1 for x in common], [b.index(x) + 1 for x in common]


@pytest.mark.parametrize("seed", range(40))
def test_align(seed):
    r = random.Random(seed)
    size = r.choice([5, 50, 2000])
    full = sorted(r.sample(range(1, 3 * size), size))
    share = r.choice([0.05, 0.5, 0.95])
    a = [x for x in full if r.random() < share] + [3 * size]
    b = [x for x in full if r.random() < r.choice([share, 1.0])] + [3 * size]
    got = alignment.align(np.array(a), np.array(b))
    assert tuple(x.tolist() for x in got) == plain_align(a, b)
    same = alignment.align(np.array(a), np.array(a))
    assert same[0].tolist() == same[1].tolist() == list(range(1, len(a) + 1))


def test_align_nothing():
    assert [len(x) for x in alignment.align(np.zeros(0), np.zeros(0))] == [0, 0]


def spelled(rows):
    keys = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return {r.doc_id: tuple(r[k] for k in keys) for r in rows}


def expected(texts):
    made = brute.alignment(texts, A, B)
    return {i: (*m[:6], sha256(m[6].encode()).hexdigest() if m[6] else "") for i, m in enumerate(made)}


def test_alignment_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = expected([r.text for r in docs])
    assert spelled(QUERIES["op11_alignment"](spark, SF).collect()) == {docs[i].doc_id: w for i, w in want.items()}


@pytest.mark.parametrize("common", [None, 300, 0])
def test_alignment_of_odd_texts(spark, frame, common):
    """With all pairs told to all tasks, some, and none."""
    few = [s for s in SIGNS if s.isascii()]
    texts = [*odd_texts(5, 150, 12, few), *odd_texts(6, 50), None, "", " ", "\u2581 not its own", "\ufeff", "wor\u2581d", "\u2581"]
    texts += ["same text"] * 20
    rows = alignment.digest(frame(texts).withColumnRenamed("source", "number"), A, B, common).collect()
    assert spelled(rows) == expected(texts) and len(rows) == len(texts)


def test_groups_of_a_long_text(spark, frame, long_text):
    docs = frame([long_text, long_text[:1000], "😀" * 3000 + "a" * 3000])
    rows = {r.doc_id: r for r in alignment.alignments(docs, A, B, with_groups=True).collect()}
    want = brute.alignment([long_text, long_text[:1000], "😀" * 3000 + "a" * 3000], A, B)
    for i, w in enumerate(want):
        assert rows[i].groups == w[6] and rows[i].n_links == w[3] == sum(rows[i].times)
        assert len(set(rows[i].pairs)) == len(rows[i].pairs)


def test_wide_groups_are_counted_by_distinct_ids(monkeypatch):
    made = []
    for most in (4096, 1):
        monkeypatch.setattr(alignment, "WIDE", most)
        made.append([c.to_pylist() for c in alignment.Aligner(A, B).rows(pa.array(odd_texts(9)), True)])
    assert made[0] == made[1]


def test_alignment_of_nothing_and_of_repeated_ids(spark, frame):
    assert alignment.digest(frame([]), A, B).collect() == []
    rows = alignment.digest(frame([(1, "a b"), (1, "a b"), (None, "a c"), (None, None)]), A, B).collect()
    assert sorted((r.doc_id or 0, r.n_a, r.count_sum) for r in rows) == [(0, 0, 0), (0, 2, 4), (1, 2, 5), (1, 2, 5)]
