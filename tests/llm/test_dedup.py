"""Exact, near, word and byte dedup and decontamination against plain versions."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import decontaminate, exact_dedup, ngram_join, substring_dedup, suffix_dedup, suffixes
from gradeframe.llm import text as tx
from gradeframe.llm.rows import components, keyed
from tests.llm import brute


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


ITEMS = [(1, "A1 b2 c3"), (2, None), (3, ""), (None, "one"), (5, "h1 " * 14), (5, "zz"), (11, "Ünïcode àb AB 12")]


def test_decontaminate(spark, frame, corpus):
    items = ITEMS + [(100 + i, " ".join((t or "").split()[5:30])) for i, t in enumerate(corpus[:40:5])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contaminated(enumerate(corpus), [("null" if k is None else k, t) for k, t in items])
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontaminate.digest(frame(corpus), bench), *columns) == want


def test_decontaminate_in_blocks(spark, frame, corpus, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    items = ITEMS + [(100 + i, " ".join((t or "").split()[2:16])) for i, t in enumerate(corpus[30:44])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contaminated(enumerate(corpus), [("null" if k is None else k, t) for k, t in items])
    got = decontaminate.digest(frame(corpus), bench)
    assert by_id(got, "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == want


def test_clean_keeps_columns(spark, frame, corpus):
    docs = frame(corpus).withColumn("n_hit", F.lit(7)).withColumn("key", F.lit("x"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.clean(docs, bench)
    bad = {k for k, v in brute.contaminated(enumerate(corpus), ITEMS).items() if v[-1]}
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == set(range(len(corpus))) - bad
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(docs, empty).count() == len(corpus)


def test_exact_dedup(frame, corpus):
    groups = {}
    for i, t in enumerate(corpus):
        groups.setdefault(t or "", []).append(i)
    want = {i: (max(g), len(g), i == max(g), brute.sha(t)) for t, g in groups.items() for i in g}
    got = exact_dedup.digest(frame(corpus))
    assert by_id(got, "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_dedup_of_odd_rows(frame, odd_rows):
    rows = exact_dedup.digest(frame(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    long = [r for r in rows if r.group_size == 4]
    assert len(long) == 4 and {r.keep_id for r in long} == {2} and sum(r.kept for r in long) == 1
    empty = [r for r in rows if r.text_sha256 == brute.sha("")]
    assert len(empty) == 3 and {r.keep_id for r in empty} == {3} and sum(r.kept for r in empty) == 1
    kept = exact_dedup.dedup(frame(odd_rows).withColumn("keep_id", F.lit(1)))
    assert kept.count() == 4 and kept.columns[-1] == "keep_id"


def test_exact_dedup_across_batches(spark, frame):
    index = exact_dedup.DigestIndex(spark)
    assert exact_dedup.dedup(frame(["a", "b", "b"]), index).count() == 2
    second = frame([(7, "b"), (8, "c"), (9, "c"), (10, None)])
    assert sorted(r.doc_id for r in exact_dedup.dedup(second, index).collect()) == [9, 10]
    assert index.table().count() == 4
    # the index side of the anti-join is read in its buckets, without a shuffle
    new = spark.createDataFrame([(bytes(32),)], "digest binary")
    plan = new.join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("steps", [(2, 64, 1024, 16384), (2, 4, 8, 16)])
def test_ngram_join(frame, corpus, monkeypatch, steps):
    monkeypatch.setattr(ngram_join, "STEPS", steps)
    got = by_id(ngram_join.digest(frame(corpus)), "n_shingles", "component_id")
    assert got == brute.near_groups(enumerate(corpus))


def test_ngram_join_of_a_family_with_outliers(frame, monkeypatch):
    monkeypatch.setattr(ngram_join, "STEPS", (2, 4, 8, 16))
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for n in range(90):
        near = list(base)[: 60 - n % 4]
        for _ in range(r.randrange(6)):
            near[r.randrange(len(near))] = f"e{r.randrange(30)}"
        texts.append(" ".join(near))
    got = by_id(ngram_join.digest(frame(texts)), "n_shingles", "component_id")
    want = brute.near_groups(enumerate(texts))
    assert got == want and 2 < len({c for _, c in want.values()}) < 80


def test_ngram_dedup(frame, corpus, odd_rows):
    groups = brute.near_groups(enumerate(corpus))
    docs = frame(corpus).withColumn("sid", F.lit(1)).withColumn("id", F.lit("i"))
    got = ngram_join.dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for _, c in groups.values()})
    kept = ngram_join.dedup(frame(odd_rows))
    assert sorted((r.text or "")[:5] for r in kept.collect()) == ["", "", "", "alpha", "other", "solo"]
    rows = ngram_join.digest(frame(odd_rows)).collect()
    assert {r.component_id for r in rows if r.n_shingles == 17} == {1}


def test_substring_dedup(frame, corpus):
    got = by_id(substring_dedup.digest(frame(corpus)), "n_words", "n_removed", "kept_sha256")
    assert got == brute.repeated_words(enumerate(corpus))


def test_substring_dedup_of_odd_rows(frame, odd_rows):
    rows = substring_dedup.digest(frame(odd_rows)).collect()
    # of four rows with the text, the first, whose id is null, stays whole
    long = [(r.doc_id, r.n_removed) for r in rows if r.n_words == 21]
    assert sorted(long, key=str) == [(1, 21), (1, 21), (2, 21), (None, 0)]


def test_recompression_names_agree_inside_windows():
    r = np.random.default_rng(3)
    for _ in range(60):
        part = r.integers(0, r.choice([2, 5, 1000]), 30).astype(np.uint64)
        names = []
        for pad in (0, 1, 7, 40):
            h = np.concatenate([r.integers(0, 9, pad).astype(np.uint64), part, r.integers(0, 9, pad).astype(np.uint64)])
            n = len(h)
            w = tx.Words(np.arange(n), np.arange(n) + 1, np.array([0, n]), np.zeros(n, np.uint8))
            levels = substring_dedup.recompress(h, w)
            for s in levels:
                assert (np.diff(s.low) >= 0).all() and (np.diff(s.high) >= 0).all()
            at, name, _ = substring_dedup.anchors(h, w)
            names.append(name[(at >= pad) & (at + 20 <= pad + 30)].tolist())
        assert names[0] == names[1] == names[2] == names[3]


@pytest.mark.parametrize("hot", [2000, 2])
def test_suffix_dedup(frame, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = by_id(suffix_dedup.digest(frame(corpus)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute.repeated_bytes(enumerate(corpus))


def test_suffix_dedup_of_odd_rows(frame, odd_rows):
    rows = suffix_dedup.digest(frame(odd_rows)).collect()
    long = [(r.doc_id, r.n_removed) for r in rows if r.n_bytes > 50]
    size = len(odd_rows[0][1])
    assert sorted(long, key=str) == [(1, size), (1, size), (2, size), (None, 0)]


def test_long_texts_are_cut_alike_in_both_passes(frame):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    made = lambda n: "".join(r.choices(letters, k=n))
    span, cut = suffix_dedup.SPAN, suffix_dedup.SEGMENT
    while True:  # a line whose first windows have an anchor of their own, which the byte before the line does not have
        line, before = made(60), made(90)
        part = np.frombuffer((before + line + before).encode(), np.uint8)
        place, _ = suffix_dedup.anchors(part, tx.byte_sums(part), len(part) - span + 1)
        count = int((place[90 : 90 + 11] == place[90]).sum())
        if place[89] != place[90] and 4 <= count < 11:
            break
    long = made(cut - 90 - count // 2) + before + line + made(200_000)
    assert line in long and long.index(line) < cut < long.index(line) + count
    rows = [(1, line), (2, made(600_000)), (3, long)]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.digest(frame(rows, parts=1)).collect()}
    assert got == {1: (0, 0), 2: (0, 0), 3: (60, 1)}


def test_segments_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 64)
    off = np.array([0, 10, 10, 170, 219, 300])
    data = np.arange(300, dtype=np.uint8)
    seen = [at + i for at, part, row in suffix_dedup.segments(off, data) for i in np.flatnonzero(row >= 0)]
    want = [i for a, b in zip(off[:-1], off[1:], strict=True) for i in range(a, b - 49)]
    assert sorted(seen) == want


class _All:
    """A filter that lets all keys pass, up to a threshold."""

    def __init__(self, level):
        self.level = level

    def reaches(self, keys, threshold=0):
        return np.full(len(keys), threshold < self.level)


@pytest.mark.parametrize("level", [1, 2, 3])
def test_a_task_sends_few_rows_however_many_shards(level):
    r = random.Random(7)
    texts = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz ", k=400)) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"key": list(range(600)), "text": texts * 2})
    shared = SimpleNamespace(value=_All(level))
    sent = pa.Table.from_batches(list(suffix_dedup._pieces(shared, 800)(iter([batch]))))
    pieces = sent.column("pieces").drop_null()
    # windows are sent in parts of a bounded size
    assert 50 < len(pieces) <= 100 * (2 if level == 3 else 1)
    # of equal pieces the later ones are settled where they are, whatever is sent of the others
    ranges = sent.filter(sent.column("settled").is_valid())
    assert sorted(ranges.column("key").to_pylist()) == list(range(300, 600))
    assert set(ranges.column("settled").to_pylist()[0]) == {400}


def test_only_stretches_of_repeated_windows_are_sorted(monkeypatch):
    r = np.random.default_rng(2)
    parts = [r.integers(1, 250, 2000) for _ in range(20)]
    for i, n in ((3, 60), (9, 75), (15, 60)):
        parts[i][100 : 100 + n] = parts[1][500 : 500 + n]
    text = np.concatenate([np.append(p, 0) for p in parts]).astype(np.int16)
    before = np.append(suffix_dedup._NO_BYTE, text[:-1] - 1)
    sorted_, sort = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda text, **more: sorted_.append(len(text)) or sort(text, **more))
    lengths, counts, places = suffix_dedup.maximal_repeats(text, before)
    groups = zip(lengths.tolist(), np.split(places, np.cumsum(counts)[:-1]), strict=True)
    want = [(60, [1 * 2001 + 500, 3 * 2001 + 100, 9 * 2001 + 100, 15 * 2001 + 100]), (75, [1 * 2001 + 500, 9 * 2001 + 100])]
    assert sorted((n, sorted(p.tolist())) for n, p in groups) == want
    assert sorted_ == [76 * 2 + 61 * 2]


def test_maximal_repeats():
    r = np.random.default_rng(1)
    for _ in range(80):
        parts = [r.integers(1, 4, r.integers(1, 30)) for _ in range(4)]
        text = np.concatenate([np.append(p, 0) for p in parts])
        before = np.append(suffix_dedup._NO_BYTE, text[:-1] - 1)
        before[before < 0] = suffix_dedup._NO_BYTE
        lengths, counts, places = suffix_dedup.maximal_repeats(text, before, 3)
        parts = np.split(places, np.cumsum(counts)[:-1]) if len(counts) else []
        got = {(n, tuple(sorted(p.tolist()))) for n, p in zip(lengths.tolist(), parts, strict=True)}
        raw = "".join(chr(97 + x) if x else chr(1000 + i) for i, x in enumerate(text))
        want = set()
        for n in range(3, 30):
            for sub in {raw[i : i + n] for i in range(len(raw) - n + 1)}:
                at = [i for i in range(len(raw)) if raw.startswith(sub, i)]
                if len(at) > 1 and max(sub) < chr(200):
                    left = {raw[i - 1] if i and raw[i - 1] < chr(200) else str(i) for i in at}
                    if len(left) > 1 and len({raw[i + n] for i in at}) > 1:
                        want.add((n, tuple(at)))
        assert got == want


def test_fm_index():
    r = np.random.default_rng(2)
    for _ in range(40):
        text = np.append(0, np.append(r.integers(0, 5, 200), 0))
        index = suffixes.FMIndex(text, 4, sample=int(r.integers(1, 9)))
        patterns = r.integers(1, 5, (30, 5))
        lengths = r.integers(1, 6, 30)
        low, high = index.search(patterns, lengths)
        for i in range(30):
            p = patterns[i, : lengths[i]].tolist()
            want = [j for j in range(len(text)) if text[j : j + len(p)].tolist() == p]
            assert sorted(index.locate(np.arange(low[i], high[i])).tolist()) == want


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    links += [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(120)] + [(7, 7)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {k: find(k) for k in root if k != 7}
    r.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long"))
    rows = [(x.node, x.component) for x in got.collect()]
    got = dict(rows)
    assert len(rows) == len(got) and got == {k: v for k, v in want.items() if k in got}
    assert all(v == k for k, v in want.items() if k not in got)


def test_keyed_orders_repeated_and_missing_ids(frame, odd_rows):
    rows = keyed(frame(odd_rows)).orderBy("__row_key").collect()
    assert len({r["__row_key"] for r in rows}) == len(rows)
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids)


@pytest.mark.parametrize("op", [exact_dedup, ngram_join, substring_dedup, suffix_dedup])
def test_empty_table(frame, op):
    assert op.digest(frame([])).collect() == []
    if hasattr(op, "dedup") and op in (exact_dedup, ngram_join):
        assert op.dedup(frame([])).collect() == []


def test_word_hashes_do_not_depend_on_neighbours(corpus):
    import pyarrow as pa

    whole = pa.array([t.encode() if t else t for t in corpus])
    w = tx.words(*tx.buffer(whole), tx.LETTER_WORDS)
    h = tx.hashes(w)
    for i in [*range(0, len(corpus), 5), *range(len(corpus) - 15, len(corpus))]:
        own = tx.words(*tx.buffer(whole.slice(i, 1)), tx.LETTER_WORDS)
        assert len(own.start) == len(brute.letter_words(corpus[i]))
        assert (tx.hashes(own) == h[w.first[i] : w.first[i + 1]]).all()
