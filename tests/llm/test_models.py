"""Classifiers, language model, packing and licence scans."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import langid, licenses, lm, packing, quality
from gradeframe.llm.queries import tokenizer_path
from tests.llm import brute
from tests.llm.conftest import words


def crc(key):
    return zlib.crc32(str(key).encode())


def test_quality_learns(spark, frame):
    r = random.Random(1)
    texts = []
    for i in range(300):
        w = words(r, r.randrange(8, 120))
        texts.append(" ".join(w) if i % 3 else " ".join(x + "%%%" for x in w))
    texts += [None, "", "a " * 5000]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(texts).withColumn("score", F.lit(9))
    rows = {x.doc_id: x for x in quality.digest(docs, labels).collect()}
    assert len(rows) == len(texts) and all(0 <= x.score <= 1 for x in rows.values())
    held = [x for x in rows.values() if x.held_out and x.doc_id < 300]
    assert all(x.held_out == (crc(x.doc_id) % 5 == 0) for x in rows.values())
    assert np.mean([x.predicted == (x.doc_id % 3 > 0) for x in held]) > 0.95
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {k for k, x in rows.items() if x.predicted}


def test_quality_without_labels(spark, frame):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x.score for x in quality.digest(frame(["a", None]), none).collect()} == {0.5}
    assert quality.digest(frame([]), none).collect() == []
    same = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    rows = quality.digest(frame([(None, "x"), (0, "a"), (1, "b"), (1, "b"), (2, "c")]), same).collect()
    assert len(rows) == 5 and {x.score for x in rows} == {1.0}


def test_chunks_cover_texts():
    for n in (0, 1, 255, 256, 257, 480, 481, 3000):
        data = (np.arange(n) % 251).astype(np.uint8)
        x, counts = quality.chunks(np.array([0, n]), data)
        assert counts.tolist() == [len(x)]
        seen = set()
        for i, row in enumerate(x):
            start = min(i * (quality.CHUNK - quality.OVERLAP), max(0, n - quality.CHUNK))
            size = int((row != quality._PAD).sum())
            assert row[:size].tolist() == data[start : start + size].tolist()
            seen |= set(range(start, start + size))
        assert seen == set(range(n))


def test_quality_gradients():
    r = np.random.default_rng(0)
    net = quality.Network()
    x = r.integers(0, 257, (5, quality.CHUNK)).astype(np.int16)
    pull = r.standard_normal(5)
    g = net.gradients(x, lambda e: pull)
    for name in net.p:
        at = tuple(r.integers(0, s) for s in net.p[name].shape)
        if name == "embed":
            at = (int(x[0, 3]), 2)
        kept = net.p[name].astype(np.float64).copy()
        values = []
        for step in (1e-3, -1e-3):
            net.p[name] = kept.copy()
            net.p[name][at] += step
            values.append(float(net.evidence(x).astype(float) @ pull))
        net.p[name] = kept.astype(np.float32)
        assert abs((values[0] - values[1]) / 2e-3 - g[name][at]) < 0.05 + 0.05 * abs(g[name][at]), name


def test_language(spark, frame):
    r = random.Random(2)
    stems = {"aa": ["the", "ing", "tion"], "bb": ["der", "ich", "ung"], "cc": ["que", "ción", "ado"], "dd": ["été", "eau", "oux"]}
    rows = []
    for i in range(400):
        lang = list(stems)[i % 4]
        rows.append((i, " ".join("".join(r.choice(stems[lang]) for _ in range(3)) for _ in range(r.randrange(3, 40))), lang))
    rows += [(400, None, "aa"), (401, "", None), (402, "12 !? ...", "bb"), (403, "thetheing", None), (None, "derich", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    got = {x.doc_id: x for x in langid.digest(docs).collect()}
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got.values())
    assert all(got[i].lang_pred == "und" for i in (400, 401, 402)) and got[403].lang_pred == "aa"
    held = [x for x in got.values() if x.held_out and x.doc_id < 400]
    assert len(held) > 50 and all((x.lang_pred == rows[x.doc_id][2]) for x in held)
    assert all(x.held_out == (crc(k) % 4 == 2) for k, x in got.items() if k is not None)


def test_language_without_training_rows(spark, frame):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [x.lang_pred for x in langid.digest(docs).collect()] == ["und"]
    assert langid.digest(docs.filter("false")).collect() == []
    one = spark.createDataFrame([(1, "abc", "xx"), (3, "abd", "xx")], "doc_id long, text string, lang string")
    assert {x.lang_pred for x in langid.digest(one).collect()} == {"xx"}


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 7, 20])
def test_codewords_differ(k):
    code = langid.codewords(k)
    assert len(code) == k and len({tuple(c) for c in code.tolist()}) == k and set(np.unique(code)) <= {-1, 1}
    apart = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert not apart or min(apart) >= max(1, code.shape[1] // 6)


def test_base_scores(frame, corpus):
    want = brute.base_scores(list(enumerate(corpus)), lambda k: crc(k) % 10)
    rows = lm.digest(frame(corpus)).collect()
    for x in rows:
        n, known, total, base = want[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total)
        assert abs(x.base_score - base) <= 1e-9 * abs(base) and x.held_out == (crc(x.doc_id) % 10 == 0)
        assert np.isfinite(x.score) and x.score < 0
    assert len(rows) == len(corpus)


def test_rare_words_by_shuffle(frame, corpus, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 30)
    monkeypatch.setattr(lm, "OWN", 10)
    want = brute.base_scores(list(enumerate(corpus)), lambda k: crc(k) % 10)
    for x in lm.digest(frame(corpus)).collect():
        assert abs(x.base_score - want[x.doc_id][3]) <= 1e-9 * abs(want[x.doc_id][3]) and x.n_known == want[x.doc_id][1]


def test_contexts_help(frame):
    r = random.Random(6)
    follow = {f"w{i}": [f"w{(i * 7 + j) % 50}" for j in range(2)] for i in range(50)}
    texts = []
    for _ in range(300):
        at = f"w{r.randrange(50)}"
        line = [at]
        for _ in range(40):
            at = r.choice(follow[at])
            line.append(at)
        texts.append(" ".join(line))
    rows = [x for x in lm.digest(frame(texts)).collect() if x.held_out]
    assert rows and all(x.score > 0.4 * x.base_score for x in rows)


def test_tree_probabilities_add_up(frame):
    r = random.Random(7)
    texts = [" ".join(r.choice(["a", "b", "cc", "dd", "e"]) for _ in range(60)) for _ in range(80)]
    texts = [t.replace("a b", "a b e") for t in texts]
    import pyarrow as pa

    from gradeframe.llm import text as tx

    train = frame(texts).select("text")
    w = tx.words(*tx.buffer(pa.array(texts)), tx.LOWER_WORDS)
    h, n = np.unique(tx.hashes(w), return_counts=True)
    own_n, ends = n.astype(float), len(texts)
    root = np.concatenate([[1e-9], [ends + 0.1], np.full(lm.CLASSES, 0.1), own_n + 0.1])
    tree = lm.grow(train, lm.Tree(h, np.log10(root / root.sum())), int(n.sum()) + ends)
    assert sum(map(len, tree.contexts)) > 0
    for history in ([0], [0, 1026], [0, 1026, 1027], [0, 1027, 1026, 1027], [0, 1028, 1028]):
        sym = np.concatenate([np.append(history, s) for s in range(tree.size)])
        place = np.tile(np.arange(len(history) + 1), tree.size)
        p = 10.0 ** tree.log10(sym, place)[place == len(history)]
        assert abs(p.sum() - 1) < 1e-4


def test_scores_of_odd_tables(frame, odd_rows):
    assert lm.digest(frame([])).collect() == []
    rows = lm.digest(frame(odd_rows)).collect()
    assert len(rows) == len(odd_rows) and {x.n_tokens for x in rows if x.doc_id == 3} == {1}
    held = [i for i in range(100) if crc(i) % 10 == 0][:3]
    rows = lm.digest(frame([(i, "a b") for i in held])).collect()
    assert all(x.train_tokens == 0 and x.n_known == 0 and np.isfinite(x.score) for x in rows)


def test_contexts_at_any_share_and_of_rare_words(frame):
    r = random.Random(11)
    # all words end alike, so that none has a class of its own; 1,500 are more frequent than the pair below
    texts = [" ".join(f"w{r.randrange(1500)}ab" for _ in range(300)) for _ in range(300)]
    rare = [(i, "rareab nextab lastab") for i in range(1000, 1040)]
    rows = lm.digest(frame([*enumerate(texts), *rare])).collect()
    held = [x for x in rows if x.held_out and x.doc_id >= 1000]
    # three words and the end, each near certain after the one before
    assert held and all(x.score > x.base_score + 9 for x in held)


def test_states_in_parts_are_those_in_memory(frame, monkeypatch):
    import pyarrow as pa

    from gradeframe.llm import text as tx

    r = random.Random(12)
    texts = [" ".join(r.choice(["a", "b", "cc", "dd", "e"]) for _ in range(60)).replace("a b", "a b e") for _ in range(90)]
    rows = {x.doc_id: x for x in lm.digest(frame(texts, parts=5)).collect()}
    train = [t for i, t in enumerate(texts) if crc(i) % 10]
    w = tx.words(*tx.buffer(pa.array(train)), tx.LOWER_WORDS)
    h, n = np.unique(tx.hashes(w), return_counts=True)
    root = np.concatenate([[0.0], [len(train) + 0.1], np.full(lm.CLASSES, 0.1), n + 0.1])
    root[0] = 1e-9
    tree = lm.grow(frame(train).select("text"), lm.Tree(h, np.log10(root / root.sum())), int(n.sum()) + len(train))
    assert all(len(c) for c in tree.contexts[:2])
    for i, t in enumerate(texts):
        w = tx.words(*tx.buffer(pa.array([t])), tx.LOWER_WORDS)
        sym = np.concatenate([[0], np.searchsorted(h, tx.hashes(w)) + 2 + lm.CLASSES, [1]])
        assert abs(tree.log10(sym, np.arange(len(sym))).sum() - rows[i].score) < 1e-5


def test_tokens_are_the_tokenizers():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from gradeframe.llm import text as tx

    path = tokenizer_path()
    mine, its = packing.WordTokens(path), Tokenizer.from_file(path)
    r = random.Random(3)
    signs = ["a", "Z", "é", "É", "ß", "İ", "ŉ", "Σ", "'", "s", "'ve", "'LL", ".", "!", "“", "—", "<", "|", ">", "<|endoftext|>"]
    signs += ["<|ENDOFTEXT|>", " ", "\n", " ", " ", "̸", "́", "=", "1", "²", "٣", "漢", "👍", "\x00", "\x1f", "ﬁ"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(15))) for _ in range(3000)] + [None]
    for at in range(0, len(texts), 7):
        part = texts[at : at + 7]
        rows, ids = mine.encode(*tx.buffer(pa.array(part)), 1)
        for i, t in enumerate(part):
            assert ids[rows[i] : rows[i + 1]].tolist() == [*its.encode(t or "", add_special_tokens=False).ids, 1], t


def check_packed(rows, capacity=packing.CAPACITY):
    bins = {}
    for x in rows:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(frame, corpus, odd_rows):
    rows = packing.digest(frame(corpus * 3), tokenizer_path()).collect()
    total = sum(x.length for x in rows)
    assert check_packed(rows) == -(-total // packing.CAPACITY)
    assert {(x.doc_id, x.piece) for x in rows} >= {(i, 0) for i in range(3 * len(corpus))}
    assert all(x.start == x.piece * packing.CAPACITY for x in rows)
    assert packing.digest(frame([]), tokenizer_path()).collect() == []
    assert len(packing.digest(frame(odd_rows), tokenizer_path()).collect()) == len(odd_rows)


def test_packing_in_groups(spark):
    r = random.Random(8)
    pieces = [(i, 0, 0, r.randrange(1, 4096), i) for i in range(4000)]
    df = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.place(df, group=300).collect()
    together = len(packing.pack([p[3] for p in pieces]))
    assert len(rows) == 4000 and check_packed(rows) <= together * 1.03 + 1


def test_sequences(frame, corpus):
    path = tokenizer_path()
    placed = packing.place(packing.pieces(frame(corpus), path, with_ids=True))
    want = {x.sequence_id: x.n for x in placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    got = packing.sequences(placed).collect()
    assert {x.sequence_id: len(x.ids) // 4 for x in got} == want


def test_search_empties_bins():
    # best fit leaves a third bin: 4 4 | 3 3 3 | 3
    assert len(packing.best_fit([4, 4, 3, 3, 3, 3], 10)) == 3
    assert len(packing.pack([4, 4, 3, 3, 3, 3], 10)) == 2
    r = random.Random(10)
    for _ in range(200):
        sizes = sorted((r.randrange(20, 60) for _ in range(r.randrange(5, 40))), reverse=True)
        plain = packing.best_fit(sizes, 100)
        for start in (plain, [[i] for i in range(len(sizes))]):
            found = packing.Search(sizes, [list(b) for b in start], 100).run()
            assert sorted(i for b in found for i in b) == list(range(len(sizes)))
            assert all(sum(sizes[i] for i in b) <= 100 for b in found) and len(found) <= len(start)
        assert len(found) <= len(plain) * 1.25 + 1
    assert packing.pack([], 10) == [] and packing.pack([10, 10], 10) == [[0], [1]]


def test_search_goes_on_until_no_step_helps():
    r = random.Random(13)
    sizes = [r.randrange(900, 2200) for _ in range(3000)]
    bins = packing.pack(sizes)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert all(sum(sizes[i] for i in b) <= packing.CAPACITY for b in bins)
    # best fit leaves 6 %, 20,000 pairs of bins about as much
    assert len(bins) <= -(-sum(sizes) // packing.CAPACITY) * 1.045


def test_pieces_that_stay_alone_are_done(spark):
    pieces = [(i, 0, 0, 2500 + i % 100, i) for i in range(2000)]
    df = spark.createDataFrame(pieces, "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.place(df, group=300).collect()
    assert check_packed(rows) == 2000 and {x.sequence_id >> 56 for x in rows} == {0}


def test_licences(frame):
    texts = [
        "Released under the MIT License.",
        "# Licensed under the   Apache License, Version 2.0.\nMore. All rights reserved",
        "Permission is hereby granted, free of charge, to any person obtaining a copy.\n"
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
        "THE SOFTWARE IS PROVIDED 'AS IS', WITHOUT WARRANTY OF ANY KIND.",
        "The software is provided as is without warranty of any kind. Permission is hereby granted free of charge to any person obtaining a copy",
        "no licence here",
        "",
        None,
        "Licensed under CC BY-NC 4.0. x! " * 500,
    ]
    rows = {x.doc_id: x for x in licenses.digest(frame(texts).withColumn("ids", F.lit(1))).collect()}
    assert [rows[i].licences for i in range(8)] == ["MIT", "Apache-2.0,Proprietary", "MIT", "", "", "", "", "CC-BY-NC-4.0"]
    assert [rows[i].kind for i in range(8)] == ["permissive", "restricted", "permissive", *["none"] * 4, "restricted"]
    assert [rows[i].n_sentences for i in (4, 5, 6, 7)] == [1, 0, 0, 1000]
    assert licenses.digest(frame([])).collect() == []


MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright (c) 2020, Someone

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
GPL2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")


def test_licence_texts_in_full(frame):
    texts = [MIT, BSD, APACHE, GPL3, GPL2]
    # a paragraph on one line each
    texts += ["\n\n".join(" ".join(p.split()) for p in t.replace("\n#\n", "\n\n").replace("# ", "").split("\n\n")) for t in texts]
    texts += ["This file is licensed under the MIT License.", "All rights\nreserved"]
    texts += ["no end of the line\nAll rights reserved\nLicensed under CC BY 4.0"]
    rows = {x.doc_id: x for x in licenses.digest(frame(texts)).collect()}
    assert [rows[i].licences for i in range(10)] == ["MIT", "BSD", "Apache-2.0", "GPL-3.0", "GPL"] * 2
    assert [rows[i].sentence_ids for i in (0, 1, 2)] == [
        "mit-grant,mit-keep-notice,as-is",
        "bsd-grant,bsd-source,bsd-binary",
        "apache-2-notice,apache-compliance,apache-copy",
    ]
    assert [rows[i].licences for i in range(10, 13)] == ["MIT", "Proprietary", "CC-BY-4.0,Proprietary"]


def test_known_sentences_have_a_sign():
    import re

    assert all(re.search(licenses._SIGNS, s) for s in licenses.SENTENCES)


def test_rare_contexts_are_not_asked():
    """20 times a b c and once a c b: what followed a and c once is no context of two symbols."""
    index = np.array([0, 1, 2] * 20 + [0, 2, 1])
    text = lm._pack(np.arange(21), np.ones(21, bool), np.full(21, 3), index)
    told = lm._pack(np.full(3, 21), np.arange(3) + lm._FIRST_OWN)

    def walked(**least):
        none = np.zeros(0, np.uint64)
        walk = lm._Walk(text, told, lm.Words(none, none, none, np.zeros(lm.CLASSES), 1.3, 2.0, **least), 1)
        asked = []
        for depth in (1, 2):
            walk.down()
            bodies = [(7, depth, b, body) for b, body in walk.asked()]
            asked.append(len(lm._unpack(bodies[0][3])[1]))
            got = lm._settle(depth, 8, -1e9, False)(lm._table(bodies)).to_pylist()
            walk.answered([(r["bucket"], r["body"]) for r in got])
        return asked, walk.log10

    asked, log10 = walked(least=8)
    every, same = walked()
    assert (asked, every) == ([4, 3], [4, 5])
    assert (log10 == same).all()
