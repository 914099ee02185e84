"""The Merkle manifest against a plain version, and the versions' own nodes."""

from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeframe.llm import merkle
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.fixture(scope="module")
def table(spark):
    def make(rows, parts=3):
        df = spark.createDataFrame([(i, t, lang, s, n) for i, s, lang, n, t in rows], SCHEMA)
        return df.repartition(parts) if rows else df

    return make


def proofs(docs):
    return sorted((tuple(r[c] for c in NAMES) for r in merkle.digest(docs).collect()), key=repr)


def row(i, lang="en", text=None, source="s"):
    return (i, source, lang, None if text is None else len(text), text)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 600])
def test_one_tree(table, n):
    rows = [row(i, text=f"Text {i}") for i in range(n)]
    assert proofs(table(rows)) == brute.merkle(rows)


def test_many_languages_nulls_and_repeated_rows(table):
    langs = [None, "", "-", "=", "de", "en", "é", "zz", "日本", *(f"l{i}" for i in range(15))]
    rows = [row(i % 40, lang, f"A{i % 7}" if i % 5 else None, "" if i % 3 else None) for i, lang in enumerate(langs * 6)]
    rows += [row(None, "en", "X"), row(None, None, "X"), row(None, "en", "X"), row(None, "en", None)] + [rows[5]] * 30
    docs = table(rows).withColumn("tree", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("_part", F.lit(2))
    got, want = proofs(docs), brute.merkle(rows)
    # equal rows have equal leaves; which of them has which place is open
    assert got == want


def test_a_table_without_rows(table):
    assert merkle.digest(table([])).collect() == []
    assert merkle.Manifest(table([])).versions().collect() == []


def test_blocks_of_blocks(spark):
    docs = spark.range(40_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 39_000, "en").otherwise("de").alias("lang"),
        F.lit("src").alias("source"),
        F.lit(5).cast("long").alias("n_chars"),
        F.concat(F.lit("Doc "), F.col("id").cast("string")).alias("text"),
    )
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert proofs(docs) == brute.merkle(rows)


def test_a_version_has_its_own_ancestors_and_shares_the_rest(table):
    rows = [row(i, "en", f"Text {i}") for i in range(100)] + [row(i, "fr", "T") for i in range(200, 203)]
    docs = table(rows)
    manifest = merkle.Manifest(docs, merkle.tampered_digest())
    folded = {r.doc_id: r for r in manifest.proofs().collect()}
    versions = defaultdict(list)
    for r in manifest.versions().collect():
        versions[r.doc_id].append(r)
    changed = {i for i, r in folded.items() if not r.verified}
    assert set(versions) == changed and 10 < len(changed) < 60
    for doc, own in versions.items():
        own.sort(key=lambda r: r.level)
        levels = merkle.height(100 if doc < 200 else 3) + 1  # of its language, and one above the two languages
        assert [r.level for r in own] == list(range(levels + 1))
        assert own[-1].digest == folded[doc].folded_root
        assert own[0].pos == (doc if doc < 200 else doc - 200) and own[1].pos == own[0].pos // 8


def test_an_unchanged_table_is_verified(table):
    rows = [row(i, "en", f"text {i}") for i in range(70)]
    manifest = merkle.Manifest(table(rows))
    assert all(r.verified for r in manifest.proofs().collect()) and manifest.versions().count() == 0


def test_every_leaf_is_folded_along_its_siblings():
    """Also an unchanged one: with a wrong sibling above its block it does not come to the root."""
    digests = [bytes([i]) * 32 for i in range(3)]
    changed = [None, bytes([9]) * 32, None]
    rows = pa.table(
        {
            "tree": ["=en"] * 3,
            "doc_id": [1, 2, 3],
            "digest": pa.array(digests, pa.binary()),
            "changed": pa.array(changed, pa.binary()),
            "pos": [0, 1, 2],
            "n": [3] * 3,
        }
    )
    subroot = merkle.hashed("".join(d.hex() for d in digests))
    right = "ab" * 32
    root = merkle.hashed(subroot + right)

    def verified(sibling):
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        way = pa.array([[{"left": "", "right": sibling}]], kind)
        told = merkle._proofs(rows, pa.table({"way": way, "subroot": [subroot], "root": [root]}))
        return told.column("verified").to_pylist(), told.column("folded_root").to_pylist()

    assert verified(right)[0] == [True, False, True]
    wrong, folded = verified("cd" * 32)
    assert wrong == [False, False, False] and folded[0] == folded[2] == merkle.hashed(subroot + "cd" * 32)
