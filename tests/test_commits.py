"""Committed tables and the store of replies."""

import pandas as pd
import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from gradeframe.operators.replies import add_replies, ask, request_key, responder_key, stored_replies
from gradeframe.sources.commits import Commits


def numbers(df):
    return sorted(r.id for r in df.collect())


def test_a_write_counts_when_it_has_ended(spark, tmp_path):
    store = Commits(spark, str(tmp_path / "s"))
    assert store.records() == [] and store.read("id long", "t").count() == 0
    with pytest.raises(LookupError):
        store.read(name="t")
    store.write(spark.range(3), "t")
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(SparkRuntimeException):
        store.write(broken, "t")
    spark.range(50).write.parquet(f"{store.path}/data/_of=left")
    assert numbers(store.read(name="t")) == [0, 1, 2]


def test_parts_repeats_and_replacement(spark, tmp_path):
    store = Commits(spark, str(tmp_path / "s"))
    for start, part in ((0, "a"), (10, "b"), (0, "a"), (0, "a")):
        store.write(spark.range(start, start + 2), "t", part)
    store.write(spark.range(100, 101), "other")
    assert numbers(store.read(name="t")) == [0, 1, 10, 11] and len(store.records()) == 3
    reader = store.read(name="t")
    store.write(spark.range(7, 8), "t", "c", replace=True)
    assert numbers(store.read(name="t")) == [7] and numbers(store.read()) == [7, 100]
    assert numbers(reader) == [0, 1, 10, 11]  # a reader keeps what it has begun to read
    store.write(spark.range(8, 9), "t", "a")
    assert numbers(store.read(name="t")) == [7, 8]


def requests(spark, rows):
    df = spark.createDataFrame(rows, "uuid string, text string, heat string")
    return df.select(
        "uuid",
        F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"),
        F.col("text").alias("prompt"),
        F.create_map(F.lit("heat"), "heat").alias("generation_config"),
    )


def told(name):
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"uuid": pdf["uuid"], "generated_text": [f"{name} {u}" for u in pdf["uuid"]]})

    return run


def asked(spark, store, rows, name, key="k", commits=1):
    got = ask(requests(spark, rows), told(name), key, store, "t", commits=commits).collect()
    return {r.uuid: r.generated_text for r in got}


def test_what_is_equal_is_asked_once(spark, tmp_path):
    store = Commits(spark, str(tmp_path / "s"))
    assert asked(spark, store, [("a", "x", "0"), ("b", "y", "0"), ("c", "x", "0")], "1", commits=2) == {
        "a": "1 a", "b": "1 b", "c": "1 a"}
    # other names for the same requests get their replies; another text or heat does not
    assert asked(spark, store, [("d", "x", "0"), ("e", "x", "1"), ("f", "z", "0"), ("g", None, None)], "2") == {
        "d": "1 a", "e": "2 e", "f": "2 f", "g": "2 g"}
    assert asked(spark, store, [("d", "x", "0")], "3", key="other") == {"d": "3 d"}
    assert asked(spark, store, [], "4") == {}


def test_two_writers_of_one_reply(spark, tmp_path):
    """Both have found nothing and asked; the first reply is everyone's."""
    store = Commits(spark, str(tmp_path / "s"))
    key = requests(spark, [("a", "x", "0")]).select(request_key("k").alias("key"))
    for text in ("early", "late"):
        add_replies(store, key.withColumn("generated_text", F.lit(text)), "t", text)
    assert [r.generated_text for r in stored_replies(store, "t").collect()] == ["early"]
    assert asked(spark, store, [("a", "x", "0"), ("b", "x", "0")], "never") == {"a": "early", "b": "early"}


def test_settings_count_whatever_their_order(spark):
    one = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    two = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    rows = requests(spark, [("u", "x", "0")])
    keys = {rows.withColumn("generation_config", m).select(request_key("k")).first()[0] for m in (one, two)}
    assert len(keys) == 1


def test_functions_are_told_apart():
    assert responder_key(told("a")) == responder_key(told("a")) != responder_key(told("b"))
