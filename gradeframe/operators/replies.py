"""Replies found by what was asked: a store of model replies that dialogues and batch runs share.

A reply's key is a digest of the messages, the rendered prompt, the generation settings and the responder's run key, and
nothing else. Another model, other settings or another text therefore never get a stored reply, and requests that are
equal in all of them are asked once, whoever asks. Replies are committed tables: one for each name, in as many parts as
asked for, so that a lost job costs one part of the calls.
"""

from __future__ import annotations

import hashlib
import uuid as ids
from collections.abc import Sequence

from pyspark.serializers import CloudPickleSerializer
from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.operators.inference import Responder, infer, responder
from gradeframe.session import fresh_dir
from gradeframe.sources.commits import Commits

REPLY = "key string, generated_text string, asked string"


def responder_key(fn: str | Responder) -> str:
    """A run key for a responder that has none of its own (``identity.run_key``): a digest of the function as it is sent
    to the workers. A function that is pickled differently is another responder."""
    return hashlib.md5(CloudPickleSerializer().dumps(responder(fn))).hexdigest()


def request_key(run_key: str) -> Column:
    """Digest of what a request asks: columns messages, prompt, generation_config."""
    settings = F.array_sort(F.map_entries("generation_config"))
    asked = F.struct(F.lit(run_key).alias("run_key"), "messages", "prompt", settings.alias("settings"))
    return F.sha2(F.to_json(asked, {"ignoreNullFields": "false"}), 256)


def add_replies(store: Commits, replies: DataFrame, name: str, part: str = "") -> None:
    """Commit (key, generated_text) rows."""
    stamp = F.lit(f"{ids.uuid1().time:020d}")
    store.write(replies.select("key", "generated_text", stamp.alias("asked")), name, part)


def stored_replies(store: Commits, name: str) -> DataFrame:
    """(key, generated_text): one reply per key, the one asked for first where writers have met."""
    rows = store.read(REPLY, name)
    text = F.struct("generated_text")
    first = rows.groupBy("key").agg(F.min_by(text, F.struct("asked", "generated_text")).alias("_r"))
    return first.select("key", "_r.generated_text")


def ask(
    requests: DataFrame,
    fn: str | Responder,
    run_key: str,
    store: Commits,
    name: str,
    commits: int = 1,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(uuid, kept columns, generated_text) of each request; null where the responder gave none.

    ``requests``: unique uuid, messages, prompt, generation_config. Texts stay where they are: what moves is a digest per
    request and the replies.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("key", request_key(run_key))
    path = fresh_dir(spark, "request-keys")
    keyed.select("uuid", "key", *keep).write.parquet(path)
    keys = spark.read.parquet(path)
    todo, anyone = keys.groupBy("key").agg(F.min("uuid").alias("uuid")), True
    if store.records(name):
        todo = todo.join(stored_replies(store, name).select("key"), "key", "left_anti")
        anyone = not todo.isEmpty()
    call = ids.uuid4().hex
    for part in range(commits if anyone else 0):
        mine = todo.where(F.pmod(F.xxhash64("key"), F.lit(commits)) == part) if commits > 1 else todo
        asked = infer(keyed.drop("key").join(mine.select("uuid"), "uuid", "left_semi"), fn, run_key)
        answered = asked.where(F.col("generated_text").isNotNull()).join(mine, "uuid")
        add_replies(store, answered, name, f"{call}-{part}")
    return keys.join(stored_replies(store, name), "key", "left").select("uuid", *keep, "generated_text")
