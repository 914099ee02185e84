import hashlib
import json
from base64 import urlsafe_b64encode

import pytest
from pyspark.sql import functions as F

from gradeframe.functions import identity
from gradeframe.schemas import as_problems
from gradeframe.templates import prompter


def b64(text):
    return urlsafe_b64encode(hashlib.md5(text.encode()).digest()).rstrip(b"=").decode()


SCHEMA = (
    "problem string, choices array<string>, answer_idx int, answer_text string,"
    " permutation array<int>, extra_json string"
)


def test_uuid_spelling(spark):
    rows = [
        ("Où?", ["a", "b"], 1, None, None, None),
        (None, ["c"], None, "c", None, '{"id": 3}'),
        ("q", ["x", "y", "z"], 2, None, [2, 0, 1], '{"id": "k"}'),
    ]
    df = identity.with_uuid(as_problems(spark.createDataFrame(rows, SCHEMA)))
    assert [r.uuid for r in df.collect()] == [
        b64("Où?$choices$a;b$ans$1$perm$None$ex$null"),
        b64('None$choices$c$ans$c$perm$None$ex${"id": 3}'),
        b64('q$choices$x;y;z$ans$2$perm$[2, 0, 1]$ex${"id": "k"}'),
    ]


def test_fingerprint_ignores_order_and_counts_copies(spark):
    ids = [(f"u{i}",) for i in range(50)]
    a = spark.createDataFrame(ids, "uuid string")
    b = spark.createDataFrame(ids[::-1], "uuid string").repartition(7)
    key = identity.fingerprint(a).first().fingerprint
    assert identity.fingerprint(b).first().fingerprint == key
    assert identity.fingerprint(a.union(a.limit(1))).first().fingerprint != key
    assert identity.fingerprint(a, fewshot=["s"]).first().fingerprint != key
    assert identity.fingerprint(a, system_prompt="x").first().fingerprint != key
    assert len(key) == 22


def test_run_keys():
    chat = {"type": "openai", "inference_kwargs": {"openai_model": "m", "generation_config": {"n": 1}}}
    assert identity.run_key(chat) == b64('$type: openai$openai_model: m$generation_config: {"n": 1}')
    served = {"type": "remote_hf", "inference_kwargs": {"base_url": ["u"]}}
    assert identity.run_key(served, "ctx") == b64(
        "$type: remote_hf$base_url: ['u']$generation_config: {}$prompt_postprocessor_config: {}"
        "$context_hash: ctx"
    )
    local = {"type": "local_hf", "inference_kwargs": {"model_path": "p"}}
    assert identity.run_key(local) == b64("$type: local_hf$kwargs: " + json.dumps({"model_path": "p"}))
    with pytest.raises(ValueError):
        identity.run_key({"type": "other", "inference_kwargs": {}})
    roles = {"interactor": chat, "candidate": served, "evaluator": chat}
    want = "".join(
        f"$role:{r}${identity.run_key(roles[r])}" for r in ("interactor", "candidate", "evaluator")
    )
    assert identity.dialogue_key(roles, "p", "d") == b64(want + "$prompter:p$$mcp:d$")
    assert identity.loss_key("d", "s", "m") == hashlib.md5(b"d_s_m").hexdigest()
    assert identity.role_label(chat) == "openai: m"
    assert identity.role_label(local) == "local_hf: p"


def test_prompter_overlay(caplog):
    plain = prompter()
    same = prompter({"evaluator": {"system_prompt": "default"}})
    assert plain == same
    clear = prompter({"evaluator": {"fewshot_prompt": "clear"}, "nobody": {}})
    assert "nobody" in caplog.text
    assert clear["key"] != plain["key"]
    assert json.loads(clear["evaluator_fewshot_incorrect"])["accuracy"]["score"] == 1
    assert prompter({"mcp_prompt": "qa"})["seed_question"] == "### Question: {problem}\n\n"
    with pytest.raises(KeyError):
        prompter({"evaluator": {"fewshot_prompt": "qa"}})  # has no wrong-answer example


def test_digest_padding(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("s"))
    rows = df.select("s", identity.digest(F.col("s")).alias("d")).collect()
    assert all(r.d == b64(r.s) for r in rows)
