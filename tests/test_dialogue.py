import json
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeframe.functions import messages as msg
from gradeframe.operators import dialogue
from gradeframe.operators.inference import infer, pending, register_responder
from gradeframe.plans.dialogue_loop import run_dialogue
from gradeframe.schemas import RESPONSES, conform
from gradeframe.session import shared_dir


def chat(reply):
    def run(batches):
        for pdf in batches:
            text = [reply(u, list(m)) for u, m in zip(pdf["uuid"], pdf["messages"])]
            yield pd.DataFrame({"uuid": pdf["uuid"], "generated_text": text})

    return run


def never(batches):
    for pdf in batches:
        raise RuntimeError("model called")
    yield pd.DataFrame()


def seeds(spark, n=3):
    rows = [(f"c{i}", [("system", "s"), ("user", f"q{i}")]) for i in range(n)]
    df = spark.createDataFrame(rows, "conv_id string, m array<struct<role:string,content:string>>")
    return df.select("conv_id", *[F.col("m").alias(r) for r in ("interactor", "candidate", "evaluator")])


def verdict(uuid, messages):
    return json.dumps({"overall_score": 2, "stop_conversation": uuid == "c1"})


RESPONDERS = {
    "interactor": chat(lambda u, m: f" ask {len(m)} "),
    "candidate": chat(lambda u, m: f"say {m[-1]['content']}"),
    "evaluator": chat(verdict),
}


#: The roles' run keys, whatever function stands in for them.
KEYS = {role: f"model of the {role}" for role in RESPONDERS}


def test_dialogue_rounds_and_stop(spark, tmp_path):
    turns, judged = run_dialogue(seeds(spark), RESPONDERS, max_rounds=2, out=str(tmp_path / "d"), run_keys=KEYS)
    said = {(t.conv_id, t.seq): (t["round"], t.party, t.content) for t in turns.collect()}
    assert said["c0", 0] == (0, "interactor", "ask 2")
    assert said["c0", 1] == (0, "candidate", "say ask 2")
    assert said["c0", 3] == (1, "interactor", "ask 4")
    assert {c for c, s in said if s >= 3} == {"c0", "c2"}
    assert sorted((r.conv_id, r["round"]) for r in judged.collect()) == [
        ("c0", 0), ("c0", 1), ("c1", 0), ("c2", 0), ("c2", 1)]
    again, _ = run_dialogue(seeds(spark), dict.fromkeys(RESPONDERS, never), 2, str(tmp_path / "d"), run_keys=KEYS)
    assert {(t.conv_id, t.seq): (t["round"], t.party, t.content) for t in again.collect()} == said


def test_other_models_settings_and_seeds_are_asked_anew(spark, tmp_path):
    out, given = str(tmp_path / "d"), seeds(spark, 1)

    def first_question(name, rows=given, **kwargs):
        parties = {**RESPONDERS, "interactor": chat(lambda u, m: name)}
        turns, _ = run_dialogue(rows, parties, max_rounds=1, out=out, **kwargs)
        return turns.where("seq = 0").first().content

    assert first_question("one") == "one"
    assert first_question("two") == "two"  # another function without a key of its own is another model
    keyed = {"run_keys": {"interactor": "k"}}
    assert first_question("three", **keyed) == "three" == first_question("four", **keyed)
    assert first_question("five", run_keys={"interactor": "l"}) == "five"
    heat = {"generation": {"interactor": {"heat": "1"}}}
    assert first_question("six", **keyed, **heat) == "six" == first_question("seven", **keyed, **heat)
    other = given.withColumn("interactor", F.array_append("interactor", F.struct(F.lit("user").alias("role"), F.lit("more").alias("content"))))
    assert first_question("eight", other, **keyed) == "eight"


def test_what_was_said_is_not_moved_again(spark, tmp_path, monkeypatch):
    """Requests are put together without an exchange, and a round's files are as large as those of the one before."""
    from gradeframe.plans import dialogue_loop

    plans, real = [], dialogue_loop._requests

    def watched(*args):
        made = real(*args)
        plans.append(made._jdf.queryExecution().executedPlan().toString())
        return made

    monkeypatch.setattr(dialogue_loop, "_requests", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        long = chat(lambda u, m: f"{len(m):04d}" + u * 2000)
        parties = {"interactor": long, "candidate": long, "evaluator": chat(lambda u, m: '{"overall_score": 1}')}
        turns, judged = run_dialogue(seeds(spark, 8), parties, max_rounds=3, out=str(tmp_path / "d"), partitions=3)
        assert turns.count() == 8 * 9 and judged.count() == 8 * 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 9 and not any("Exchange" in p for p in plans)
    files = sorted((tmp_path / "d" / "runs").glob("*/said/*.parquet"), key=lambda f: f.stat().st_mtime)
    assert sum(f.stat().st_size for f in files[-9:]) < 1.3 * sum(f.stat().st_size for f in files[-27:]) / 3
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("gradeframe_")]


def test_a_missing_reply_fails(spark, tmp_path):
    def silent(batches):
        for pdf in batches:
            kept = pdf[pdf["uuid"] != "c1"]
            yield pd.DataFrame({"uuid": kept["uuid"], "generated_text": "x"})

    with pytest.raises(Exception, match="no reply for conversation c1"):
        run_dialogue(seeds(spark, 2), {**RESPONDERS, "candidate": silent}, max_rounds=1, out=str(tmp_path / "d"))


def test_only_new_requests_are_asked(spark, tmp_path):
    def first_two_fail(batches):
        for pdf in batches:
            if set(pdf["uuid"]) & {"c0", "c1"}:
                raise RuntimeError("asked again")
            yield pd.DataFrame({"uuid": pdf["uuid"], "generated_text": '{"overall_score": 1}'})

    out = str(tmp_path / "d")
    first, _ = run_dialogue(seeds(spark, 2), RESPONDERS, max_rounds=1, out=out, commits=3, run_keys=KEYS)
    again, judged = run_dialogue(seeds(spark, 3), dict.fromkeys(RESPONDERS, first_two_fail), max_rounds=1, out=out, run_keys=KEYS)
    kept = {tuple(t) for t in again.where("conv_id != 'c2'").collect()}
    assert kept == {tuple(t) for t in first.collect()} and judged.count() == 3


def test_copies_of_a_conversation_stay(spark, tmp_path):
    twice = seeds(spark, 2).unionByName(seeds(spark, 1))
    turns, judged = run_dialogue(twice, RESPONDERS, max_rounds=1, out=str(tmp_path / "d"))
    assert turns.count() == 9 and sorted(r.row for r in judged.collect()) == ["c0", "c0#2", "c1"]


def test_requests_carry_prompt_and_settings(spark, tmp_path):
    def show(batches):
        for pdf in batches:
            text = [f"{p}|{dict(g)}" for p, g in zip(pdf["prompt"], pdf["generation_config"])]
            yield pd.DataFrame({"uuid": pdf["uuid"], "generated_text": text})

    turns, _ = run_dialogue(
        seeds(spark, 1), {**RESPONDERS, "candidate": show}, max_rounds=1, out=str(tmp_path / "d"),
        post={"candidate": {"remove_system": True}}, generation={"candidate": {"temperature": "0"}})
    said = {t.party: t.content for t in turns.collect()}
    assert said["candidate"] == "q0\n\nask 2|{'temperature': '0'}"


def test_dialogue_ends_when_all_stop(spark, tmp_path):
    stop = {**RESPONDERS, "evaluator": chat(lambda u, m: '{"stop_conversation": true}')}
    turns, judged = run_dialogue(seeds(spark), stop, max_rounds=5, out=str(tmp_path / "d"))
    assert turns.count() == 9 and judged.count() == 3
    with pytest.raises(ValueError):
        run_dialogue(seeds(spark), {"candidate": never})


def test_stored_responses_are_reused(spark):
    calls = chat(lambda u, m: "fresh")
    requests = spark.createDataFrame(
        [(u, [("user", "x")]) for u in "abc"], "uuid string, messages array<struct<role:string,content:string>>")
    stored = conform(spark.createDataFrame(
        [("a", "old", "r"), ("b", "other run", "q"), ("z", "not asked", "r")],
        "uuid string, generated_text string, run_key string"), RESPONSES)
    got = {r.uuid: r.generated_text for r in infer(requests, calls, "r", stored, partitions=2).collect()}
    assert got == {"a": "old", "b": "fresh", "c": "fresh"}
    forced = {r.uuid: r.generated_text for r in infer(requests, calls, "r", stored, force=True).collect()}
    assert set(forced.values()) == {"fresh"}
    assert sorted(r.uuid for r in pending(requests, stored, "r").collect()) == ["b", "c"]


def test_responder_modes_and_registry(spark):
    def losses(batches):
        for pdf in batches:
            yield pd.DataFrame({"uuid": pdf["uuid"], "lm_loss": 0.5, "token_logprobs": [[-1.0]] * len(pdf)})

    register_responder("losses", losses)
    requests = spark.createDataFrame([("a", "p")], "uuid string, prompt string")
    r = infer(requests, "losses", "k").first()
    assert (r.lm_loss, r.token_logprobs, r.generated_text, r.target_length) == (0.5, [-1.0], None, None)
    with pytest.raises(ValueError):
        infer(requests, "unknown", "k")


TURNS = "conv_id string, seq int, round int, party string, content string"


def test_pairs_need_adjacent_turns(spark, small_blocks):
    rows = [("a", 0, 0, "interactor", "q0"), ("a", 1, 0, "candidate", "r0"),
            ("a", 2, 0, "evaluator", "e0"), ("a", 3, 1, "interactor", "q1"),
            ("a", 4, 1, "candidate", "r1"), ("a", 5, 1, "candidate", "lone"),
            ("a", 6, 2, "interactor", "open")]
    rows += [("hot", i, 0, "interactor" if i % 2 == 0 else "candidate", f"t{i}") for i in range(80)]
    turns = spark.createDataFrame(rows, TURNS)
    pairs = dialogue.turn_pairs(turns).collect()
    assert {(p.seq, p["round"]) for p in pairs if p.conv_id == "a"} == {(0, 0), (3, 1)}
    assert {(p.seq, p["round"]) for p in pairs if p.conv_id == "hot"} == {(2 * i, i) for i in range(40)}
    assert dialogue.unpaired_count(turns).first().unpaired == 1
    view = dialogue.role_view(turns.where("conv_id = 'a'"), "evaluator").orderBy("seq").collect()
    assert [(v.seq, v.role) for v in view] == [(1, "user"), (2, "assistant"), (4, "user")]


def test_transcript_filter(spark):
    def verdicts(text):
        return [("c", 0, 0, "interactor", "q"), ("c", 1, 0, "candidate", "r"), ("c", 2, 0, "evaluator", text)]

    def kept(rows, stop=False, lo=0, hi=5):
        df = spark.createDataFrame(rows, TURNS)
        return dialogue.filter_transcripts(df, stop, lo, hi).count() == 1

    assert kept(verdicts('{"comment": "no score"}'))
    assert not kept(verdicts('{"comment": "no score"}'), lo=1)
    assert kept(verdicts('{"overall_score": 3, "stop_conversation": true}'), stop=True)
    assert not kept(verdicts('{"overall_score": 3, "stop_conversation": "false"}'))
    assert not kept(verdicts("{}")) and not kept(verdicts("none")) and not kept(verdicts("{broken"))
    assert not kept(verdicts('{"overall_score": 3}')[:2])


def test_transcript_text(spark):
    text = 'x {"accuracy": {"comment": "fine", "score": 3}, "overall_score": 3.5, "stop_conversation": false, "note": null}'
    df = spark.createDataFrame([("c", 2, 1, "evaluator", text), ("c", 0, 1, "interactor", "hi")], TURNS)
    r = dialogue.render_transcripts(df).first()
    assert (r.interactor, r.candidate) == ("## Interactor(Round 1)\nhi", None)
    assert r.evaluation == ("## Evaluation(Round 1)\n + Accuracy(3): fine\n + Overall_score: 3.5\n"
                            " + Stop_conversation: False\n + Note: None\n")


def test_transcript_text_of_lenient_json(spark):
    text = "{'reasoning': {'comment': 'ok, so,]', score: '4'}, other_key: {score: 1}, accuracy: 2,}"
    df = spark.createDataFrame([("c", 2, 0, "evaluator", text), ("d", 2, 0, "evaluator", "none")], TURNS)
    got = {r.conv_id: r.evaluation for r in dialogue.render_transcripts(df).collect()}
    assert got["c"] == ("## Evaluation(Round 0)\n + Reasoning(4): ok, so,]\n + Other_key(1): \n"
                        " + Accuracy: 2\n")
    assert got["d"] == "## Evaluation(Round 0)\n"


def test_message_edits(spark):
    rows = [([("system", "S "), ("user", "a"), ("assistant", "b")],), ([("user", "c")],), ([],)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>")
    m = F.col("m")
    got = df.select(msg.drop_system(m).alias("d"), msg.fold_system(m).alias("f"), msg.join_text(m, "|").alias("j")).collect()
    assert [[x.content for x in r.d] for r in got] == [["a", "b"], ["c"], []]
    assert [[x.content for x in r.f] for r in got] == [["S a", "b"], ["c"], []]
    assert [r.j for r in got] == ["S |a|b|", "c|", ""]
    empty = spark.createDataFrame([(None, None)], "g string, c array<struct<message:struct<role:string,content:string>>>")
    with pytest.raises(Exception, match="empty response"):
        empty.select(msg.response_text(F.col("g"), F.col("c"))).collect()


def test_shared_folder_comes_from_the_session():
    def session(conf, master, folder=None):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder)
        return SimpleNamespace(conf=conf, sparkContext=context)

    assert shared_dir(session({"spark.checkpoint.dir": "hdfs://x/c/"}, "yarn")) == "hdfs://x/c"
    assert shared_dir(session({}, "yarn", "hdfs://y")) == "hdfs://y"
    with pytest.raises(RuntimeError):
        shared_dir(session({}, "yarn"))
