import json
import random

import pytest
from pyspark.sql import functions as F

from gradeframe.operators import board, choice, dialogue
from gradeframe.operators.judge import parse_judge
from gradeframe.schemas import RESPONSES, conform
from gradeframe.sources import arrays, benchmarks, files


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_response_lines_in_every_mode(spark, tmp_path):
    lines(
        tmp_path / "all.jsonl",
        [
            {"request": {"uuid": "a", "parent_uuid": None, "answer": 2}, "response": {"generated_text": "x"}},
            {"request": {"uuid": "b", "answer": "t", "choices": ["t"], "problem": None},
             "response": {"loglikelihood": -2.5, "target_length": 3}},
            {"request": {"uuid": "c"}, "response": {"lm_loss": 0.5, "length": 9}},
            {"request": {"uuid": "d"}, "response": {"loglikelihood": [-1.0, -2.0]}},
            {"request": {"uuid": "e", "messages": [{"role": "user", "content": "q"}]},
             "response": {"choices": [{"message": {"role": "assistant", "content": "chat"}}]}},
        ],
    )
    rows = {r.uuid: r for r in files.read_responses(spark, str(tmp_path / "all.jsonl"), "k").collect()}
    assert rows["a"].generated_text == "x" and rows["a"].answer == "2"
    assert (rows["b"].loglikelihood, rows["b"].target_length, rows["b"].choices) == (-2.5, 3, ["t"])
    assert rows["c"].lm_loss == 0.5
    assert rows["d"].token_logprobs == [-1.0, -2.0] and rows["d"].loglikelihood is None
    assert rows["e"].generated_text == "chat" and rows["e"].run_key == "k"
    assert [rows[u].arrival for u in "abcde"] == sorted(r.arrival for r in rows.values())


def test_arrival_follows_the_file_across_splits(spark, tmp_path):
    lines(tmp_path / "all.jsonl", [{"request": {"uuid": f"{i:05d}"}, "response": {"generated_text": "t" * 50}}
                                   for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.read_responses(spark, str(tmp_path / "all.jsonl"))
        assert df.rdd.getNumPartitions() > 5
        rows = sorted(df.select("uuid", "arrival").collect(), key=lambda r: r.arrival)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r.arrival for r in rows}) == 5000
    assert [r.uuid for r in rows] == [f"{i:05d}" for i in range(5000)]


def test_response_store(spark, tmp_path):
    path = str(tmp_path / "store")
    one = conform(spark.createDataFrame([("a", "x"), ("b", "y")], "uuid string, generated_text string"), RESPONSES)
    files.write_responses(one, path, "r1")
    files.write_responses(one.limit(1), path, "r2")
    files.write_responses(one.where("uuid = 'b'"), path, "r1")  # replaces r1 only
    assert [r.uuid for r in files.stored_responses(spark, path, "r1").collect()] == ["b"]
    assert files.stored_responses(spark, path).count() == 2
    plan = files.stored_responses(spark, path, "r2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_key" in plan


def test_response_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "t", 7)], "uuid string, parent_uuid string, generated_text string, arrival long")
    files.write_response_lines(df, str(tmp_path / "out"))
    assert files.read_responses(spark, str(tmp_path / "out")).first().generated_text == "t"


def test_the_later_run_counts_whatever_its_files_are_called(spark, tmp_path):
    """Twenty runs of the same keys, in several files each, with marks and without, by the library and by others."""
    keys = spark.createDataFrame([(f"u{i}", None) for i in range(6)], "uuid string, parent_uuid string")
    problems = keys.repartition(1)
    for run in range(20):
        folder = str(tmp_path / "log" / f"run-{(run * 7) % 20:02d}")
        rows = keys.withColumn("generated_text", F.lit(f"text {run}")).repartition(3)
        if run % 3 == 0:
            mark = F.lit(100 - run).cast("long")  # later runs have lower marks
            files.write_response_lines(rows.withColumn("arrival", mark), folder)
        elif run % 3 == 1:
            files.write_response_lines(rows, folder)
        else:
            rows.select(F.struct("uuid").alias("request"), F.struct("generated_text").alias("response")).write.json(folder)
        log = files.read_responses(spark, str(tmp_path / "log" / "*"))
        told = choice.attach_responses(problems, log).select("generated_text").distinct().collect()
        assert [r.generated_text for r in told] == [f"text {run}"]


def test_marks_order_the_lines_of_one_run(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"t{i}", i) for i in range(40)], "uuid string, generated_text string, arrival long")
    files.write_response_lines(rows.repartition(7), str(tmp_path / "run"))
    log = files.read_responses(spark, str(tmp_path / "run"))
    assert choice.latest(log, ["uuid"], ["generated_text"]).first().generated_text == "t39"
    files.write_response_lines(log.repartition(5), str(tmp_path / "copy"))  # what was read keeps its order
    copy = files.read_responses(spark, str(tmp_path / "copy"))
    assert choice.latest(copy, ["uuid"], ["generated_text"]).first().generated_text == "t39"
    assert sorted(r.mark for r in log.collect())[0] == "0" * 20


NASTY = ['"', "\\", "}", "{", "]", "[", ",", "},{", '\\"', "é", "\n", " ", '"}', "a"]


def test_an_array_is_read_by_many_tasks(spark, tmp_path):
    r = random.Random(4)

    def text():
        return "".join(r.choice(NASTY) for _ in range(r.randrange(12)))

    for name, indent in (("a", None), ("b", 2), ("c", None)):
        rows = [{"uuid": f"{name}{i}", "prompt": text(), "messages": [{"role": "user", "content": text()} for _ in range(r.randrange(3))],
                 "other": {"deep": [[{"x": text()}], {}]}} for i in range(300)]
        separators = (",", ":") if name == "c" else None
        (tmp_path / f"{name}.json").write_text(json.dumps(rows, indent=indent, separators=separators, ensure_ascii=name == "a"))
    (tmp_path / "d.json").write_text(" [ ] ")
    (tmp_path / "e.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        chunks = spark.read.option("lineSep", "}").text(str(tmp_path / "b.json"))
        assert chunks.rdd.getNumPartitions() > 10
        got = arrays.array_objects(spark, str(tmp_path / "*.json")).collect()
        requests = {x.uuid: x for x in files.read_requests(spark, str(tmp_path / "*.json")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 900
    for name in "abc":
        told = sorted((x.pos, x.text) for x in got if x.file.endswith(f"{name}.json"))
        want = json.loads((tmp_path / f"{name}.json").read_text())
        assert [p for p, _ in told] == list(range(300)) and [json.loads(t) for _, t in told] == want
        for w in want:
            g = requests[w["uuid"]]
            assert g.prompt == w["prompt"] and [m.content for m in g.messages] == [m["content"] for m in w["messages"]]


def test_an_array_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    r = random.Random(5)
    rows = [{"uuid": str(i), "deep": [{"x": "".join(r.choice(NASTY) for _ in range(9))} for _ in range(40)]} for i in range(200)]
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps(rows, ensure_ascii=False))
    (tmp_path / "b.json").write_text("[]")
    dirs, fresh = [], arrays.fresh_dir
    monkeypatch.setattr(arrays, "fresh_dir", lambda *a: dirs.append(fresh(*a)) or dirs[-1])
    got = sorted((x.pos, x.text) for x in arrays.array_objects(spark, str(tmp_path / "*.json")).collect())
    assert [json.loads(t) for _, t in got] == rows
    # a row for each object and block, and none for the 8,200 closing braces
    assert sum(spark.read.parquet(d).count() for d in dirs) < 300
    monkeypatch.setattr(arrays, "BLOCK_BYTES", 300)
    again = arrays.array_objects(spark, str(tmp_path / "*.json"))
    assert sorted((x.pos, x.text) for x in again.collect()) == got
    assert spark.read.parquet(dirs[-3]).count() > 200


def test_request_list(spark, tmp_path):
    dump(tmp_path / "r.json", [{"uuid": "a", "prompt": "p"}, {"uuid": "b", "messages": [{"role": "user", "content": "m"}]}])
    rows = files.read_requests(spark, str(tmp_path / "r.json")).orderBy("uuid").collect()
    assert rows[0].prompt == "p" and rows[1].messages[0].content == "m"


def test_results_scan_and_leaderboard_index(spark, tmp_path):
    d = tmp_path / "results"
    dump(d / "m1@d1.json", {
        "simple_multiple_choice:a": {"accuracy": 0.25, "num_hits": 1},
        "simple_multiple_choice:b": {"accuracy": 0.75},
        "interactive_evaluation_step:c": {"hash": "h1", "overall": {}},
    })
    dump(d / "m2@d1.json", {"compute_lm_loss:x": {"avg_loss": 1.0}})
    (d / "notes.txt").write_text("no json")
    index = {r.file: r for r in board.run_index(files.scan_results(spark, str(d))).collect()}
    assert set(index) == {"m1@d1.json", "m2@d1.json"}
    first, second = index["m1@d1.json"], index["m2@d1.json"]
    assert (first.model, first.dataset, first.run_key, first.mcp_acc) == ("m1", "d1", "h1", 25.0)
    assert (second.model, second.run_key, second.mcp_acc) == ("m2", None, -100.0)


def test_transcript_json_to_leaderboard(spark, tmp_path):
    dump(tmp_path / "results" / "m1@d1.json", {"interactive_evaluation_step:c": {"hash": "h1"}})
    verdicts = [{"accuracy": {"score": 4}, "overall_score": 4, "stop_conversation": False},
                {"accuracy": {"score": 3}, "overall_score": 2, "stop_conversation": True, "stop_reason": "off_topic"}]
    said = [{"role": r, "content": f"{r}{i}"} for i in range(2) for r in ("interactor", "candidate", "evaluator")]
    dump(tmp_path / "out" / "interactive_h1" / "interact_details.json",
         [{"uuid": "u", "all_messages": said, "evaluation_results": verdicts, "role_messages": {}}])
    turns, judged = files.read_transcript_json(spark, str(tmp_path / "out" / "*" / "interact_details.json"))
    assert [(t.seq, t["round"], t.party) for t in turns.orderBy("seq").collect()][3:] == [
        (3, 1, "interactor"), (4, 1, "candidate"), (5, 1, "evaluator")]
    index = board.run_index(files.scan_results(spark, str(tmp_path / "results")))
    rows = board.leaderboard(index, board.attach_runs(index, judged)).collect()
    assert len(rows) == 1
    import math
    w = math.exp(-0.2)
    assert rows[0].accuracy == pytest.approx((10 + 7 * w) / (1 + w) * 10)
    assert rows[0].overall == pytest.approx((10 + 3 * w) / (1 + w) * 10)
    assert (rows[0].conversation_completeness, rows[0].mcp_acc) == (2.0, -100.0)


def test_validated_ids(spark, tmp_path):
    dump(tmp_path / "v.json", {"valid_uuids": ["a", "b"], "invalid_uuids": ["b", "c"]})
    ids = files.read_validated(spark, str(tmp_path / "v.json"))
    df = spark.createDataFrame([(u,) for u in "abcde"], "uuid string")
    kept, missing = dialogue.apply_validated(df, ids)
    assert sorted(r.uuid for r in kept.collect()) == ["a", "b"]
    assert sorted(r.uuid for r in missing.collect()) == ["d", "e"]


def test_samples_to_judge_requests(spark, tmp_path):
    said = [{"role": "system", "content": "s"}, {"role": "user", "content": "q1"},
            {"role": "assistant", "content": "a1"}, {"role": "user", "content": "q2"},
            {"role": "assistant", "content": "a2"}, {"role": "user", "content": "more"}]
    sample = {"data": {"model_details": {"role_messages": {"candidate": said}}}}
    for name in ("x.json", "single-x.json", "x.txt"):
        dump(tmp_path / name, sample)
    out = dialogue.judge_requests(files.scan_samples(spark, str(tmp_path))).collect()
    assert [r.file for r in out] == ["x.json"]
    system, user = out[0].messages
    assert system.content == "You are a helpful assistant."
    assert "[Question]\nuser: q1\nassistant: a1\nuser: q2\n\n" in user.content
    assert "[The Start of Assistant's Answer]\na2\n[The End" in user.content


def test_result_and_score_files(spark, tmp_path):
    result = spark.createDataFrame([(0.5, 3)], "accuracy double, num_hits long")
    rows = files.results_json(result, "simple_multiple_choice", 'step "1"').unionByName(
        files.results_json(result, "cloze_prompt", "c"))
    files.write_results(rows, str(tmp_path / "res"))
    text = "".join(p.read_text() for p in (tmp_path / "res").glob("part-*"))
    assert json.loads(text) == {'simple_multiple_choice:step "1"': {"accuracy": 0.5, "num_hits": 3},
                                "cloze_prompt:c": {"accuracy": 0.5, "num_hits": 3}}
    scores = spark.createDataFrame([("d", '{"m": {"overall": 1.0}}')], "dataset string, json string")
    files.write_scores(scores, str(tmp_path / "scores"))
    text = "".join(p.read_text() for p in (tmp_path / "scores").glob("part-*"))
    assert json.loads(text) == {"d": {"m": {"overall": 1.0}}}


def test_prediction_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 2, 3)], "uuid string, hits long, n long")
    files.write_predictions(df, str(tmp_path / "p"), "one")
    files.write_predictions(df, str(tmp_path / "p"), "two")
    assert spark.read.parquet(str(tmp_path / "p")).where("step_name = 'two'").count() == 1
    files.write_choice_predictions(df, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).first().result == [2, 3]


def test_transcript_store(spark, tmp_path):
    turns = spark.createDataFrame([("c", 0, 0, "interactor", "x")], "conv_id string, seq int, round int, party string, content string")
    judged = parse_judge(spark.createDataFrame([("c", 0, '{"overall_score": 1}')], "conv_id string, round int, content string"))
    files.write_transcripts(turns, judged, str(tmp_path / "t"))
    a, b = files.read_transcripts(spark, str(tmp_path / "t"))
    assert a.count() == 1 and b.first().overall_score == 1.0


def test_markdown_row(spark):
    df = spark.createDataFrame([(0.12345, None, 1.0)], "`a.1` double, b double, c double")
    assert files.markdown_row(df, ["a.1", "b", "c"]).first().markdown == " 0.123 | nan | 1.000 |"


def test_benchmark_reading(spark, tmp_path):
    rows = [("train", f"q{i}", ["a", "b"], i % 2) for i in range(4)] + [("test", "t", ["a", "b"], 1)]
    raw = spark.createDataFrame(rows, "split string, question string, choices array<string>, answer int")
    raw.coalesce(1).write.partitionBy("split").parquet(str(tmp_path / "mmlu"))
    test = benchmarks.read_benchmark(spark, str(tmp_path / "mmlu"), "mmlu", split="test")
    assert [(r.problem, r.answer_idx, r.ord, r.extra_json) for r in test.collect()] == [("t", 1, 0, None)]
    parts = [{"path": str(tmp_path / "mmlu"), "kind": "mmlu", "split": s} for s in ("train", "test")]
    both = benchmarks.read_group(spark, parts)
    assert both.count() == 5
    head = benchmarks.read_benchmark(spark, str(tmp_path / "mmlu"), "mmlu", split="train", first=2)
    assert [r.problem for r in head.orderBy("ord").collect()] == ["q0", "q1"]


def test_benchmark_registry(spark):
    raw = spark.createDataFrame([(0, "q", ["a", "b"], "z")], "ord long, question string, answers array<string>, key string")
    with pytest.raises(ValueError):
        benchmarks.normalize(raw, "mine")
    benchmarks.register_benchmark("mine", lambda df: df.select(
        "ord", F.col("question").alias("problem"), F.col("answers").alias("choices"), F.lit(1).alias("answer_idx")))
    row = benchmarks.normalize(raw, "mine").first()
    assert (row.dataset, row.answer_idx, len(row.uuid)) == ("mine", 1, 22)


def test_unknown_label_fails(spark):
    raw = spark.createDataFrame([(0, "q", "a", "b", "c", "d", "E")],
                                "ord long, question string, A string, B string, C string, D string, answer string")
    with pytest.raises(Exception, match="not among the labels: E"):
        benchmarks.normalize(raw, "ceval").collect()


def test_arc_relabels_numbers_for_stop_keys_only(spark):
    rows = [(0, "é\"1", "q", (["x", "y", "z"], ["1", "2", "3"]), "2")]
    raw = spark.createDataFrame(
        rows, "ord long, id string, question string, choices struct<text:array<string>,label:array<string>>, answerKey string")
    r = benchmarks.normalize(raw, "arc_challenge").first()
    assert r.answer_idx == 1
    assert json.loads(r.generation_config["stop_sequences"]) == ["A", "B", "C"]
    assert r.extra_json == json.dumps({"id": 'é"1'})


def test_response_lines_are_compressed_in_files_of_bounded_length(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE_LINES", 10)
    rows = spark.range(40).select(F.col("id").cast("string").alias("uuid"), F.lit(None).cast("string").alias("parent_uuid"), F.lit("A").alias("generated_text"))
    files.write_response_lines(rows.coalesce(1), str(tmp_path / "out"))
    names = [p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]
    assert len(names) == 4 and all(n.endswith(".json.gz") for n in names)
    log = files.read_responses(spark, str(tmp_path / "out"))
    assert [r.uuid for r in log.orderBy("arrival").collect()] == [str(i) for i in range(40)]
    joined = choice.attach_responses(rows.drop("generated_text"), log)
    # a few bytes of file may hold many rows: they are not sent to all tasks
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 40


def test_lines_of_a_choice_are_combined_before_they_move(spark):
    from gradeframe.operators import cloze

    problems = spark.createDataFrame([("p/c", "p", 1, ["c"], "c")], "uuid string, parent_uuid string, pos int, choices array<string>, answer_text string")
    tries = [("p", ["c"], q, float(-n), 2, str(n)) for n in (1, 3, 2) for q in ("Q", None)]
    log = spark.createDataFrame(tries, "parent_uuid string, choices array<string>, problem string, loglikelihood double, target_length int, arrival string")
    scores = cloze.scores_from_responses(problems, log)
    assert [(r.loglikelihood, r.uncond_loglikelihood, r.target_length) for r in scores.collect()] == [(-3.0, -3.0, 2)]
    assert "REPARTITION_BY_COL" not in scores._jdf.queryExecution().executedPlan().toString()
