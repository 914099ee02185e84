import json
import random

import pytest

from gradeframe.operators import rounds
from gradeframe.operators.judge import parse_judge
from gradeframe.sources.commits import Commits
from gradeframe.streaming import live


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_accuracy_grows_and_the_last_response_counts(spark, tmp_path):
    problems = spark.createDataFrame(
        [("a", None, None, 0), ("b", None, None, 1), ("b", "a", [1, 0], 0)],
        "uuid string, parent_uuid string, permutation array<int>, answer_idx int")
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        live.live_accuracy(spark, str(src), problems, sink, state, 2).awaitTermination()
        return {r.run_key: r for r in live.read_accuracy(spark, sink).collect()}

    put(src, "1.json", [
        {"run_key": "r", "uuid": "a", "parent_uuid": None, "generated_text": "A", "lm_loss": 1.0},
        {"run_key": "r", "uuid": "unknown", "generated_text": "A"},
        {"run_key": "s", "uuid": "b", "generated_text": "A", "lm_loss": 3.0},
    ])
    first = run()
    assert (first["r"].num_hits, first["r"].num_groups, first["s"].num_hits) == (1, 1, 0)
    put(src, "2.json", [
        {"run_key": "r", "uuid": "a", "parent_uuid": None, "generated_text": "B", "lm_loss": 9.0},
        {"run_key": "r", "uuid": "b", "parent_uuid": "a", "generated_text": "B", "lm_loss": 2.0},
    ])
    second = run()
    r = second["r"]
    assert (r.num_hits, r.num_groups, r.accuracy, r.avg_loss) == (1, 2, 0.5, 5.5)
    assert second["s"].num_groups == 1
    put(src, "3.json", [  # written before the others, found after them
        {"run_key": "r", "uuid": "a", "parent_uuid": None, "generated_text": "A", "lm_loss": 7.0, "written": 1},
        {"run_key": "s", "uuid": "a", "generated_text": "A", "written": 1},
    ])
    third = run()
    assert (third["r"].num_hits, third["r"].avg_loss, third["s"].num_hits, third["s"].num_groups) == (1, 5.5, 1, 2)


def sizes(sink, name):
    """Rows of each part of a table."""
    spark = sink.spark
    return {r["part"]: spark.read.parquet(f"{sink.path}/{r['folder']}").count() for r in sink.records(name)}


def test_a_stream_with_late_copies_equals_the_batch_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 2)
    r = random.Random(1)
    problems = spark.createDataFrame(
        [(f"p{i}", None if i % 3 else "o", None, i % 2) for i in range(20)],
        "uuid string, parent_uuid string, permutation array<int>, answer_idx int")
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    log = []
    for batch in range(6):
        rows = []
        for _ in range(25):
            i = r.randrange(20)
            rows.append({"run_key": f"r{r.randrange(2)}", "uuid": f"p{i}", "parent_uuid": None if i % 3 else "o",
                         "generated_text": r.choice("AB?"), "lm_loss": r.choice([None, 1.0, 2.5]),
                         "written": r.choice([5, 6, 10 + batch]), "arrival": f"{r.randrange(3)}"})
        put(src, f"{batch:02d}.json", rows)
        log += rows
        live.live_accuracy(spark, str(src), problems, sink, state, 2).awaitTermination()
    last = {}
    for at, row in enumerate(log):
        key = (row["run_key"], row["uuid"])
        order = (row["written"], row["arrival"], at)
        if key not in last or order > last[key][0]:
            last[key] = (order, row)
    got = {x.run_key: x for x in live.read_accuracy(spark, sink).collect()}
    for run in ("r0", "r1"):
        rows = [row for (k, _), (_, row) in last.items() if k == run]
        losses = [row["lm_loss"] for row in rows if row["lm_loss"] is not None]
        hits = sum("AB".find(row["generated_text"]) == int(row["uuid"][1:]) % 2 for row in rows)
        assert (got[run].num_groups, got[run].num_hits) == (len(rows), hits)
        assert got[run].avg_loss == pytest.approx(sum(losses) / len(losses))
    store = Commits(spark, sink)
    parts = sizes(store, "keys")
    assert parts[""] <= 40 and len(parts) <= 4 and len(sizes(store, "sums")) <= 4


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    """The checkpoint of the last batch is lost: it comes again, with what it wrote already there."""
    problems = spark.createDataFrame(
        [("a", None, None, 0), ("b", None, None, 1)], "uuid string, parent_uuid string, permutation array<int>, answer_idx int")
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    rounds_sink, rounds_state = str(tmp_path / "rounds"), tmp_path / "rounds-state"

    def run():
        live.live_accuracy(spark, str(src), problems, sink, str(state), 2).awaitTermination()
        live.live_rounds(spark, str(src), rounds_sink, str(rounds_state)).awaitTermination()
        return live.read_accuracy(spark, sink).collect(), live.read_rounds(spark, rounds_sink).collect()

    def line(uuid, text, number):
        return {"run_key": "r", "uuid": uuid, "generated_text": text, "lm_loss": 1.0, "conv_id": "c", "round": number,
                "content": json.dumps({"overall_score": number})}

    put(src, "1.json", [line("a", "A", 0)])
    run()
    put(src, "2.json", [line("a", "B", 1), line("b", "B", 2)])
    before = run()
    for folder in (state, rounds_state):
        for gone in (folder / "commits" / "1", folder / "commits" / ".1.crc"):
            gone.unlink(missing_ok=True)
    assert run() == before
    assert (before[0][0].num_hits, before[0][0].num_groups, before[1][0].rounds) == (1, 2, 3)


def test_runs_of_rounds_are_joined_and_seen_rounds_dropped(spark, tmp_path, monkeypatch, small_blocks):
    monkeypatch.setattr(live, "COMPACT", 2)
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    order = [0, 1, 2, 5, 3, 4, 7]
    for batch, number in enumerate(order):
        again = [{"conv_id": "c", "round": n, "content": json.dumps({"overall_score": 9})} for n in order[:batch]]
        new = [{"conv_id": "c", "round": number, "content": json.dumps({"overall_score": number % 5})}]
        put(src, f"{batch:02d}.json", new + again)
        live.live_rounds(spark, str(src), sink, state).awaitTermination()
        got = live.read_rounds(spark, sink).first()
        rows = [("c", n, json.dumps({"overall_score": n % 5})) for n in order[: batch + 1]]
        want = rounds.conversation_wide(parse_judge(spark.createDataFrame(rows, "conv_id string, round int, content string"))).first()
        assert (got.rounds, got.overall_n) == (want.rounds, want.overall_n)
        assert got.overall_score == pytest.approx(want.overall_score)
    # of the rounds in the snapshot a run for each block of four
    assert sizes(Commits(spark, sink), "runs")[""] == 2


def test_rounds_in_any_order_equal_the_batch(spark, tmp_path, small_blocks):
    rows = []
    for conv, n, stop in (("x", 11, 9), ("y", 3, None), ("z", 6, 1)):
        for i in range(n):
            body = {"accuracy": {"score": (i * 3) % 7}, "overall_score": i % 5, "stop_conversation": i == stop}
            rows.append({"conv_id": conv, "round": i, "content": "v " + json.dumps(body)})
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for name, part in (("1", rows[1::2]), ("2", rows[0::2] + rows[:4])):
        put(src, f"{name}.json", part)
        live.live_rounds(spark, str(src), sink, state).awaitTermination()
    got = {r.conv_id: r for r in live.read_rounds(spark, sink).collect()}
    table = spark.createDataFrame([(r["conv_id"], r["round"], r["content"]) for r in rows],
                                  "conv_id string, round int, content string")
    want = rounds.conversation_wide(parse_judge(table)).collect()
    assert {r.conv_id: (r.rounds, r.stopped) for r in want} == {"x": (10, True), "y": (3, False), "z": (2, True)}
    for w in want:
        g = got[w.conv_id]
        assert (g.rounds, g.stopped, g.accuracy_n) == (w.rounds, w.stopped, w.accuracy_n)
        assert g.accuracy_score == pytest.approx(w.accuracy_score)
        assert g.overall_score == pytest.approx(w.overall_score)


def test_snapshots_stand_in_for_old_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "COMPACT", 2)
    problems = spark.createDataFrame(
        [(f"p{i}", None, None, 0) for i in range(5)],
        "uuid string, parent_uuid string, permutation array<int>, answer_idx int")
    src, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    for i in range(5):
        put(src, f"{i}.json", [{"run_key": f"r{i % 2}", "uuid": f"p{i}", "generated_text": "A", "lm_loss": 1.0}])
        live.live_accuracy(spark, str(src), problems, sink, state, 2).awaitTermination()
    parts = {r["part"] for r in Commits(spark, sink).records("sums")}
    assert parts == {"", "4"}
    got = {r.run_key: r.num_groups for r in live.read_accuracy(spark, sink).collect()}
    assert got == {"r0": 3, "r1": 2}


def test_keys_are_sorted_by_a_hash_and_scored_where_their_problems_are(spark, tmp_path, monkeypatch):
    """Keys begin alike, so that text alone sorts slowly; and after the join with the problems only one move follows."""
    rows = spark.createDataFrame([("k", "1", "r", 1, 1, 0.0, 0), ("k", "2", "r", 0, 1, 0.0, 0)], live._KEYS)
    assert [r.arrival for r in live._newest_keys(rows).collect()] == ["2"]
    assert "xxhash64" in live._newest_keys(rows)._jdf.queryExecution().executedPlan().toString()
    plans, add = [], live._Parts.add

    def told(self, df, batch_id):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        add(self, df, batch_id)

    monkeypatch.setattr(live._Parts, "add", told)
    problems = spark.createDataFrame([("a", None, None, 0)], "uuid string, parent_uuid string, permutation array<int>, answer_idx int")
    put(tmp_path / "in", "1.json", [{"run_key": "r", "uuid": "a", "generated_text": "A"}])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        live.live_accuracy(spark, str(tmp_path / "in"), problems, str(tmp_path / "out"), str(tmp_path / "state"), 4).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # by key, both sides of the join with the problems, and of that with what is known
    assert plans[0].count("Exchange hashpartitioning") == 5
    assert [(r.num_hits, r.num_groups) for r in live.read_accuracy(spark, str(tmp_path / "out")).collect()] == [(1, 1)]


def test_known_keys_are_not_moved(spark, tmp_path, monkeypatch):
    """From the second batch on only lines and problems move, once each, to where the known keys lie."""
    plans, add = [], live._Parts.add

    def told(self, df, batch_id):
        if self.name == "keys":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        add(self, df, batch_id)

    monkeypatch.setattr(live._Parts, "add", told)
    names = [("a/b", "c"), ("a", "b/c"), ("a", ""), ("a", None), ("a/", None), ("a/-", "1"), (None, "a")]
    problems = spark.createDataFrame(
        [(u, p, None, i % 2) for i, (u, p) in enumerate(names)],
        "uuid string, parent_uuid string, permutation array<int>, answer_idx int")
    right = lambda i: "AB"[i % 2]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for batch, text in enumerate([lambda i: "?", right, lambda i: "?", lambda i: right(i) if i else "?"]):
            rows = [{"run_key": run, "uuid": u, "parent_uuid": p, "generated_text": text(i), "lm_loss": float(batch)}
                    for i, (u, p) in enumerate(names) for run in ("r", None)]
            if batch == 2:  # found late, written before all others
                rows = [{**row, "written": 1} for row in rows]
            put(tmp_path / "in", f"{batch}.json", rows)
            live.live_accuracy(spark, str(tmp_path / "in"), problems, str(tmp_path / "out"), str(tmp_path / "state"), 2).awaitTermination()
            got = {(x.run_key, x.num_hits, x.num_groups, x.avg_loss) for x in live.read_accuracy(spark, str(tmp_path / "out")).collect()}
            hits, loss = [(0, 0.0), (6, 1.0), (6, 1.0), (5, 3.0)][batch]
            assert got == {("r", hits, 6, loss), (None, hits, 6, loss)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [p.count("Exchange hashpartitioning") for p in plans[1:]] == [2, 2, 2]
