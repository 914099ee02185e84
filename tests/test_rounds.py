"""Round scores against plain Python over lists, with ordinary and with hot conversations."""

import json
import math
import random

import pytest

from gradeframe.operators import board, rounds
from gradeframe.schemas import METRICS

SCHEMA = (
    "conv_id string, round int, "
    + ", ".join(f"{m} struct<comment:string,score:double>" for m in METRICS)
    + ", overall_score double, stop_conversation boolean, stop_reason string"
)
POINTS = {0: 0.0, 1: 1.0, 2: 3.0, 3: 7.0, 4: 10.0}


def row(conv, number, scores, overall, stop, reason="none"):
    cells = [("c", scores.get(m)) for m in METRICS]
    return (conv, number, *cells, overall, stop, reason)


def decayed(values):
    weights = [math.exp(-0.2 * i) for i in range(len(values))]
    return sum(POINTS.get(v, v / 4 * 10) * w for v, w in zip(values, weights)) / sum(weights) * 10


@pytest.fixture(scope="module")
def data():
    rng = random.Random(5)
    rows = []
    for conv, n, p in [("a", 3, 0.0), ("b", 1, 1.0), ("hot", 60, 0.0), ("late", 40, 0.04), ("c", 9, 0.3)]:
        for i in range(n):
            scores = {
                "accuracy": rng.choice([0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, -1.0, None]),
                "logic": rng.choice([0.0, 1.0, 2.5, None]),
                "relevance": float(rng.randrange(5)),
            }
            rows.append(row(conv, i, scores, rng.choice([1.0, 7.0, None]), rng.random() < p))
    rng.shuffle(rows)
    return rows


def by_conversation(data):
    """Rounds up to the first stop."""
    out = {}
    for r in sorted(data, key=lambda r: r[:2]):
        kept = out.setdefault(r[0], [])
        if not (kept and kept[-1][-2]):
            kept.append(r)
    return out


def metric_values(kept, metric):
    if metric == "overall":
        return [r[7] for r in kept if r[7] is not None]
    values = [r[2 + METRICS.index(metric)][1] for r in kept]
    return [v for v in values if v is not None and 0 <= v <= 5]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(5)


def check_until_stop(spark, data):
    got = rounds.until_stop(frame(spark, data)).select("conv_id", "round").collect()
    want = [(c, r[1]) for c, kept in by_conversation(data).items() for r in kept]
    assert sorted((r.conv_id, r.round) for r in got) == sorted(want)


def check_scores(spark, data):
    got = {
        (r.conv_id, r.metric): r for r in rounds.conversation_scores(frame(spark, data)).collect()
    }
    kept = by_conversation(data)
    assert set(got) == {(c, m) for c in kept for m in rounds.ALL_METRICS}
    for (conv, metric), r in got.items():
        values = metric_values(kept[conv], metric)
        if not values:
            assert (r.min, r.max, r.mean, r.score) == (None, None, None, None)
            continue
        assert (r.min, r.max) == (min(values), max(values))
        assert r.mean == pytest.approx(sum(values) / len(values), abs=1e-12)
        assert r.score == pytest.approx(decayed(values), abs=1e-9)


def check_positions(spark, data):
    got = rounds.valid_positions(frame(spark, data), "accuracy").collect()
    want = {}
    for r in sorted(data, key=lambda r: r[:2]):
        value = r[2][1]
        if value is not None and 0 <= value <= 5:
            want[r[0], r[1]] = sum(1 for k in want if k[0] == r[0])
    assert {(r.conv_id, r.round): r.position for r in got} == want


def test_ordinary(spark, data):
    check_until_stop(spark, data)
    check_scores(spark, data)
    check_positions(spark, data)


def test_hot_conversations_in_blocks(spark, data, small_blocks):
    check_until_stop(spark, data)
    check_scores(spark, data)
    check_positions(spark, data)


def test_max_rounds(spark, data):
    got = rounds.until_stop(frame(spark, data), max_rounds=2).collect()
    assert max(r.round for r in got) == 1


def test_constant_scores(spark):
    for score, mapped in POINTS.items():
        data = [row("x", i, {"accuracy": float(score)}, 4.0, False) for i in range(7)]
        scores = {r.metric: r.score for r in rounds.conversation_scores(frame(spark, data)).collect()}
        assert scores["accuracy"] == pytest.approx(mapped * 10)
        assert scores["overall"] == pytest.approx(100)


def test_strict_needs_mapped_scores(spark):
    data = [row("x", 0, {"accuracy": 5.0, "logic": 4.0}, 2.5, False),
            row("x", 1, {"accuracy": 3.0, "logic": 3.0}, 1.0, False)]
    wide = rounds.conversation_wide(frame(spark, data), strict=True).first()
    assert (wide.accuracy_score, wide.overall_score, wide.relevance_score) == (None, None, None)
    assert wide.logic_score == pytest.approx(decayed([4.0, 3.0]))
    loose = rounds.conversation_wide(frame(spark, data)).first()
    assert loose.accuracy_score == pytest.approx(decayed([5.0, 3.0]))
    assert decayed([5.0]) == 125.0


def test_round_stats_and_histogram(spark, data):
    kept = [r for rows in by_conversation(data).values() for r in rows]
    stats = {(r["round"], r.metric): r for r in
             rounds.round_stats(rounds.until_stop(frame(spark, data))).collect()}
    counts = rounds.round_histogram(rounds.until_stop(frame(spark, data))).collect()
    for metric in rounds.ALL_METRICS:
        for number in range(60):
            values = metric_values([r for r in kept if r[1] == number], metric)
            if not values:
                assert (number, metric) not in stats
                continue
            r = stats[number, metric]
            assert (r.nonempty_values, r.min, r.max) == (len(values), min(values), max(values))
            assert r["mean"] == pytest.approx(sum(values) / len(values))
            mine = {c.score: c.n for c in counts if c["round"] == number and c.metric == metric}
            assert mine == {v: values.count(v) for v in values}


def test_state_of_conversations(spark, data):
    kept = by_conversation(data)
    stopped = {c for c, rows in kept.items() if rows[-1][-2]}
    live = rounds.active(rounds.until_stop(frame(spark, data))).collect()
    assert {r.conv_id: r.next_round for r in live} == {
        c: rows[-1][1] + 1 for c, rows in kept.items() if c not in stopped
    }
    counts = rounds.stopped_count(frame(spark, data)).first()
    assert (counts.stopped, counts.conversations) == (len(stopped), len(kept))


def test_board_leaves_out_what_has_no_score(spark):
    data = [("d", "m", *row("x", 0, {"accuracy": 4.0}, 4.0, True, "off_topic")),
            ("d", "m", *row("y", 0, {"accuracy": 6.0}, 2.0, False, None))]
    frame = spark.createDataFrame(data, "dataset string, model string, " + SCHEMA)
    accuracy = spark.createDataFrame([("d", "other", 5.0)], "dataset string, model string, mcp_acc double")
    r = board.leaderboard(accuracy, frame).first()
    assert (r.accuracy, r.overall, r.mcp_acc) == (100.0, 65.0, -100.0)
    assert (r.conversations, r.unscored, r.conversation_completeness) == (2, 2, 1.0)
    assert [(x.stop_reason, x.n) for x in board.stop_reasons(frame).collect()] == [("off_topic", 1)]


def test_interactive_results(spark, data):
    text = board.interactive_results(frame(spark, data), "key", {"candidate": "openai: m"}).first().json
    result = json.loads(text)
    assert (result["hash"], result["roles"]) == ("key", {"candidate": "openai: m"})
    kept = by_conversation(data)
    first = [rows[0] for rows in kept.values()]
    values = metric_values(first, "relevance")
    got = result["rounds"]["0"]["relevance"]
    assert (got["nonempty_values"], got["min"], got["max"]) == (len(values), min(values), max(values))
    assert {float(k): n for k, n in got["counter"].items()} == {v: values.count(v) for v in values}
    assert result["rounds"]["0"]["coherence"] == {} and result["overall"]["coherence"] == {}
    scores = [decayed(v) for v in (metric_values(rows, "overall") for rows in kept.values()) if v]
    assert result["overall"]["overall_score"]["nonempty_values"] == len(scores)
    assert result["overall"]["overall_score"]["mean"] == pytest.approx(sum(scores) / len(scores))
    assert len(result["rounds"]) == max(len(rows) for rows in kept.values())


def test_strict_scores_know_no_text(spark):
    from gradeframe.operators.judge import parse_judge

    texts = ['{"accuracy": {"score": 4}, "logic": {"score": 3}, "overall_score": 2}',
             '{"accuracy": {"score": "N/A"}, "logic": {"score": "3"}, "overall_score": true}',
             '{"accuracy": {"score": 1}, "logic": {"score": 1}, "overall_score": 1}']
    raw = spark.createDataFrame([("x", i, t) for i, t in enumerate(texts)], "conv_id string, round int, content string")
    wide = rounds.conversation_wide(parse_judge(raw), strict=True).first()
    assert (wide.accuracy_score, wide.logic_score) == (None, None) and (wide.accuracy_min, wide.accuracy_max) == (1.0, 4.0)
    assert wide.overall_score == pytest.approx(decayed([2.0, 1.0, 1.0]))
    loose = rounds.conversation_wide(parse_judge(raw)).first()
    assert loose.logic_score == pytest.approx(decayed([3.0, 3.0, 1.0]))
    assert loose.accuracy_score == pytest.approx(decayed([4.0, 1.0]))
