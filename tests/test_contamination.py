import random

import pytest
from pyspark.sql import functions as F

from gradeframe.functions.scores import MIN_K, sequence_loss, target_loglik
from gradeframe.operators import cloze, contamination


def pair_auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    if not pos or not neg:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored():
    rng = random.Random(3)
    rows = [("ties", float(rng.randrange(6)), rng.random() < 0.4) for _ in range(300)]
    rows += [("fine", rng.gauss(0, 1), rng.random() < 0.5) for _ in range(400)]
    # one score holds a third of all rows
    rows += [("hot", 1.5, rng.random() < 0.7) for _ in range(350)]
    rows += [("hot", rng.random() * 3, rng.random() < 0.2) for _ in range(50)]
    rows += [("single", 1.0, True), ("single", 2.0, True)]
    return rows


@pytest.mark.parametrize("blocks", [2, 40, 128])
def test_auc_by_group(spark, scored, blocks):
    df = spark.createDataFrame(scored, "g string, s double, y boolean")
    for n in (1, 7):
        got = contamination.roc_auc(df.repartition(n), "s", "y", ["g"], blocks).collect()
        for r in got:
            want = pair_auc([(s, y) for g, s, y in scored if g == r.g])
            assert r.auc == (want if want is None else pytest.approx(want, abs=1e-12))
        assert {r.g for r in got} == {"ties", "fine", "hot", "single"}


def test_auc_whole_and_negated(spark, scored):
    df = spark.createDataFrame(scored, "g string, s double, y boolean")
    one = contamination.roc_auc(df, "s", "y").first().auc
    other = contamination.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first().auc
    assert one == pytest.approx(pair_auc([(s, y) for _, s, y in scored]))
    assert one + other == pytest.approx(1.0)


def test_min_k_skips_short_sequences(spark):
    lp = [-4.0, -1.0, -3.0, -2.0]
    df = spark.createDataFrame([("u", 1, lp), ("v", 0, [-1.0])],
                               "uuid string, group_label int, token_logprobs array<double>")
    got = {(r.uuid, r.k): r.stat for r in contamination.min_k(df).collect()}
    # int(4 * k): 0, 0, 0, 1, 1, 2, 2
    assert got == {("u", 0.3): 4.0, ("u", 0.4): 4.0, ("u", 0.5): 3.5, ("u", 0.6): 3.5}


def test_min_k_counts_like_python(spark):
    df = spark.createDataFrame(
        [(str(n), 1, [-float(i) for i in range(n)]) for n in range(1, 70)],
        "uuid string, group_label int, token_logprobs array<double>",
    )
    got = {(int(r.uuid), r.k): r.stat for r in contamination.min_k(df).collect()}
    for n in range(1, 70):
        low = sorted(-float(i) for i in range(n))
        for k in MIN_K:
            m = int(n * k)
            if m:
                assert got[n, k] == pytest.approx(-sum(low[:m]) / m)
            else:
                assert (n, k) not in got


def test_sequence_sums(spark):
    df = spark.createDataFrame([([-1.0, -2.0, -3.0],), ([],)], "lp array<double>")
    rows = df.select(
        target_loglik(F.col("lp"), F.lit(2)).alias("t"), sequence_loss(F.col("lp")).alias("l")
    ).collect()
    assert [(r.t, r.l) for r in rows] == [(-5.0, 2.0), (0.0, None)]


CLOZE = (
    "parent_uuid string, choice string, pos int, loglikelihood double, target_length int,"
    " uncond_loglikelihood double, answer_text string"
)


def test_cloze_ties_and_copies(spark):
    rows = [
        ("tie", "x", 0, -1.0, 1, 0.0, "x"),
        ("tie", "y", 1, -1.0, 1, 0.0, "x"),
        # the second x replaces the first one's value and keeps its place
        ("copy", "x", 0, -1.0, 1, 0.0, "y"),
        ("copy", "y", 1, -2.0, 1, 0.0, "y"),
        ("copy", "x", 2, -3.0, 1, 0.0, "y"),
        ("ln", "long", 0, -6.0, 6, -1.0, "long"),
        ("ln", "short", 1, -2.0, 1, 0.0, "long"),
    ]
    df = spark.createDataFrame(rows, CLOZE)

    def best(**norm):
        return {r.parent_uuid: r.prediction for r in cloze.cloze_predict(df, **norm).collect()}

    assert best() == {"tie": "x", "copy": "y", "ln": "short"}
    assert best(length_norm=True)["ln"] == "long"
    got = cloze.cloze_accuracy(cloze.cloze_predict(df, length_norm=True), True).first()
    assert (got.num_hits, got.num_groups) == (3, 3)


def test_missing_unconditional_score_fails(spark):
    cond = spark.createDataFrame([("p", "x", 0, -1.0, 1, 0.0, "x")], CLOZE)
    with pytest.raises(Exception, match="no unconditional score for p"):
        cloze.attach_unconditional(cond, cond.where("false")).collect()
