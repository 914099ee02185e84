import pytest
from pyspark.sql import functions as F

from gradeframe.functions.answers import is_hit, parse_answer
from gradeframe.functions.text import json_string, strip
from gradeframe.operators import choice


def parsed(spark, texts, n, kind, as_column=False):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    size = F.lit(n) if as_column else n
    key = F.lit(kind) if as_column else kind
    rows = df.select("i", parse_answer(F.col("t"), size, key).alias("p")).orderBy("i").collect()
    return [r.p for r in rows]


CASES = [
    ("A", 0),
    (" C ", 2),
    ("\tD\n", 3),
    (" B　", 1),
    ("Answer: B", 0),  # the A of Answer comes first
    ("so D.", 3),
    ("(C) C. it is", 2),
    ("b", None),
    ("???", None),
    ("", None),
    (None, None),
    ("E", None),
]


@pytest.mark.parametrize("as_column", [False, True])
def test_letters(spark, as_column):
    texts, want = zip(*CASES)
    assert parsed(spark, texts, 4, "letters", as_column) == list(want)


@pytest.mark.parametrize("as_column", [False, True])
def test_ten_numbers_are_listed_longest_first(spark, as_column):
    # key list: 10, 1, 2, ..., 9
    got = parsed(spark, ["10", "1", "9", "it is 3", "12"], 10, "numbers", as_column)
    assert got == [0, 1, 9, 3, 1]


def test_hit_through_permutation(spark):
    rows = [(0, None, 0), (1, None, 0), (0, [2, 0, 1], 2), (2, [2, 0, 1], 2), (None, [1, 0], 0),
            (None, None, 0)]
    df = spark.createDataFrame(rows, "p int, perm array<int>, a int")
    hit = is_hit(F.col("p"), F.col("perm"), F.col("a"))
    assert [r.h for r in df.select(hit.alias("h")).collect()] == [1, 0, 1, 0, 0, 0]
    late = is_hit(F.col("p"), F.col("perm"), F.col("a"), failed=1)
    assert [r.h for r in df.select(late.alias("h")).collect()][-2:] == [1, 1]


def test_strip_and_json_text(spark):
    import json

    texts = ["plain", 'q"uote', "back\\slash", "é ü", "tab\tnl\n\x01\x7f", "😀 end", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.j for r in df.select(json_string(F.col("t")).alias("j")).collect()]
    assert got == [json.dumps(t) if t != "tab\tnl\n\x01\x7f" else '"tab\\tnl\\n\\u0001\\u007f"'
                   for t in texts]
    df = spark.createDataFrame([(" \t\x1c x y \n",)], "t string")
    assert df.select(strip(F.col("t")).alias("s")).first().s == "x y"


def instances(spark):
    # (uuid, parent, answer, rotation, text): two of three right in group a, one of one in b
    rows = [
        ("a", None, 0, None, "A"),
        ("a1", "a", 0, [1, 2, 3, 0], "D"),
        ("a2", "a", 0, [1, 2, 3, 0], "A"),
        ("b", None, 1, None, "B"),
        ("c", None, 1, None, "none"),
    ]
    schema = "uuid string, parent_uuid string, answer_idx int, permutation array<int>, generated_text string"
    return choice.score_answers(spark.createDataFrame(rows, schema), 4)


@pytest.mark.parametrize(
    "mode,threshold,hits,groups",
    [
        ("strict", None, 1, 3),
        ("mean", None, 3, 5),
        ("ignore_augmented", None, 2, 3),
        ("vote", 0.6, 2, 3),
        ("vote", 0.7, 1, 3),
    ],
)
def test_accuracy_modes(spark, mode, threshold, hits, groups):
    row = choice.mc_accuracy(instances(spark), mode, threshold).first()
    assert (row.num_hits, row.num_groups, row.num_instances) == (hits, groups, 5)
    assert row.accuracy == pytest.approx(hits / groups)
    assert row.aggregate_mode == mode
    sums = choice.mc_predictions(instances(spark), mode, threshold).collect()
    assert sum(r.hits for r in sums) == hits and sum(r.n for r in sums) == groups


def test_accuracy_modes_are_checked(spark):
    with pytest.raises(ValueError):
        choice.mc_accuracy(instances(spark), "median")
    with pytest.raises(ValueError):
        choice.mc_accuracy(instances(spark), "vote")


def test_last_response_wins_and_missing_ones_fail(spark):
    problems = spark.createDataFrame(
        [("u", None), ("u", "p"), ("u", "p"), ("v", None)], "uuid string, parent_uuid string"
    )
    log = spark.createDataFrame(
        [("u", None, "old", 1), ("u", None, "new", 5), ("u", "p", "copy", 2)],
        "uuid string, parent_uuid string, generated_text string, arrival long",
    )
    rows = choice.attach_responses(problems, log, on_missing="null").collect()
    got = sorted((r.uuid, r.parent_uuid or "", r.generated_text or "", r.missing) for r in rows)
    assert got == [
        ("u", "", "new", False),
        ("u", "p", "copy", False),
        ("u", "p", "copy", False),
        ("v", "", "", True),
    ]
    with pytest.raises(Exception, match="no response for problem v"):
        choice.attach_responses(problems, log).collect()
