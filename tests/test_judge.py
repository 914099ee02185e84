import pytest

from gradeframe.operators.judge import parse_judge


def judged(spark, text):
    return parse_judge(spark.createDataFrame([(text,)], "content string")).first()


@pytest.mark.parametrize(
    "value,score,stop",
    [
        ("true", 1.0, True),
        ("false", 0.0, False),
        ('"true"', None, True),
        ('"false"', None, True),  # a non-empty string is truthy
        ("0", 0.0, False),
        ("1", 1.0, True),
        ('""', None, False),
        ('"x"', None, True),
        ("null", None, False),
        ("{}", None, False),
        ('{"a": 1}', None, True),
        ('"3d"', None, True),
        ('" 3 "', 3.0, True),
        ("3.5", 3.5, True),
        ('"4"', 4.0, True),
        ('"0x10"', None, True),
    ],
)
def test_json_values(spark, value, score, stop):
    text = f'ok {{"logic": {{"score": {value}}}, "overall_score": {value}, "stop_conversation": {value}}} .'
    row = judged(spark, text)
    assert (row.logic.score, row.overall_score, row.stop_conversation) == (score, score, stop)


def test_defaults(spark):
    row = judged(spark, '{"accuracy": {"score": 2}}')
    assert (row.accuracy.comment, row.accuracy.score, row.comment) == ("", 2.0, "")
    assert (row.logic.comment, row.logic.score) == ("", None)
    assert (row.overall_score, row.stop_conversation, row.stop_reason) == (None, False, None)
    assert row.parsed


@pytest.mark.parametrize("text", ["no braces", "} {", "{", "{broken", '{"a": }', "{}", "", None])
def test_nothing_to_parse(spark, text):
    row = judged(spark, text)
    assert not row.parsed and row.overall_score is None and row.stop_conversation is False


@pytest.mark.parametrize(
    "text,overall",
    [
        ('{"overall_score": 3,}', 3.0),
        ('{"comment": "see // x, /* y */,}", "overall_score": 3,}', 3.0),
        ('{"overall_score": 3, /* c */ // d\n}', 3.0),
        ("{'overall_score': 2}", 2.0),
        ("{overall_score: 2}", 2.0),
        ('x {"overall_score": 1} y {"overall_score": 2} z', None),
        ('{"overall_score": 1} text {x}', None),
        ('{"overall_score": 1}, {"overall_score": 1}', None),
        ('{"overall_score": +3}', 3.0),
        ('{"comment": "+3 .5 0x3, 3.", "overall_score": .5}', 0.5),
        ('{"overall_score":-.5}', -0.5),
        ('{"overall_score": 3.}', 3.0),
        ('{"overall_score": 3.,}', 3.0),
        ('{"overall_score": 0x3}', 3.0),
        ('{"comment": \'it is 0x3\', "overall_score":-0X1f}', -31.0),
        ('{"overall_score": Infinity}', float("inf")),
        ('{"overall_score": +Infinity}', float("inf")),
        ('{"overall_score": 5e-1}', 0.5),
        ('{"comment": "a\nb", "overall_score": 2}', 2.0),
        ('{"overall_score": 0x1234567890abcdef0123}', float(0x1234567890ABCDEF0123)),
        ('{"overall_score": -0xffffffffffffffffffffffffffffffff}', -float(2**128 - 1)),
        ('{"overall_score": 0x00000000000000000000000000000000000000000000003}', 3.0),
        ('{"overall_score": 0x80000000000000000000000000040000000000000000000001}', float((2**199) + (1 << 86) + 1)),
        ('{"overall_score": 0x80000000000004000000000000000000000000}', float(0x80000000000004 << 96)),
        ('{"overall_score": 0x80000000000004000000000000000000000001}', float((0x80000000000004 << 96) + 1)),
        ('{"overall_score": 1e+2,}', 100.0),
        ('{"overall_score": 1.e2,}', 100.0),
        ('{"overall_score": + 3}', None),
        ('{"overall_score": 0x1.5}', None),
        ('{"overall_score": 3,,}', None),
        ('{"overall_score": 3, /* c */ // d\n ,}', None),
    ],
)
def test_lenient_json(spark, text, overall):
    assert judged(spark, text).overall_score == overall


def test_escapes_of_strings(spark):
    row = judged(spark, r"""{"comment": '\x41\x42 \\x41 \\\x43 it\'s \v\0.', 'stop_reason': "a\
b \q \u00e9", overall_score: 1}""")
    assert row.comment == "AB \\x41 \\C it's \x0b\0."
    assert (row.stop_reason, row.overall_score) == ("ab q \u00e9", 1.0)


def test_commas_inside_strings_stay(spark):
    row = judged(spark, """{"comment": "a,] \\" ,}", 'stop_reason': 'b,}', "overall_score": 1,}""")
    assert (row.comment, row.stop_reason, row.overall_score) == ('a,] " ,}', "b,}", 1.0)


def test_non_object_metric_is_null_and_the_rest_stays(spark):
    row = judged(spark, '{"accuracy": 3, "logic": {"score": 2}, "overall_score": 1}')
    assert (row.accuracy.score, row.logic.score, row.overall_score) == (None, 2.0, 1.0)


def test_strings_keep_their_numbers(spark):
    row = judged(spark, '{"comment": "+3 .5 0x3, 3.", "overall_score": 0x2,}')
    assert (row.comment, row.overall_score) == ("+3 .5 0x3, 3.", 2.0)


def test_names_of_text_scores(spark):
    row = judged(spark, '{"accuracy": {"score": "3"}, "logic": {"score": 3}, "coherence": {"score": null}, "overall_score": "N/A"}')
    assert row.texts == ["accuracy", "overall"] and (row.accuracy.score, row.overall_score) == (3.0, None)
    assert judged(spark, "none").texts == []
