"""Answer extraction and checking for multiple-choice responses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe.functions.text import strip


def choice_key(i: Column, key_type: Column | str = "letters") -> Column:
    """Letter or one-based number of a zero-based choice position."""
    letter, number = F.char(i + 65), (i + 1).cast("string")
    if isinstance(key_type, str):
        return letter if key_type == "letters" else number
    return F.when(key_type == "numbers", number).otherwise(letter)


def _key_array(n: Column, key_type: Column) -> Column:
    positions = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    longest_first = F.sort_array(
        F.transform(positions, lambda i: F.struct((-F.length(i.cast("string"))).alias("l"), i.alias("i")))
    )
    numbers = F.transform(longest_first, lambda s: s["i"].cast("string"))
    letters = F.transform(positions, lambda i: F.char(i + 64))
    return F.when(key_type == "numbers", numbers).otherwise(letters)


def parse_answer(
    text: Column, n_choices: Column | int, key_type: Column | str = "letters"
) -> Column:
    """Position of the chosen key in the key list (longest keys first), null if none is found.

    The stripped text equal to a key wins; otherwise the first key the text contains.
    """
    t = strip(text)
    n = F.lit(n_choices) if isinstance(n_choices, int) else n_choices
    kind = F.lit(key_type) if isinstance(key_type, str) else key_type
    keys = _key_array(n, kind)
    exact = F.nullif(F.array_position(keys, t), F.lit(0).cast("long"))
    hits = F.filter(
        F.transform(keys, lambda k, i: F.when(F.contains(t, k), i)), lambda i: i.isNotNull()
    )
    return F.coalesce((exact - 1).cast("int"), F.get(hits, F.lit(0)))


def is_hit(pred: Column, permutation: Column, answer: Column, failed: int = 0) -> Column:
    """1 if the shown position maps to the answer, 0 if not (a missing answer is met by none),
    ``failed`` without a prediction."""
    shown = F.coalesce(F.get(permutation, pred), pred)
    return F.when(pred.isNull(), F.lit(failed)).otherwise(F.coalesce((shown == answer).cast("int"), F.lit(0)))
