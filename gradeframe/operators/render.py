"""Prompt rendering over problem rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.answers import choice_key
from gradeframe.functions.messages import message
from gradeframe.functions.text import fill
from gradeframe.templates import CHOICE_TEMPLATES, QUESTION_TEMPLATES


def _permuted() -> Column:
    return F.coalesce(F.size("permutation") > 0, F.lit(False))


def _template(table: dict[str, str], name: str) -> str:
    if name not in table:
        raise ValueError(f"unknown template {name!r}")
    return table[name]


def choices_text(tmpl: str = "default") -> Column:
    """The choice block as shown: keys by position, texts in permuted order."""
    template = _template(CHOICE_TEMPLATES, tmpl)
    shown = F.when(
        _permuted(), F.transform("permutation", lambda i: F.get("choices", i))
    ).otherwise(F.col("choices"))
    lines = F.transform(
        shown,
        lambda x, i: fill(
            template, choice_key=choice_key(i, F.col("choice_key_type")), choice_text=x
        ),
    )
    return F.array_join(lines, "")


def _choice_line(index: Column, text_answer: Column | None, tmpl: str) -> Column:
    slot = F.when(_permuted(), F.get("permutation", index)).otherwise(index)
    key = choice_key(slot, F.col("choice_key_type"))
    text = F.get("choices", index)
    if text_answer is not None:
        key, text = F.coalesce(text_answer, key), F.coalesce(text_answer, text)
    return fill(_template(CHOICE_TEMPLATES, tmpl), choice_key=key, choice_text=text)


def gold_text(tmpl: str = "default") -> Column:
    """The gold answer as a choice line. For a permuted row the key is that of
    ``permutation[answer]``, which differs from the shown position unless the permutation is its
    own inverse; kept that way on purpose."""
    return _choice_line(F.col("answer_idx"), F.col("answer_text"), tmpl)


def prediction_text(tmpl: str = "default") -> Column:
    """The prediction as a choice line, keyed like the gold line."""
    return _choice_line(F.col("prediction_index"), None, tmpl)


def question_text(tmpl: str = "default") -> Column:
    return fill(
        _template(QUESTION_TEMPLATES, tmpl), problem=F.col("problem"), choices=choices_text(tmpl)
    )


#: More examples than this are no few-shot list, and fail the job.
MOST_SHOTS = 1000


def _shots(fewshot: DataFrame, tmpl: str) -> DataFrame:
    """The few-shot list (a handful of rows) in order, as one row of (question, answer) structs."""
    shot = F.struct("ord", question_text(tmpl).alias("q"), gold_text(tmpl).alias("a"))
    listed = F.sort_array(F.collect_list(shot))
    note = F.raise_error(F.lit(f"more than {MOST_SHOTS} few-shot examples"))
    rows = fewshot.limit(MOST_SHOTS + 1).agg(listed.alias("shots"))
    return rows.select(F.when(F.size("shots") > MOST_SHOTS, note).otherwise(F.col("shots")).alias("shots"))


def fewshot_messages(fewshot: DataFrame, tmpl: str = "default") -> Column:
    """Example questions and answers as one message array.

    A scalar subquery: evaluated once and put into the plan as a value, so there is no join.
    """
    pairs = F.transform(
        "shots", lambda s: F.array(message("user", s["q"]), message("assistant", s["a"]))
    )
    return _shots(fewshot, tmpl).select(F.flatten(pairs)).scalar()


def fewshot_block(fewshot: DataFrame, tmpl: str = "default", sep: str = "\n\n") -> Column:
    """Example questions and answers as one text, as a scalar subquery."""
    lines = F.transform("shots", lambda s: F.concat(s["q"], F.lit(sep), s["a"], F.lit(sep)))
    return _shots(fewshot, tmpl).select(F.array_join(lines, "")).scalar()


def conversation(
    tmpl: str = "default", system: str | None = None, shots: Column | None = None
) -> Column:
    """[system?], the messages of the examples, the question."""
    parts = []
    if system:
        parts.append(F.array(message("system", F.lit(system))))
    if shots is not None:
        parts.append(shots)
    parts.append(F.array(message("user", question_text(tmpl))))
    return F.concat(*parts)


def render_prompt(
    problems: DataFrame,
    tmpl: str = "default",
    system: str | None = None,
    fewshot: DataFrame | None = None,
    sep: str = "\n\n",
) -> DataFrame:
    """Fill ``prompt`` where a row brings none.

    Every message is followed by the separator; single-choice rows drop the last one.
    """
    parts = [F.lit(system + sep)] if system else []
    if fewshot is not None:
        parts.append(fewshot_block(fewshot, tmpl, sep))
    last = F.when(F.size("choices") > 1, F.lit(sep)).otherwise(F.lit(""))
    rendered = F.concat(*parts, question_text(tmpl), last)
    return problems.withColumn("prompt", F.coalesce(F.nullif("prompt", F.lit("")), rendered))


def sft_rows(problems: DataFrame, tmpl: str = "default") -> DataFrame:
    """Question and gold answer as input-output pairs."""
    return problems.select(
        question_text(tmpl).alias("instruction"), gold_text(tmpl).alias("output")
    )


def pt_rows(problems: DataFrame, tmpl: str = "default") -> DataFrame:
    """Question and gold answer as one unlabeled text."""
    return problems.select(F.concat(question_text(tmpl), gold_text(tmpl)).alias("instruction"))
