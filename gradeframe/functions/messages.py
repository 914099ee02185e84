"""Expressions over message arrays and request fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeframe.functions.text import fill, strip
from gradeframe.templates import SYSTEM_WRAPPERS


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def wrap_system(prompt: Column, name: str = "default") -> Column:
    """A prompt inside a named system template."""
    return fill(SYSTEM_WRAPPERS[name], prompt=prompt)


def _leads_with_system(messages: Column) -> Column:
    return F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))


def drop_system(messages: Column) -> Column:
    """Without a leading system message."""
    rest = F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))
    return F.when(_leads_with_system(messages), rest).otherwise(messages)


def fold_system(messages: Column) -> Column:
    """A leading system message put in front of the next message's content."""
    system = F.get(messages, F.lit(0))["content"]
    folded = F.transform(
        F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0))),
        lambda m, i: F.struct(
            m["role"].alias("role"),
            F.when(i == 0, F.concat(system, m["content"])).otherwise(m["content"]).alias("content"),
        ),
    )
    return F.when(_leads_with_system(messages), folded).otherwise(messages)


def to_messages(messages: Column, prompt: Column) -> Column:
    """Given messages, or the prompt as a single user message."""
    return F.coalesce(messages, F.array(message("user", prompt)))


def join_text(messages: Column, sep: str = "\n\n", keep_last: Column | bool = True) -> Column:
    """Message contents one after another, each followed by the separator."""
    keep = F.lit(keep_last) if isinstance(keep_last, bool) else keep_last
    text = F.array_join(F.transform(messages, lambda m: m["content"]), sep)
    return F.concat(text, F.when(keep & (F.size(messages) > 0), F.lit(sep)).otherwise(F.lit("")))


def merge_config(default: Column, row: Column, drop: tuple[str, ...] = ()) -> Column:
    """Row settings over default settings, without the keys the endpoint does not take."""
    empty = F.create_map().cast("map<string,string>")
    row, default = F.coalesce(row, empty), F.coalesce(default, empty)
    kept = F.map_filter(default, lambda k, _: ~F.map_contains_key(row, k))
    merged = F.map_concat(kept, row)
    return F.map_filter(merged, lambda k, _: ~k.isin(*drop)) if drop else merged


def response_text(generated_text: Column, choices: Column) -> Column:
    """The generated text, or the first choice's message content of a chat-style response."""
    text = F.coalesce(generated_text, F.get(choices, F.lit(0))["message"]["content"])
    return F.when(text.isNull(), F.raise_error(F.lit("empty response"))).otherwise(text)


def dialogue_text(generated_text: Column) -> Column:
    return strip(generated_text)
