"""Operators that choose or multiply problem rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.identity import with_uuid
from gradeframe.templates import UNCONDITIONAL_PROMPT


#: Where a row of a grouped dataset stands: the number of its part, and inside nested groups theirs.
PART = "part"


def in_order(df: DataFrame, order: str = "ord") -> list[Column]:
    """The columns that rows stand in order by: part, place in it, and the uuid for equal places."""
    return [F.col(c) for c in (PART, order, "uuid") if c in df.columns]


def first_n(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n rows in order."""
    return df.orderBy(*in_order(df, order)).limit(n)


def max_instances(df: DataFrame, n: int = -1, order: str = "ord") -> DataFrame:
    """At most n conversations in order; n <= 0 keeps all."""
    return first_n(df, n, order) if n > 0 else df


def fewshot_sample(df: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """k example rows picked by a seeded hash, the same under any partitioning."""
    return df.orderBy(F.md5(F.concat_ws("$", "uuid", F.lit(str(seed)))), "uuid").limit(k)


def group_union(*parts: DataFrame) -> DataFrame:
    """Datasets one after another, copies kept. ``part`` numbers them, and a part that is a group
    itself keeps its own numbers after its number, so that order runs through nested groups."""

    def numbered(i: int, df: DataFrame) -> DataFrame:
        inner = F.col(PART) if PART in df.columns else F.array().cast("array<int>")
        return df.withColumn(PART, F.concat(F.array(F.lit(i)), inner))

    rows = [numbered(i, df) for i, df in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def permutation(key: Column, n: Column, seed: int | Column) -> Column:
    """A permutation of 0..n-1 in the order of the digests of key$seed$position."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    drawn = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.struct(F.md5(F.concat_ws("$", key, seed.cast("string"), j.cast("string"))).alias("h"), j.alias("j")),
    )
    return F.transform(F.sort_array(drawn), lambda s: s["j"].cast("int"))


def keep_in_place(perm: Column, slot: Column) -> Column:
    """The permutation with a swap that leaves one slot where it was."""
    moved = F.get(perm, slot)
    return F.transform(
        perm, lambda x, i: F.when(i == slot, slot).when(x == slot, moved).otherwise(x)
    )


def augment(problems: DataFrame, n: int = 3, keeps: int = 1, seed: int = 1) -> DataFrame:
    """Originals followed by n permuted copies each; the first ``keeps`` keep the gold slot."""
    return problems.unionByName(augmented_copies(problems, n, keeps, seed))


def augmented_copies(problems: DataFrame, n: int = 3, keeps: int = 1, seed: int = 1) -> DataFrame:
    if keeps > n:
        raise ValueError("keeps must not exceed n")
    copies = problems.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = permutation(
        F.concat_ws("$", "uuid", F.col("_copy").cast("string")), F.size("choices"), seed
    )
    kept = keep_in_place(F.col("permutation"), F.col("answer_idx"))
    return (
        with_uuid(
            copies.withColumn("parent_uuid", F.col("uuid"))
            .withColumn("permutation", drawn)
            .withColumn(
                "permutation", F.when(F.col("_copy") < keeps, kept).otherwise(F.col("permutation"))
            )
            .withColumn("choice_key_type", F.lit("letters"))
            .withColumn("prompt", F.lit(None).cast("string"))
        )
        .select(*problems.columns)
    )


def _gold() -> Column:
    return F.coalesce("answer_text", F.get("choices", F.col("answer_idx")))


def unroll_cloze(problems: DataFrame, unconditional: bool = False) -> DataFrame:
    """One row per choice with the gold text as answer; ``pos`` is the choice's position.

    With ``unconditional`` every choice comes a second time without its question.
    """
    kinds = [F.lit(False), F.lit(True)] if unconditional else [F.lit(False)]
    rows = problems.withColumn("answer_text", _gold()).withColumn("parent_uuid", F.col("uuid"))
    rows = rows.select(
        *[c for c in rows.columns if c != "choices"], F.posexplode("choices").alias("pos", "_choice")
    ).withColumn("unconditional", F.explode(F.array(*kinds)))
    bare = F.col("unconditional")
    rows = (
        rows.withColumn("choices", F.array("_choice"))
        .withColumn("answer_idx", F.lit(None).cast("int"))
        .withColumn("permutation", F.lit(None).cast("array<int>"))
        .withColumn("choice_key_type", F.lit("letters"))
        .withColumn("problem", F.when(~bare, F.col("problem")))
        .withColumn("prompt", F.when(bare, UNCONDITIONAL_PROMPT))
    )
    return with_uuid(rows).select(*problems.columns, "pos", "unconditional")


def unroll_qa(problems: DataFrame) -> DataFrame:
    """The gold text as answer and only choice; the uuid stays that of the original."""
    return (
        problems.withColumn("answer_text", _gold())
        .withColumn("choices", F.array("answer_text"))
        .withColumn("answer_idx", F.lit(None).cast("int"))
        .withColumn("prompt", F.lit(None).cast("string"))
    )


def fewshot_text(fewshot: DataFrame) -> DataFrame:
    """Example rows with the gold text in place of the gold position."""
    return fewshot.withColumn("answer_text", _gold()).withColumn(
        "answer_idx", F.lit(None).cast("int")
    )
