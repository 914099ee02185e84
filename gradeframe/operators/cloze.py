"""Cloze scoring: argmax over the choices' log-likelihoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cloze_score(length_norm: bool = False) -> Column:
    """A response row's log-likelihood, per target token if asked."""
    ll = F.col("loglikelihood")
    return ll / F.col("target_length") if length_norm else ll


def _by_parent(rows: DataFrame) -> DataFrame:
    """Dealt by parent: that satisfies every grouping by (parent, choice) and by parent after it."""
    return rows.repartition("parent_uuid")


def _last_per_choice(rows: DataFrame, extra: list[Column]) -> DataFrame:
    """Copies of a choice text: the last value counts, at the first position."""
    return rows.groupBy("parent_uuid", "choice").agg(
        F.max_by("score", "pos").alias("score"),
        F.min("pos").alias("pos"),
        F.count(F.lit(1)).alias("n"),
        *extra,
    )


def attach_unconditional(
    conditional: DataFrame, unconditional: DataFrame, length_norm: bool = False
) -> DataFrame:
    """Per (parent, choice) the score minus that of the bare choice; a missing one fails."""
    score = cloze_score(length_norm).alias("score")
    gold = F.max_by("answer_text", "pos").alias("answer_text")
    cond = _last_per_choice(
        _by_parent(conditional.select("parent_uuid", "choice", "pos", "answer_text", score)), [gold]
    )
    bare = _last_per_choice(_by_parent(unconditional.select("parent_uuid", "choice", "pos", score)), [])
    bare = bare.select("parent_uuid", "choice", F.col("score").alias("_bare"))
    note = F.concat(F.lit("no unconditional score for "), F.col("parent_uuid"))
    return cond.join(bare, ["parent_uuid", "choice"], "left").select(
        "parent_uuid",
        "choice",
        "pos",
        "n",
        F.when(F.col("_bare").isNull(), F.raise_error(note).cast("double"))
        .otherwise(F.col("score") - F.col("_bare"))
        .alias("score"),
        "answer_text",
    )


def cloze_predict(
    scores: DataFrame, length_norm: bool = False, uncond_norm: bool = False
) -> DataFrame:
    """Per problem the best choice, the gold text and the hit; the first position wins ties.

    ``scores`` holds one row per choice with both likelihoods (parent_uuid, choice, pos,
    loglikelihood, target_length, uncond_loglikelihood, answer_text); both normalizations divide
    by the same target length.
    """
    ll = F.col("loglikelihood")
    if uncond_norm:
        ll = ll - F.col("uncond_loglikelihood")
    if length_norm:
        ll = ll / F.col("target_length")
    gold = F.max_by("answer_text", "pos").alias("answer_text")
    rows = scores.select("parent_uuid", "choice", "pos", "answer_text", ll.alias("score"))
    return best_choice(_last_per_choice(_by_parent(rows), [gold]))


def best_choice(per_choice: DataFrame) -> DataFrame:
    """Argmax per problem over rows (parent_uuid, choice, pos, n copies, score, answer_text)."""
    order = F.struct(F.col("score"), (-F.col("pos")).alias("first"))
    best = per_choice.groupBy("parent_uuid").agg(
        F.max_by("choice", order).alias("prediction"),
        F.max_by("answer_text", "pos").alias("answer_text"),
        F.sum("n").alias("n_choices"),
    )
    return best.withColumn("hit", (F.col("prediction") == F.col("answer_text")).cast("int"))


def cloze_accuracy(
    predictions: DataFrame, length_norm: bool = False, uncond_norm: bool = False
) -> DataFrame:
    """``num_instances`` counts the unrolled rows that the predictions were made of, those without a
    question too where they were used."""
    rows = F.sum("n_choices") * (2 if uncond_norm else 1)
    return predictions.agg(
        F.count_if(F.col("hit") == 1).alias("num_hits"),
        F.count(F.lit(1)).alias("num_groups"),
        rows.alias("num_instances"),
    ).select(
        F.try_divide("num_hits", "num_groups").alias("accuracy"),
        "num_hits",
        "num_groups",
        "num_instances",
        F.lit(length_norm).alias("apply_ln"),
        F.lit(uncond_norm).alias("apply_un"),
    )


def scores_from_responses(problems: DataFrame, responses: DataFrame) -> DataFrame:
    """Stored log-likelihood responses of unrolled choices as (parent_uuid, choice, pos, loglikelihood,
    target_length, uncond_loglikelihood, answer_text), one row per choice.

    ``problems`` are the unrolled choices (uuid, parent_uuid, pos, choices, answer_text). A response
    belongs to the choice by its request's parent and only choice; one without a question is the
    unconditional score. Of several, the one that arrived last counts.
    """
    named = responses.select(
        "parent_uuid",
        F.get("choices", F.lit(0)).alias("choice"),
        F.col("problem").isNull().alias("bare"),
        F.struct("loglikelihood", "target_length").alias("value"),
        "arrival",
    )
    last = {
        kind: F.max_by(F.when(F.col("bare") == bare, F.col("value")), F.when(F.col("bare") == bare, F.col("arrival")))
        for kind, bare in (("asked", False), ("alone", True))
    }
    # a choice's lines mostly stand together: they are one row each before they are moved
    found = named.groupBy("parent_uuid", "choice").agg(*[c.alias(k) for k, c in last.items()])
    rows = problems.select("parent_uuid", F.get("choices", F.lit(0)).alias("choice"), "pos", "answer_text")
    joined = rows.join(found.hint("merge"), ["parent_uuid", "choice"], "left")
    note = F.concat(F.lit("no response for a choice of "), F.col("parent_uuid"))
    asked = F.col("asked.loglikelihood")
    return joined.select(
        "parent_uuid",
        "choice",
        "pos",
        F.when(asked.isNull(), F.raise_error(note).cast("double")).otherwise(asked).alias("loglikelihood"),
        F.col("asked.target_length").alias("target_length"),
        F.col("alone.loglikelihood").alias("uncond_loglikelihood"),
        "answer_text",
    )
