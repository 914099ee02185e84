"""Multiple-choice scoring: responses onto problems, parsing, accuracy in four modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.answers import is_hit, parse_answer

MODES = ("strict", "mean", "ignore_augmented", "vote")


def originals(df: DataFrame) -> DataFrame:
    return df.where(F.col("parent_uuid").isNull())


def answered(df: DataFrame) -> DataFrame:
    return df.where(F.col("prediction_index").isNotNull())


def empty_count(df: DataFrame) -> DataFrame:
    """How many originals have no parsed answer."""
    return originals(df).agg(
        F.count_if(F.col("prediction_index").isNull()).alias("empty"),
        F.count(F.lit(1)).alias("originals"),
    )


def latest(responses: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key: the response that arrived last."""
    return responses.groupBy(*keys).agg(
        F.max_by(F.struct(*values), F.col("arrival")).alias("_r")
    ).select(*keys, *[F.col("_r")[v].alias(v) for v in values])


def spelled(parent: Column) -> Column:
    """A parent that is never null, so that it can be joined by plain equality."""
    return F.coalesce(F.concat(F.lit("="), parent), F.lit(""))


def attach_responses(
    problems: DataFrame,
    responses: DataFrame,
    values: Sequence[str] = ("generated_text",),
    on_missing: str = "error",
) -> DataFrame:
    """Problems with the last response of their (uuid, parent_uuid); every problem row stays.

    Copies of a problem may share a uuid, so only responses are made unique. A problem without a
    response fails the job, or with ``on_missing='null'`` gets nulls and ``missing``. Responses are
    shuffled once: grouping and join ask for the same partitioning.
    """
    named = responses.withColumn("_uuid", F.col("uuid")).withColumn("_parent", spelled(F.col("parent_uuid")))
    last = latest(named, ["_uuid", "_parent"], list(values)).withColumn("_found", F.lit(True))
    asked = problems.withColumn("_asked", spelled(F.col("parent_uuid")))
    # there are about as many responses as problems, and a compressed file's size tells little of what it holds
    joined = asked.join(
        last.hint("merge"), (F.col("uuid") == F.col("_uuid")) & (F.col("_asked") == F.col("_parent")), "left"
    )
    missing = F.col("_found").isNull()
    if on_missing == "null":
        return joined.withColumn("missing", missing).drop("_uuid", "_parent", "_asked", "_found")
    note = F.concat(F.lit("no response for problem "), F.coalesce("uuid", F.lit("without a uuid")))
    checked = [F.when(missing, F.raise_error(note)).otherwise(F.col(v)).alias(v) for v in values]
    return joined.select(*problems.columns, *checked)


def score_answers(
    df: DataFrame,
    n_choices: int | Column | None = None,
    key_type: str | Column = "letters",
    failed: int = 0,
    parsed: bool = False,
) -> DataFrame:
    """Adds ``prediction_index`` and ``hit`` from generated_text, permutation and answer_idx. With ``parsed`` the rows come
    from ``parse_answers``, which had what it needs before they met their problems."""
    rows = df if parsed else parse_answers(df, F.size("choices") if n_choices is None else n_choices, key_type)
    return rows.withColumn(
        "hit", is_hit(F.col("prediction_index"), F.col("permutation"), F.col("answer_idx"), failed)
    )


def parse_answers(df: DataFrame, n: int | Column, key_type: str | Column = "letters") -> DataFrame:
    return df.withColumn("prediction_index", parse_answer(F.col("generated_text"), n, key_type))


def _group() -> Column:
    return F.coalesce("parent_uuid", "uuid")


def _check(mode: str, threshold: float | None) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    if mode == "vote" and threshold is None:
        raise ValueError("vote needs a threshold")


def mc_predictions(
    scored: DataFrame, mode: str = "mean", threshold: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Per original problem [hits, n]; copies fold into their parent."""
    _check(mode, threshold)
    rows = originals(scored) if mode == "ignore_augmented" else scored
    hit = F.col("hit").cast("long")
    groups = rows.groupBy(*by, _group().alias("uuid"))
    sums = groups.agg(F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("n"))
    if mode == "strict":
        verdict = F.col("hits") == F.col("n")
    elif mode == "vote":
        verdict = F.col("hits") / F.col("n") >= threshold
    else:
        return sums
    return sums.withColumn("hits", verdict.cast("long")).withColumn("n", F.lit(1).cast("long"))


def mc_accuracy(
    scored: DataFrame, mode: str = "mean", threshold: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """accuracy, num_hits, num_groups, num_instances (copies included), aggregate_mode.

    mean and ignore_augmented are micro averages, so they need no grouping by parent at all.
    """
    _check(mode, threshold)
    hit = F.col("hit").cast("long")
    if mode in ("strict", "vote"):
        groups = scored.groupBy(*by, _group().alias("uuid")).agg(
            F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("rows")
        )
        if mode == "strict":
            verdict = F.col("hits") == F.col("rows")
        else:
            verdict = F.col("hits") / F.col("rows") >= threshold
        totals = groups.groupBy(*by).agg(
            F.count_if(verdict).alias("num_hits"),
            F.count(F.lit(1)).alias("num_groups"),
            F.sum("rows").alias("num_instances"),
        )
    else:
        used = F.lit(True) if mode == "mean" else F.col("parent_uuid").isNull()
        totals = scored.groupBy(*by).agg(
            F.sum(F.when(used, hit)).alias("num_hits"),
            F.count_if(used).alias("num_groups"),
            F.count(F.lit(1)).alias("num_instances"),
        )
    return totals.select(
        *by,
        F.try_divide("num_hits", "num_groups").alias("accuracy"),
        "num_hits",
        "num_groups",
        "num_instances",
        F.lit(mode).alias("aggregate_mode"),
    )
