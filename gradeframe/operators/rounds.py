"""Scores over judged rounds: stop handling, per-round and per-conversation statistics.

Conversations are cut into blocks of 4096 rounds (see ``plans.ordered``), so one with a large share
of all rounds is spread over tasks. The round-decayed sums combine exactly: a block's sums
are computed with local positions and scaled by the decay of the valid rounds before the block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.scores import is_mapped, points, valid_score, weight
from gradeframe.plans.ordered import BLOCK, before, int_block, positions
from gradeframe.schemas import METRICS

ALL_METRICS = [*METRICS, "overall"]


def metric_score(metric: str) -> Column:
    return F.col("overall_score") if metric == "overall" else F.col(metric)["score"]


def metric_value(metric: str) -> Column:
    """The score that counts: metrics only within range, the overall score as it is."""
    score = metric_score(metric)
    return score if metric == "overall" else valid_score(score)


def capped(rounds: DataFrame, max_rounds: int | None) -> DataFrame:
    return rounds if max_rounds is None else rounds.where(F.col("round") < max_rounds)


def until_stop(
    rounds: DataFrame, max_rounds: int | None = None, keys: Sequence[str] = ("conv_id",)
) -> DataFrame:
    """Rounds up to and including the first stop: the least stop round of each conversation, taken
    before anything is shuffled, is joined back."""
    rows, keys = capped(rounds, max_rounds), list(keys)
    stops = rows.where("stop_conversation").groupBy(*keys).agg(F.min("round").alias("_first"))
    joined = rows.join(stops, keys, "left")
    return joined.where("_first IS NULL OR round <= _first").select(*rounds.columns)


def last_round(rounds: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Round number, overall score and stop fields of each conversation's last round."""
    fields = ["round", "overall_score", "stop_conversation", "stop_reason"]
    last = F.max_by(F.struct(*fields), "round")
    return rounds.groupBy(*keys).agg(last.alias("_l")).select(*keys, "_l.*")


def active(rounds: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Conversations without a stop so far, with the number of their next round."""
    state = rounds.groupBy(*keys).agg(
        F.bool_or("stop_conversation").alias("_stopped"), F.max("round").alias("_last")
    )
    return state.where(~F.col("_stopped")).select(*keys, (F.col("_last") + 1).alias("next_round"))


def stopped_count(rounds: DataFrame) -> DataFrame:
    state = rounds.groupBy("conv_id").agg(F.bool_or("stop_conversation").alias("_stopped"))
    return state.agg(
        F.count_if("_stopped").alias("stopped"), F.count(F.lit(1)).alias("conversations")
    )


def valid_positions(
    rounds: DataFrame, metric: str, keys: Sequence[str] = ("conv_id",)
) -> DataFrame:
    """Rows with a valid score of one metric and their position among these."""
    rows = rounds.select(*keys, "round", metric_value(metric).alias("value"))
    valid = F.col("value").isNotNull()
    placed = positions(rows, list(keys), ["round"], int_block(F.col("round")), "position", valid)
    return placed.where(valid)


def _metric_rows(exprs: dict[str, list[Column]]) -> Column:
    """One row per metric from the wide columns of an aggregate."""
    rows = [F.struct(F.lit(m).alias("metric"), *cols) for m, cols in exprs.items()]
    return F.inline(F.array(*rows))


def round_stats(rounds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per round and metric: valid values, mean, min, max; a metric without values has no row.

    Six metrics are aggregated side by side, so no row is multiplied before the shuffle.
    """
    aggs = []
    for m in ALL_METRICS:
        v = metric_value(m)
        aggs += [
            F.count(v).alias(f"{m}_n"),
            F.avg(v).alias(f"{m}_mean"),
            F.min(v).alias(f"{m}_min"),
            F.max(v).alias(f"{m}_max"),
        ]
    names = {"n": "nonempty_values", "mean": "mean", "min": "min", "max": "max"}
    wide = rounds.groupBy(*by, "round").agg(*aggs)
    long = wide.select(
        *by,
        "round",
        _metric_rows(
            {m: [F.col(f"{m}_{k}").alias(n) for k, n in names.items()] for m in ALL_METRICS}
        ),
    )
    return long.where(F.col("nonempty_values") > 0)


def round_histogram(rounds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How often each valid score occurs per round and metric."""
    rows = rounds.select(
        *by, "round", _metric_rows({m: [metric_value(m).alias("score")] for m in ALL_METRICS})
    )
    return (
        rows.where(F.col("score").isNotNull())
        .groupBy(*by, "round", "metric", "score")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _score_columns(strict: bool, rounds: DataFrame) -> list[Column]:
    """The score of each metric that enters the decay. Strict mode takes any score; one that was given
    as text is not a number there, whatever it spells, and counts as an unmapped one."""
    if not strict:
        return [metric_value(m).alias(m) for m in ALL_METRICS]
    if "texts" not in rounds.columns:
        return [metric_score(m).alias(m) for m in ALL_METRICS]
    unmapped = F.lit(float("nan"))
    return [
        F.when(F.array_contains("texts", m), unmapped).otherwise(metric_score(m)).alias(m)
        for m in ALL_METRICS
    ]


def block_sums(
    rounds: DataFrame,
    max_rounds: int | None = None,
    keys: Sequence[str] = ("conv_id",),
    strict: bool = False,
) -> DataFrame:
    """Per conversation and block the sums that combine: one shuffle, one sort, no unpivoting."""
    keys = list(keys)
    rows = capped(rounds, max_rounds).select(
        *keys,
        int_block(F.col("round")).alias(BLOCK),
        "round",
        F.col("stop_conversation").alias("_stop"),
        *_score_columns(strict, rounds),
    )
    earlier = before([*keys, BLOCK], ["round"])
    rows = rows.select(
        "*",
        F.coalesce(F.max("_stop").over(earlier), F.lit(False)).alias("_over"),
        *[F.count(m).over(earlier).alias(f"{m}_at") for m in ALL_METRICS],
    ).where(~F.col("_over"))
    aggs = [F.count(F.lit(1)).alias("rounds"), F.bool_or("_stop").alias("stopped")]
    for m in ALL_METRICS:
        value, at = F.col(m), F.col(f"{m}_at")
        number = F.when(~F.isnan(value), value)
        decay = F.when(value.isNotNull(), weight(at))
        aggs += [
            F.count(value).alias(f"{m}_n"),
            F.min(number).alias(f"{m}_min"),
            F.max(number).alias(f"{m}_max"),
            F.sum(number).alias(f"{m}_sum"),
            F.sum(decay).alias(f"{m}_w"),
            F.sum(points(value) * decay).alias(f"{m}_s"),
            F.count_if(value.isNotNull() & ~is_mapped(value)).alias(f"{m}_odd"),
        ]
    return rows.groupBy(*keys, BLOCK).agg(*aggs)


def merge_blocks(blocks: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """Block sums of consecutive blocks to the sums of all of them, in the same columns."""
    keys = list(keys)
    earlier = before(keys, [BLOCK])
    rows = blocks.select(
        "*",
        F.coalesce(F.max("stopped").over(earlier), F.lit(False)).alias("_over"),
        *[F.coalesce(F.sum(f"{m}_n").over(earlier), F.lit(0)).alias(f"{m}_off")
          for m in ALL_METRICS],
    ).where(~F.col("_over"))
    aggs = [F.sum("rounds").alias("rounds"), F.bool_or("stopped").alias("stopped")]
    for m in ALL_METRICS:
        shift = weight(F.col(f"{m}_off"))
        aggs += [
            F.sum(f"{m}_n").alias(f"{m}_n"),
            F.min(f"{m}_min").alias(f"{m}_min"),
            F.max(f"{m}_max").alias(f"{m}_max"),
            F.sum(f"{m}_sum").alias(f"{m}_sum"),
            F.sum(F.col(f"{m}_w") * shift).alias(f"{m}_w"),
            F.sum(F.col(f"{m}_s") * shift).alias(f"{m}_s"),
            F.sum(f"{m}_odd").alias(f"{m}_odd"),
        ]
    return rows.groupBy(*keys).agg(*aggs)


def combine_blocks(
    blocks: DataFrame, keys: Sequence[str] = ("conv_id",), strict: bool = False
) -> DataFrame:
    """Block sums to one row per conversation: rounds, stopped and per metric n, min, max, mean,
    score (null without a valid value; in strict mode also with an unmapped score)."""
    keys = list(keys)
    wide = merge_blocks(blocks, keys)
    out = [F.col("rounds"), F.col("stopped")]
    for m in ALL_METRICS:
        score = F.try_divide(F.col(f"{m}_s"), F.col(f"{m}_w")) * 10.0
        if strict:
            score = F.when(F.col(f"{m}_odd") == 0, score)
        out += [F.col(f"{m}_{k}") for k in ("n", "min", "max")]
        out += [
            F.try_divide(F.col(f"{m}_sum"), F.col(f"{m}_n")).alias(f"{m}_mean"),
            score.alias(f"{m}_score"),
        ]
    return wide.select(*keys, *out)


def conversation_wide(
    rounds: DataFrame,
    max_rounds: int | None = None,
    keys: Sequence[str] = ("conv_id",),
    strict: bool = False,
) -> DataFrame:
    return combine_blocks(block_sums(rounds, max_rounds, keys, strict), keys, strict)


def conversation_scores(
    rounds: DataFrame,
    max_rounds: int | None = None,
    keys: Sequence[str] = ("conv_id",),
    strict: bool = False,
) -> DataFrame:
    """Per conversation and metric min, max, mean and round-decayed score, up to the first stop."""
    wide = conversation_wide(rounds, max_rounds, keys, strict)
    parts = ("min", "max", "mean", "score")
    return wide.select(
        *keys,
        _metric_rows({m: [F.col(f"{m}_{p}").alias(p) for p in parts] for m in ALL_METRICS}),
    )


def run_scores(conversations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per metric over the conversations that have a score: count, mean, min, max."""
    return conversations.groupBy(*by, "metric").agg(
        F.count("score").alias("nonempty_values"),
        F.avg("score").alias("mean"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )
