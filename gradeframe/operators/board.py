"""Leaderboard over run results and judged rounds."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.text import json_string
from gradeframe.operators.rounds import (
    ALL_METRICS,
    conversation_scores,
    conversation_wide,
    last_round,
    round_histogram,
    round_stats,
    run_scores,
    until_stop,
)


def split_run_name(name: Column) -> tuple[Column, Column]:
    """``model@dataset.json`` to model and dataset."""
    bare = F.regexp_replace(name, r"\.json$", "")
    return F.split_part(bare, F.lit("@"), F.lit(1)), F.split_part(bare, F.lit("@"), F.lit(2))


def run_index(scanned: DataFrame) -> DataFrame:
    """Per result file: model, dataset, the first multiple-choice accuracy in percent (-100 if
    there is none) and the interactive run's key (the last one).

    A file without an interactive step keeps a null key; it does not take over another file's.
    """
    choice = F.col("key").startswith("simple_multiple_choice")
    dialogue = F.col("key").startswith("interactive_evaluation_step:")
    runs = scanned.groupBy("file").agg(
        F.min_by(F.when(choice, F.col("accuracy")), F.when(choice, F.col("pos"))).alias("_acc"),
        F.max_by(F.when(dialogue, F.col("hash")), F.when(dialogue, F.col("pos"))).alias("run_key"),
    )
    model, dataset = split_run_name(F.col("file"))
    accuracy = F.coalesce(F.col("_acc"), F.lit(-1.0)) * 100.0
    return runs.select("file", model.alias("model"), dataset.alias("dataset"), "run_key",
                       accuracy.alias("mcp_acc"))


def attach_runs(index: DataFrame, rounds: DataFrame) -> DataFrame:
    """Rounds with the model and dataset of their run."""
    return rounds.join(index.select("run_key", "model", "dataset"), "run_key")


def board_scores(
    rounds: DataFrame, by: Sequence[str] = ("dataset", "model"), strict: bool = True
) -> DataFrame:
    """Per run the mean score of each metric over its conversations, the mean number of judged
    rounds, and how many conversations have no score in at least one metric."""
    by = list(by)
    wide = conversation_wide(rounds, keys=[*by, "conv_id"], strict=strict)
    unscored = F.lit(False)
    for m in ALL_METRICS:
        unscored = unscored | F.col(f"{m}_score").isNull()
    return wide.groupBy(*by).agg(
        *[F.avg(f"{m}_score").alias(m) for m in ALL_METRICS],
        F.avg("rounds").alias("conversation_completeness"),
        F.count(F.lit(1)).alias("conversations"),
        F.count_if(unscored).alias("unscored"),
    )


def leaderboard(
    accuracy: DataFrame,
    rounds: DataFrame,
    by: Sequence[str] = ("dataset", "model"),
    strict: bool = True,
) -> DataFrame:
    """Runs by overall score, best first. ``accuracy`` has the run columns and ``mcp_acc``."""
    board = board_scores(rounds, by, strict).join(accuracy.select(*by, "mcp_acc"), list(by), "left")
    board = board.withColumn("mcp_acc", F.coalesce("mcp_acc", F.lit(-100.0)))
    return board.orderBy(F.col("overall").desc_nulls_last(), *by)


def completeness(rounds: DataFrame, by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Mean number of judged rounds; rounds that did not parse count."""
    by = list(by)
    per = until_stop(rounds, keys=[*by, "conv_id"]).groupBy(*by, "conv_id").agg(
        F.count(F.lit(1)).alias("rounds")
    )
    return per.groupBy(*by).agg(
        F.avg("rounds").alias("conversation_completeness"),
        F.count(F.lit(1)).alias("conversations"),
    )


def stop_reasons(rounds: DataFrame, by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """How often each reason ends a conversation; last rounds without the key are left out."""
    by = list(by)
    last = last_round(until_stop(rounds, keys=[*by, "conv_id"]), keys=[*by, "conv_id"])
    return (
        last.where(F.col("stop_reason").isNotNull())
        .groupBy(*by, "stop_reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def board_long(board: DataFrame) -> DataFrame:
    """(dataset, model, metric, value) rows of a leaderboard."""
    metrics = [*ALL_METRICS, "conversation_completeness", "mcp_acc"]
    return board.unpivot(["dataset", "model"], metrics, "metric", "value")


def pivot_scores(long: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """A row per dataset and metric, a column per model."""
    groups = long.groupBy("dataset", "metric")
    pivoted = groups.pivot("model", list(models)) if models else groups.pivot("model")
    return pivoted.agg(F.first("value", ignorenulls=True))


def scores_json(board: DataFrame, reasons: DataFrame) -> DataFrame:
    """Per dataset one JSON object model -> scores, models by overall score, best first.

    A dataset's list holds its runs, one entry per model.
    """
    metrics = [*ALL_METRICS, "conversation_completeness"]
    counts = reasons.groupBy("dataset", "model").agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("stop_reason", "n")))
        ).alias("stop_reasons")
    )
    rows = board.join(counts, ["dataset", "model"], "left")
    scores = F.to_json(
        F.struct(*metrics, "stop_reasons", "mcp_acc"), {"ignoreNullFields": "false"}
    )
    entry = F.concat(json_string(F.col("model")), F.lit(":"), scores)
    ranked = F.struct((-F.col("overall")).alias("o"), F.col("model").alias("m"), entry.alias("e"))
    listed = rows.groupBy("dataset").agg(F.sort_array(F.collect_list(ranked)).alias("_e"))
    body = F.array_join(F.transform("_e", lambda x: x["e"]), ",")
    return listed.select("dataset", F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def _metric_objects(stats: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Per group one JSON object metric -> statistics; metrics without values are empty objects."""
    entry = F.struct("metric", F.to_json(F.struct(*fields)).alias("json"))
    held = stats.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    parts = [
        F.concat(
            F.lit(f'"{"overall_score" if m == "overall" else m}":'),
            F.coalesce(F.try_element_at("_m", F.lit(m)), F.lit("{}")),
        )
        for m in ALL_METRICS
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return held.select(*by, body.alias("json"))


def interactive_results(rounds: DataFrame, run_key: str, roles: dict[str, str]) -> DataFrame:
    """The result object of one interactive run: statistics and score counts per round, overall
    scores, the run's key and the roles' display names; one row (json).

    What is put together here is one row per round and metric.
    """
    kept = until_stop(rounds)
    pair = F.struct(F.col("score").cast("string"), "n")
    counters = round_histogram(kept).groupBy("round", "metric").agg(
        F.map_from_entries(F.sort_array(F.collect_list(pair))).alias("counter")
    )
    stats = round_stats(kept).join(counters, ["round", "metric"])
    per_round = _metric_objects(
        stats, ["round"], ["nonempty_values", "mean", "min", "max", "counter"]
    )
    line = F.struct(
        "round", F.concat(F.lit('"'), F.col("round").cast("string"), F.lit('":'), "json").alias("t")
    )
    listed = per_round.agg(F.sort_array(F.collect_list(line)).alias("_l")).select(
        F.array_join(F.transform("_l", lambda x: x["t"]), ",").alias("rounds")
    )
    scores = run_scores(conversation_scores(rounds)).where(F.col("nonempty_values") > 0)
    overall = _metric_objects(scores, [], ["nonempty_values", "mean", "min", "max"])
    tail = f',"hash":{json.dumps(run_key)},"roles":{json.dumps(roles)}}}'
    return listed.select(
        F.concat(
            F.lit('{"rounds":{'), "rounds", F.lit('},"overall":'), overall.scalar(), F.lit(tail)
        ).alias("json")
    )
