"""Evaluation-shaped views over the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.functions.identity import with_uuid
from gradeframe.plans.ordered import int_block, minute_block, positions
from gradeframe.schemas import as_problems


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _first_lines(lineitem: DataFrame) -> DataFrame:
    """The lowest line of each order, from map-side minima."""
    return lineitem.groupBy("l_orderkey").agg(F.min("l_linenumber").alias("l0"))


# Response texts by part key modulo 8.
RESPONSE_TEXTS = ["A", "B", " C ", "D", "Answer: B", "so D.", "???", "(C) C. it is"]


def mc_instances(spark: SparkSession, sf: str) -> DataFrame:
    """Responses to four-choice problems: uuid, parent_uuid, ord, answer_idx, rot,
    generated_text, and the rotation as permutation."""
    lineitem = table(spark, sf, "lineitem")
    k = lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"))
    r = k.join(_first_lines(lineitem), "l_orderkey")
    first = F.col("l_linenumber") == F.col("l0")
    text = F.element_at(
        F.array(*[F.lit(t) for t in RESPONSE_TEXTS]), (F.col("pk") % 8 + 1).cast("int")
    )
    rot = F.when(~first, (F.col("l_linenumber") % 4).cast("int"))
    rows = r.select(
        F.concat(_text("l_orderkey"), F.lit("-"), _text("l_linenumber")).alias("uuid"),
        F.when(~first, F.concat(_text("l_orderkey"), F.lit("-"), _text("l0"))).alias("parent_uuid"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        (F.col("l_orderkey") % 4).cast("int").alias("answer_idx"),
        rot.alias("rot"),
        text.alias("generated_text"),
    )
    turned = F.array(*[(F.lit(p) + F.col("rot")) % 4 for p in range(4)])
    return rows.withColumn("permutation", F.when(F.col("rot").isNotNull(), turned))


def mc_runs(instances: DataFrame) -> DataFrame:
    """With the run's model and dataset."""
    part = (F.floor(F.col("ord") / 10) % 3).cast("string")
    return instances.withColumn(
        "model", F.concat(F.lit("m"), F.col("answer_idx").cast("string"))
    ).withColumn("dataset", F.concat(F.lit("d"), part))


def mc_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Five-choice problems with their uuid."""
    orders = table(spark, sf, "orders")
    choices = F.split(F.lit("1-URGENT|2-HIGH|3-MEDIUM|4-NOT SPECIFIED|5-LOW"), r"\|")
    rows = orders.select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("Order "), _text("o_orderkey"), F.lit(" has which priority?")).alias(
            "problem"
        ),
        choices.alias("choices"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("answer_idx"),
        F.concat(F.lit('{"id": "'), _text("o_orderkey"), F.lit('"}')).alias("extra_json"),
    )
    return with_uuid(as_problems(rows))


def rotated_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Problems of which the odd ones are shown rotated by their ord."""
    turned = F.array(*[((F.col("ord") + i) % 5).cast("int") for i in range(5)])
    rows = mc_problems(spark, sf)
    return with_uuid(rows.withColumn("permutation", F.when(F.col("ord") % 2 == 1, turned)))


def predicted_problems(spark: SparkSession, sf: str) -> DataFrame:
    """mc_instances as problem rows with question and choices, still to be scored."""
    rows = mc_instances(spark, sf)
    names = F.array(*[F.lit(t) for t in ("alpha", "beta", "gamma", "delta")])
    return (
        rows.withColumn("problem", F.concat(F.lit("Pick for "), "uuid"))
        .withColumn("choices", names)
        .withColumn("answer_text", F.lit(None).cast("string"))
        .withColumn("choice_key_type", F.lit("letters"))
    )


def judge_rounds_raw(spark: SparkSession, sf: str) -> DataFrame:
    """Judge texts: five events of a user in time order are one conversation.

    The event's number within its user comes from minute blocks, so that a user with a large share of the events is
    not one task.
    """
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    s = positions(events, ["user_id"], ["ts", "event_id"], minute_block(F.col("ts")), "seq")
    stop = (F.col("event_type") == "error") & (F.col("event_id") % 2 == 0)

    def number(c: Column) -> Column:
        return c.cast("string")

    content = F.concat(
        F.lit('note {"accuracy": {"comment": "c", "score": '),
        number(F.col("event_id") % 7),
        F.lit('}, "logic": {"score": "'),
        number(F.col("event_id") % 5),
        F.lit('"}, "relevance": {"score": '),
        number(F.col("event_id") % 4 + 1),
        F.lit('}, "coherence": {"score": null}, "overall_score": '),
        number(F.col("event_id") % 4 + 1),
        F.lit(', "stop_conversation": '),
        F.when(stop, "true").otherwise("false"),
        F.lit(', "stop_reason": "'),
        F.when(stop, "off_topic").otherwise("none"),
        F.lit('"} end'),
    )
    conversation = F.floor(F.col("seq") / 5).cast("long").cast("string")
    return s.select(
        F.concat(_text("user_id"), F.lit("-"), conversation).alias("conv_id"),
        (F.col("seq") % 5).cast("int").alias("round"),
        F.concat(F.lit("m"), number(F.col("user_id") % 4)).alias("model"),
        F.concat(F.lit("d"), number(F.col("user_id") % 3)).alias("dataset"),
        content.alias("content"),
    )


def transcript_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Judge texts with the question and answer before each."""
    raw = judge_rounds_raw(spark, sf)
    at = F.concat(F.col("round").cast("string"), F.lit(" of "), F.col("conv_id"))
    said = F.array(
        F.struct(F.lit("interactor").alias("party"), F.concat(F.lit("Why "), at).alias("content")),
        F.struct(F.lit("candidate").alias("party"), F.concat(F.lit("As "), at).alias("content")),
        F.struct(F.lit("evaluator").alias("party"), F.col("content")),
    )
    rows = raw.select("conv_id", "round", F.posexplode(said).alias("i", "t"))
    return rows.select(
        "conv_id",
        (F.col("round") * 3 + F.col("i")).alias("seq"),
        "round",
        "t.party",
        "t.content",
    )


def dialogue_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Two-party dialogues without their system turns, renumbered."""
    said = table(spark, sf, "conversations").where(F.col("role") != "system")
    rows = positions(said, ["conv_id"], ["turn"], int_block(F.col("turn")), "seq")
    return rows.select(
        _text("conv_id").alias("conv_id"),
        F.col("seq").cast("int").alias("seq"),
        F.when(F.col("role") == "user", "interactor").otherwise("candidate").alias("party"),
        F.col("text").alias("content"),
    )


def cloze_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Log-likelihoods per choice, with and without the question."""
    lineitem = table(spark, sf, "lineitem")
    k = lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_extendedprice").alias("p"),
        F.min("l_quantity").alias("q"),
        F.min("l_discount").alias("d"),
    )
    rows = k.join(_first_lines(lineitem), "l_orderkey")
    return rows.select(
        _text("l_orderkey").alias("parent_uuid"),
        F.concat(F.lit("c"), _text("l_linenumber")).alias("choice"),
        F.col("l_linenumber").alias("pos"),
        (-F.col("p") / 1000).alias("loglikelihood"),
        F.col("q").cast("int").alias("target_length"),
        (-F.col("d") * 10).alias("uncond_loglikelihood"),
        F.concat(F.lit("c"), _text("l0")).alias("answer_text"),
    )


def token_logprobs(spark: SparkSession, sf: str, members: bool | None = None) -> DataFrame:
    """Token log-probabilities: whole embeddings, lengthened by some of their values again; the group
    of members only, of non-members only, or both."""
    rows = table(spark, sf, "embeddings")
    member = F.col("label") < 5
    if members is not None:
        rows = rows.where(member if members else ~member)
    again = F.slice("embedding", F.lit(1), (F.col("vec_id") % 62 + 1).cast("int"))
    values = F.concat("embedding", again)
    return rows.select(
        _text("vec_id").alias("uuid"),
        member.cast("int").alias("group_label"),
        F.transform(values, lambda x: -F.abs(x.cast("double"))).alias("token_logprobs"),
    )
