"""Dialogue tables: opening messages, role views, turn pairs, transcript reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.messages import message
from gradeframe.functions.text import fill
from gradeframe.operators.choice import answered, originals
from gradeframe.operators.judge import json_body, lenient_json, lenient_map, parse_judge
from gradeframe.operators.render import choices_text, gold_text, prediction_text
from gradeframe.plans.ordered import int_block, positions
from gradeframe.schemas import METRICS, ROLES
from gradeframe.templates import (
    EVALUATOR_TURNS,
    SINGLE_JUDGE_SYSTEM,
    SINGLE_JUDGE_TEMPLATE,
    prompter,
)


def opening_bundle(predictions: DataFrame, prompts: dict | None = None) -> DataFrame:
    """conv_id and per role its opening messages, one row per predicted problem."""
    p = prompts or prompter()
    texts = predictions.select(
        F.col("uuid").alias("conv_id"),
        fill(p["seed_question"], problem=F.col("problem"), choices=choices_text()).alias("_mcp"),
        gold_text().alias("_gold"),
        prediction_text().alias("_pred"),
    )
    mcp, gold, pred = F.col("_mcp"), F.col("_gold"), F.col("_pred")
    interactor = F.array(
        message("system", F.lit(p["interactor_system_prompt"])),
        message(
            "user",
            fill(
                p["interactor_init_user_prompt"],
                mcp_prompt=mcp,
                correct_answer=gold,
                model_prediction=pred,
            ),
        ),
    )
    candidate = F.array(
        message("system", F.lit(p["candidate_system_prompt"])),
        message("user", mcp),
        message("assistant", pred),
    )
    example = F.when(pred == gold, p["evaluator_fewshot_correct"]).otherwise(
        p["evaluator_fewshot_incorrect"]
    )
    system = p["evaluator_system_prompt"] + p["evaluator_system_prompt_json_example"]
    evaluator = F.array(
        message("system", F.lit(system)),
        message(
            "user", fill(p["evaluator_init_user_prompt"], mcp_prompt=mcp, model_prediction=pred)
        ),
        message("assistant", example),
    )
    return texts.select(
        "conv_id",
        interactor.alias("interactor"),
        candidate.alias("candidate"),
        evaluator.alias("evaluator"),
    )


def opening_messages(predictions: DataFrame, prompts: dict | None = None) -> DataFrame:
    """The opening messages as rows (conv_id, party, seq, role, content)."""
    bundle = opening_bundle(predictions, prompts)
    parties = F.array(
        *[F.struct(F.lit(r).alias("party"), F.col(r).alias("messages")) for r in ROLES]
    )
    rows = bundle.select("conv_id", F.explode(parties).alias("p"))
    rows = rows.select("conv_id", "p.party", F.posexplode("p.messages").alias("seq", "m"))
    return rows.select("conv_id", "party", "seq", "m.role", "m.content")


def seed_conversations(predictions: DataFrame, prompts: dict | None = None) -> DataFrame:
    """Opening bundles of the originals that have a parsed answer."""
    return opening_bundle(answered(originals(predictions)), prompts)


def apply_validated(
    df: DataFrame, validated: DataFrame, key: str = "uuid"
) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is listed valid, and rows in neither list; listed invalid rows are dropped.

    ``validated`` is (uuid, valid); a key in both lists counts as valid.
    """
    listed = validated.groupBy(F.col("uuid").alias("_id")).agg(F.bool_or("valid").alias("_valid"))
    joined = df.join(listed, F.col(key) == F.col("_id"), "left")
    kept = joined.where(F.col("_valid")).select(*df.columns)
    return kept, joined.where(F.col("_valid").isNull()).select(*df.columns)


def turn_pairs(turns: DataFrame, tmpl: str = "default") -> DataFrame:
    """Evaluator prompt for each candidate turn that directly follows an interactor turn.

    A turn and its successor meet under the interactor's seq, so neither a window along the
    conversation nor a self-join is needed.
    """
    asks = F.col("party") == "interactor"
    answers = F.col("party") == "candidate"
    slot = F.when(answers, F.col("seq") - 1).otherwise(F.col("seq"))
    pairs = (
        turns.where(asks | answers)
        .groupBy("conv_id", slot.alias("seq"))
        .agg(
            F.max(F.when(asks, F.col("content"))).alias("_ask"),
            F.max(F.when(answers, F.col("content"))).alias("_answer"),
        )
        .where(F.col("_ask").isNotNull() & F.col("_answer").isNotNull())
    )
    prompt = fill(
        EVALUATOR_TURNS[tmpl],
        interactor_content=F.col("_ask"),
        candidate_content=F.col("_answer"),
    )
    rows = pairs.select("conv_id", "seq", prompt.alias("prompt"))
    return positions(rows, ["conv_id"], ["seq"], int_block(F.col("seq")), "round")


def unpaired_count(turns: DataFrame) -> DataFrame:
    """Candidate turns without an interactor turn right before them (should be none)."""
    asks = turns.where(F.col("party") == "interactor").select(
        "conv_id", (F.col("seq") + 1).alias("seq")
    )
    lone = turns.where(F.col("party") == "candidate").join(asks, ["conv_id", "seq"], "left_anti")
    return lone.agg(F.count(F.lit(1)).alias("unpaired"))


def role_view(turns: DataFrame, role: str, tmpl: str = "default") -> DataFrame:
    """One dialogue as one party sees it: rows (conv_id, seq, role, content).

    Candidate and interactor see themselves as assistant and each other as user. The evaluator
    sees one prompt per pair of turns, at the candidate's seq, and its own replies.
    """
    party = F.col("party")
    own = turns.select(
        "conv_id",
        "seq",
        F.when(party == role, "assistant").otherwise("user").alias("role"),
        "content",
        "party",
    )
    if role != "evaluator":
        return own.where(party.isin("interactor", "candidate")).drop("party")
    pairs = turn_pairs(turns, tmpl).select(
        "conv_id",
        (F.col("seq") + 1).alias("seq"),
        F.lit("user").alias("role"),
        F.col("prompt").alias("content"),
    )
    return pairs.unionByName(own.where(party == "evaluator").drop("party"))


_VERDICT = "struct<overall_score:variant,stop_conversation:variant>"


def filter_transcripts(
    turns: DataFrame, stop: bool, lo: float = 0.0, hi: float = 5.0
) -> DataFrame:
    """Conversations whose last turn is a judge's, with a JSON object, the given stop flag and an
    overall score (0 if absent) within [lo, hi]."""
    fields = F.struct("party", "content")
    last = turns.groupBy("conv_id").agg(
        F.max("seq").alias("last_seq"), F.max_by(fields, "seq").alias("_l")
    )
    judged = last.where(F.col("_l.party") == "evaluator").select(
        "conv_id", "last_seq", json_body(F.col("_l.content")).alias("_body")
    )
    read = lenient_json(judged, "_body", _VERDICT, "_v")
    some = ~F.col("_body").rlike(r"^\{\s*\}$") & F.col("_v").isNotNull()
    given = F.col("_v.stop_conversation")
    flag = F.when(given.isNull(), False).when(
        F.schema_of_variant(given) != "STRING", F.try_variant_get(given, "$", "boolean")
    )
    raw = F.col("_v.overall_score")
    overall = F.coalesce(F.try_variant_get(raw, "$", "double"), F.lit(0.0))
    return read.where(some & (flag == stop) & overall.between(lo, hi)).select(
        "conv_id", "last_seq", overall.alias("overall_score")
    )


def _shown(value: Column) -> Column:
    """A JSON scalar the way Python prints it."""
    return (
        F.when(value.isNull(), "None")
        .when(value == "true", "True")
        .when(value == "false", "False")
        .otherwise(value)
    )


_INNER = "struct<comment:string,score:string>"
# Metrics whose objects are read in the one parse of the whole body; others get a parse of their own.
_KNOWN = [*METRICS, "reasoning"]
_KNOWN_SCHEMA = f"struct<{','.join(f'{m}:{_INNER}' for m in _KNOWN)}>"


def with_evaluation_text(df: DataFrame, content: str, name: str) -> DataFrame:
    """Adds a judge's JSON as one line per key, in the judge's order."""
    body = df.withColumn("_body", json_body(F.col(content)))
    read = lenient_json(body, "_body", _KNOWN_SCHEMA, "_known")
    read = read.withColumn("_entries", F.map_entries(lenient_map("_body")))

    def line(e: Column) -> Column:
        title = F.concat(
            F.upper(F.substring(e["key"], 1, 1)), F.lower(e["key"].substr(F.lit(2), F.length(e["key"])))
        )
        inner = F.from_json(e["value"], _INNER)
        for m in _KNOWN:
            inner = F.when(e["key"] == m, F.col("_known")[m]).otherwise(inner)
        scored = F.concat(
            F.lit(" + "), title, F.lit("("), _shown(inner["score"]), F.lit("): "),
            F.coalesce(inner["comment"], F.lit("")), F.lit("\n"),
        )
        flat = F.concat(F.lit(" + "), title, F.lit(": "), _shown(e["value"]), F.lit("\n"))
        return F.when(F.startswith(e["value"], F.lit("{")), scored).otherwise(flat)

    text = F.coalesce(F.array_join(F.transform("_entries", line), ""), F.lit(""))
    return read.withColumn(name, text).drop("_body", "_known", "_entries")


def render_transcripts(turns: DataFrame) -> DataFrame:
    """Per conversation and round the question, the answer and the evaluation as text."""

    def said(role: str) -> Column:
        return F.max(F.when(F.col("party") == role, F.col("content")))

    wide = turns.groupBy("conv_id", "round").agg(*[said(r).alias(f"_{r}") for r in ROLES])

    def titled(name: str) -> Column:
        head = F.concat(F.lit(f"## {name}(Round "), F.col("round").cast("string"), F.lit(")\n"))
        source = F.col(f"_{name.lower()}")
        return F.when(source.isNotNull(), F.concat(head, source))

    report = F.concat(
        F.lit("## Evaluation(Round "), F.col("round").cast("string"), F.lit(")\n"), F.col("_report")
    )
    return with_evaluation_text(wide, "_evaluator", "_report").select(
        "conv_id",
        "round",
        titled("Interactor").alias("interactor"),
        titled("Candidate").alias("candidate"),
        F.when(F.col("_evaluator").isNotNull(), report).alias("evaluation"),
    )


def judge_requests(messages: DataFrame, key: str = "file") -> DataFrame:
    """Single-answer judge prompts from candidate messages (key, seq, role, content).

    Messages 1 to 3 are the question, message 4 the answer; only these four rows of a dialogue
    reach the aggregation.
    """
    line = F.concat("role", F.lit(": "), "content")
    asked = F.when(F.col("seq").between(1, 3), F.struct("seq", line.alias("line")))
    picked = (
        messages.where(F.col("seq").between(1, 4))
        .groupBy(key)
        .agg(
            F.sort_array(F.collect_list(asked)).alias("_q"),
            F.max(F.when(F.col("seq") == 4, F.col("content"))).alias("_a"),
        )
        .where(F.col("_a").isNotNull())
    )
    question = F.array_join(F.transform("_q", lambda s: s["line"]), "\n")
    return picked.select(
        key,
        F.array(
            message("system", F.lit(SINGLE_JUDGE_SYSTEM)),
            message("user", fill(SINGLE_JUDGE_TEMPLATE, question=question, answer=F.col("_a"))),
        ).alias("messages"),
    )


def turns_to_rounds(turns: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Judged rounds from the evaluator's turns."""
    judged = turns.where(F.col("party") == "evaluator")
    return parse_judge(judged.select("conv_id", "round", *extra, "content"))
