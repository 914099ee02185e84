"""Content identities: problem uuid, dataset fingerprint, run and step keys."""

from __future__ import annotations

import hashlib
import json
from base64 import urlsafe_b64encode

from pyspark.sql import Column, DataFrame, functions as F

from gradeframe.functions.text import list_text


def digest(c: Column) -> Column:
    """URL-safe base64 of the md5 of a string, without padding (22 characters)."""
    encoded = F.base64(F.unhex(F.md5(F.encode(c, "UTF-8"))))
    return F.substring(F.translate(encoded, "+/", "-_"), 1, 22)


def text_digest(s: str) -> str:
    """The same digest for a parameter string on the driver."""
    return urlsafe_b64encode(hashlib.md5(s.encode("utf-8")).digest()).rstrip(b"=").decode()


def problem_uuid() -> Column:
    """Identity of a problem row from its content; the parent is not part of it."""
    answer = F.coalesce("answer_text", F.col("answer_idx").cast("string"), F.lit("None"))
    return digest(
        F.concat(
            F.coalesce("problem", F.lit("None")),
            F.lit("$choices$"),
            F.array_join("choices", ";"),
            F.lit("$ans$"),
            answer,
            F.lit("$perm$"),
            list_text(F.col("permutation")),
            F.lit("$ex$"),
            F.coalesce("extra_json", F.lit("null")),
        )
    )


def with_uuid(df: DataFrame) -> DataFrame:
    return df.withColumn("uuid", problem_uuid())


def _hash_part(c: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(c), start, 15), 16, 10).cast("decimal(20,0)")


def fingerprint(
    problems: DataFrame,
    fewshot: list[str] | None = None,
    tokenizer: str | None = None,
    template: str | None = "default",
    system_prompt: str | None = None,
) -> DataFrame:
    """One row (n_problems, fingerprint) naming a dataset's content, whatever the row order.

    Two 60-bit slices of each uuid's md5 are summed, so the work is a map-side partial sum and
    copies count; no task ever holds the list of uuids.
    """
    tail = "#".join(fewshot or [])
    if tokenizer:
        tail += "$tokenizer$" + tokenizer
    if template:
        tail += "$tmpl$" + template
    if system_prompt:
        tail += "$sysprompt$" + system_prompt
    sums = problems.agg(
        F.count(F.lit(1)).alias("n_problems"),
        F.sum(_hash_part(F.col("uuid"), 1)).cast("decimal(38,0)").alias("a"),
        F.sum(_hash_part(F.col("uuid"), 16)).cast("decimal(38,0)").alias("b"),
    )
    text = F.concat_ws("$", F.col("n_problems").cast("string"), F.col("a").cast("string"),
                       F.col("b").cast("string"))
    return sums.select("n_problems", digest(F.concat(text, F.lit(tail))).alias("fingerprint"))


def run_key(config: dict, context: str | None = None) -> str:
    """Key of an inference run: endpoint type, model, generation settings and dataset context."""
    kind, kwargs = config["type"], config["inference_kwargs"]
    generation = json.dumps(kwargs.get("generation_config", {}))
    text = f"$type: {kind}"
    if kind == "openai":
        text += f"$openai_model: {kwargs['openai_model']}$generation_config: {generation}"
    elif kind == "remote_hf":
        url = kwargs["base_url"]
        name = kwargs.get("model_name")
        text += f"$base_url: {url}" if name is None else f"$model_name: {name}"
        post = json.dumps(kwargs.get("prompt_postprocessor_config", {}))
        text += f"$generation_config: {generation}$prompt_postprocessor_config: {post}"
    elif kind == "local_hf":
        text += f"$kwargs: {json.dumps(kwargs)}"
    else:
        raise ValueError(f"unknown endpoint type {kind!r}")
    if context is not None:
        text += f"$context_hash: {context}"
    return text_digest(text)


def dialogue_key(roles: dict, prompter_key: str | None = None, dataset: str | None = None) -> str:
    """Key of an interactive run: its three endpoints, its prompts and its dataset."""
    text = "".join(
        f"$role:{role}${run_key(roles[role])}" for role in ("interactor", "candidate", "evaluator")
    )
    if prompter_key is not None:
        text += f"$prompter:{prompter_key}$"
    if dataset is not None:
        text += f"$mcp:{dataset}$"
    return text_digest(text)


def loss_key(dataset: str, step_name: str, model_path: str) -> str:
    """Hex key of a loss or Min-K run."""
    return hashlib.md5(f"{dataset}_{step_name}_{model_path}".encode()).hexdigest()


def role_label(config: dict) -> str:
    """Display name of a role: endpoint type and model."""
    kwargs = config["inference_kwargs"]
    if config["type"] == "openai":
        name = kwargs["openai_model"]
    elif config["type"] == "remote_hf":
        name = kwargs.get("model_name", kwargs["base_url"])
    else:
        name = kwargs["model_path"]
    return f"{config['type']}: {name}"
