"""Benchmark tables in their published shapes, normalized to problem rows by plain projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.functions.identity import with_uuid
from gradeframe.functions.text import id_json
from gradeframe.operators.expand import fewshot_sample, first_n, group_union
from gradeframe.operators.render import render_prompt
from gradeframe.plans.ordered import read_order
from gradeframe.schemas import as_problems

Normalizer = Callable[[DataFrame], DataFrame]

_normalizers: dict[str, Normalizer] = {}


def register_benchmark(kind: str, fn: Normalizer) -> None:
    """Add a kind: a function from raw rows to (problem, choices, answer_idx, ...) rows."""
    _normalizers[kind] = fn


def _benchmark(kind: str) -> Callable[[Normalizer], Normalizer]:
    def add(fn: Normalizer) -> Normalizer:
        register_benchmark(kind, fn)
        return fn

    return add


def normalize(df: DataFrame, kind: str, first: int | None = None) -> DataFrame:
    """Problem rows of a raw benchmark table. Without an ``ord`` column, scan order is used."""
    if kind not in _normalizers:
        raise ValueError(f"unknown benchmark kind {kind!r}")
    raw = df if "ord" in df.columns else read_order(df)
    out = with_uuid(as_problems(_normalizers[kind](raw))).withColumn("dataset", F.lit(kind))
    return out if first is None else first_n(out, first)


def read_benchmark(
    spark: SparkSession,
    path: str,
    kind: str,
    split: str | None = None,
    config: str | None = None,
    fmt: str = "parquet",
    first: int | None = None,
) -> DataFrame:
    """Load and normalize; split and config are partition columns and prune the scan."""
    raw = spark.read.format(fmt).load(path)
    for column, value in (("config", config), ("split", split)):
        if value is not None:
            raw = raw.where(F.col(column) == value)
    return normalize(raw, kind, first)


def read_group(spark: SparkSession, parts: list[dict], first: int | None = None) -> DataFrame:
    """Several benchmarks one after another; ``first`` rows of them all.

    A part is the arguments of ``read_benchmark``, and may have ``prompt`` (arguments of
    ``render_prompt``) and ``fewshot`` ({"k", "split", "seed"}: examples from the same benchmark) of its
    own; or it is a group itself: {"group": parts, "first": n}.
    """
    rows = group_union(*[_read_part(spark, dict(part)) for part in parts])
    return rows if first is None else first_n(rows, first)


def _read_part(spark: SparkSession, part: dict) -> DataFrame:
    if "group" in part:
        return read_group(spark, part["group"], part.get("first"))
    prompt, shots = part.pop("prompt", None), part.pop("fewshot", None)
    rows = read_benchmark(spark, **part)
    if prompt is None and shots is None:
        return rows
    examples = None
    if shots:
        pool = {**part, "split": shots.get("split", part.get("split")), "first": None}
        examples = fewshot_sample(read_benchmark(spark, **pool), shots["k"], shots.get("seed", 1))
    return render_prompt(rows, fewshot=examples, **(prompt or {}))


def _index(items: Column, value: Column) -> Column:
    """Position of a value that must be there."""
    at = F.array_position(items, value)
    note = F.concat(F.lit("not among the labels: "), value.cast("string"))
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.raise_error(note).cast("int"))


def _letters(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.char(i + 65))


def _stops(labels: Column) -> Column:
    return F.create_map(F.lit("stop_sequences"), F.to_json(labels))


def _rows(raw: DataFrame, problem, choices, answer, extra=None, stops=None) -> DataFrame:
    """Problem rows; by default one stop key per choice."""
    columns = [
        F.col("ord"),
        problem.alias("problem"),
        choices.alias("choices"),
        answer.cast("int").alias("answer_idx"),
    ]
    if extra is not None:
        columns.append(extra.alias("extra_json"))
    rows = raw.select(*columns, *([stops.alias("generation_config")] if stops is not None else []))
    if stops is None:
        rows = rows.withColumn("generation_config", _stops(_letters(F.size("choices"))))
    return rows


@_benchmark("arc_challenge")
def _arc(raw: DataFrame) -> DataFrame:
    labels = F.col("choices.label")
    keys = F.when(F.array_contains(labels, "A"), labels).otherwise(_letters(F.size(labels)))
    answer = _index(labels, F.col("answerKey"))
    return _rows(raw, F.col("question"), F.col("choices.text"), answer, id_json(F.col("id")),
                 _stops(keys))


@_benchmark("mmlu")
def _mmlu(raw: DataFrame) -> DataFrame:
    rows = _rows(raw, F.col("question"), F.col("choices"), F.col("answer"))
    return rows.drop("generation_config")


@_benchmark("truthful_qa")
def _truthful_qa(raw: DataFrame) -> DataFrame:
    target = F.col("mc1_targets")
    answer = _index(target["labels"], F.lit(1))
    return _rows(raw, F.col("question"), target["choices"], answer, id_json(F.col("ord"), False))


@_benchmark("hellaswag")
def _hellaswag(raw: DataFrame) -> DataFrame:
    return _rows(raw, F.col("ctx"), F.col("endings"), F.col("label"), id_json(F.col("ord"), False))


@_benchmark("ceval")
def _ceval(raw: DataFrame) -> DataFrame:
    answer = _index(F.array(*[F.lit(k) for k in "ABCD"]), F.col("answer"))
    choices = F.array("A", "B", "C", "D")
    return _rows(raw, F.col("question"), choices, answer, id_json(F.col("ord"), False))


@_benchmark("medmcqa")
def _medmcqa(raw: DataFrame) -> DataFrame:
    choices = F.array("opa", "opb", "opc", "opd")
    return _rows(raw, F.col("question"), choices, F.col("cop"), id_json(F.col("id")))


@_benchmark("reclor")
def _reclor(raw: DataFrame) -> DataFrame:
    question = F.concat(F.lit("Context: "), "context", F.lit("\n Question: "), "question")
    answer = _index(F.array(*[F.lit(i) for i in range(4)]), F.col("label").cast("int"))
    return _rows(raw, question, F.col("answers"), answer, id_json(F.col("id_string")),
                 _stops(_letters(F.lit(4))))


@_benchmark("hotpot_qa")
def _hotpot_qa(raw: DataFrame) -> DataFrame:
    return _rows(raw, F.col("question"), F.array("answer"), F.lit(0), id_json(F.col("id")),
                 _stops(F.array(F.lit("\n\n"))))


@_benchmark("gsm8k")
def _gsm8k(raw: DataFrame) -> DataFrame:
    return _rows(raw, F.col("question"), F.array("answer"), F.lit(0), F.lit("{}"))


@_benchmark("self_instruct")
def _self_instruct(raw: DataFrame) -> DataFrame:
    return _rows(raw, F.col("question"), F.col("choices"), F.col("answer"), F.lit("{}"))


# Fixed value: the option pattern of MathQA.
_MATHQA_OPTION = r"([a-z]) \) ([^,)]+)"


@_benchmark("mathqa")
def _mathqa(raw: DataFrame) -> DataFrame:
    labels = F.transform(
        F.regexp_extract_all("options", F.lit(_MATHQA_OPTION), F.lit(1)), lambda x: F.upper(x)
    )
    choices = F.regexp_extract_all("options", F.lit(_MATHQA_OPTION), F.lit(2))
    answer = _index(labels, F.upper("correct"))
    return _rows(raw, F.col("Problem"), choices, answer, id_json(F.sha2("Problem", 256)),
                 _stops(labels))
