"""Table schemas of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

METRICS = ["accuracy", "logic", "relevance", "coherence", "conciseness"]
ROLES = ["interactor", "candidate", "evaluator"]

MESSAGE = T.StructType(
    [T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]
)
MESSAGES = T.ArrayType(MESSAGE)

PROBLEMS = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("parent_uuid", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("problem", T.StringType()),
        T.StructField("choices", T.ArrayType(T.StringType())),
        T.StructField("answer_idx", T.IntegerType()),
        T.StructField("answer_text", T.StringType()),
        T.StructField("permutation", T.ArrayType(T.IntegerType())),
        T.StructField("choice_key_type", T.StringType()),
        T.StructField("extra_json", T.StringType()),
        T.StructField("generation_config", T.MapType(T.StringType(), T.StringType())),
        T.StructField("prompt", T.StringType()),
        T.StructField("dataset", T.StringType()),
    ]
)

RESPONSES = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("parent_uuid", T.StringType()),
        T.StructField("generated_text", T.StringType()),
        T.StructField("loglikelihood", T.DoubleType()),
        T.StructField("target_length", T.IntegerType()),
        T.StructField("lm_loss", T.DoubleType()),
        T.StructField("token_logprobs", T.ArrayType(T.DoubleType())),
        T.StructField("arrival", T.StringType()),
        T.StructField("run_key", T.StringType()),
    ]
)

TURNS = T.StructType(
    [
        T.StructField("conv_id", T.StringType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("round", T.IntegerType()),
        T.StructField("party", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

_SCORED = T.StructType(
    [T.StructField("comment", T.StringType()), T.StructField("score", T.DoubleType())]
)

ROUNDS = T.StructType(
    [T.StructField("conv_id", T.StringType()), T.StructField("round", T.IntegerType())]
    + [T.StructField(m, _SCORED) for m in METRICS]
    + [
        T.StructField("comment", T.StringType()),
        T.StructField("overall_comment", T.StringType()),
        T.StructField("overall_score", T.DoubleType()),
        T.StructField("stop_conversation", T.BooleanType()),
        T.StructField("stop_reason", T.StringType()),
    ]
)


def arrival(number: Column) -> Column:
    """A number as an arrival mark: marks are compared as text."""
    return F.lpad(number.cast("string"), 20, "0")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a schema by column name; absent columns become typed nulls."""
    have = dict(df.dtypes)

    def column(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None)
        if f.name == "arrival" and have[f.name] in ("int", "bigint"):
            return arrival(F.col(f.name))
        return F.col(f.name)

    return df.select(*[column(f).cast(f.dataType).alias(f.name) for f in schema.fields])


def as_problems(df: DataFrame) -> DataFrame:
    """Conform to the problem schema; choices are keyed by letters unless said otherwise."""
    out = conform(df, PROBLEMS)
    return out.withColumn("choice_key_type", F.coalesce("choice_key_type", F.lit("letters")))
