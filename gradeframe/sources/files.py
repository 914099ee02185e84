"""Readers and writers of requests, responses, results, transcripts and score files."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.functions.text import json_string
from gradeframe.operators.judge import parse_judge
from gradeframe.schemas import RESPONSES, arrival, conform
from gradeframe.sources.arrays import read_array
from gradeframe.sources.commits import Commits

_MESSAGE_LIST = "array<struct<role:string,content:string>>"
_REQUEST = {
    "uuid": "string",
    "parent_uuid": "string",
    "problem": "string",
    "choices": "array<string>",
    "answer": "string",
    "prompt": "string",
    "messages": _MESSAGE_LIST,
    "generation_config": "map<string,string>",
}
_RESPONSE = {
    "generated_text": "string",
    "choices": "array<struct<message:struct<role:string,content:string>>>",
    "loglikelihood": "string",
    "target_length": "int",
    "lm_loss": "double",
}


def _ddl(fields: dict[str, str], colon: str = ":") -> str:
    return ",".join(f"{name}{colon}{kind}" for name, kind in fields.items())


_LINE = f"request struct<{_ddl(_REQUEST)}>, response struct<{_ddl(_RESPONSE)}>, arrival string, written long"


def read_requests(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """JSON arrays of requests, a file of which is read by many tasks, or one request per line."""
    if lines:
        return spark.read.schema(_ddl(_REQUEST, " ")).json(path)
    return read_array(spark, path, _ddl(_REQUEST, " ")).drop("file", "pos")


def read_responses(spark: SparkSession, path: str, run_key: str | None = None) -> DataFrame:
    """JSON lines {request, response}, in whichever response mode.

    ``arrival`` orders lines over any number of files and runs, marked or not: by the time of writing (which
    ``write_response_lines`` puts into its lines; else the file's modification time), then by the mark a line brings
    along, the file's full path, and the place in it. A place is a split's byte offset plus the row's index in its task:
    a split has fewer lines than bytes, so later splits stay above earlier ones. ``mark`` is the mark alone.
    """
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    place = arrival(F.col("_metadata.file_block_start") + index)
    written = F.coalesce("written", F.unix_micros("_metadata.file_modification_time"))
    order = F.concat_ws("/", arrival(written), F.coalesce("arrival", F.lit("")), "_metadata.file_path", place)
    lines = spark.read.schema(_LINE).json(path).select(
        "request", "response", order.alias("arrival"), F.col("arrival").alias("mark")
    )
    r = F.col("response")
    rows = lines.select(
        "request.uuid",
        "request.parent_uuid",
        "request.problem",
        "request.choices",
        "request.answer",
        F.coalesce(r["generated_text"], F.get(r["choices"], F.lit(0))["message"]["content"])
        .alias("generated_text"),
        r["loglikelihood"].try_cast("double").alias("loglikelihood"),
        r["target_length"].alias("target_length"),
        r["lm_loss"].alias("lm_loss"),
        F.from_json(r["loglikelihood"], "array<double>").alias("token_logprobs"),
        "arrival",
        F.lit(run_key).cast("string").alias("run_key"),
        "mark",
    )
    return rows


def write_responses(df: DataFrame, path: str, run_key: str) -> None:
    """Replace a run's responses in a store of committed writes. Readers have the old run until all is written."""
    rows = conform(df, RESPONSES).withColumn("run_key", F.lit(run_key))
    Commits(df.sparkSession, path).write(rows, run_key, replace=True, partition_by=["run_key"])


#: Lines of a compressed file, which one task reads.
FILE_LINES = 1_000_000


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as compressed JSON lines, in files of at most ``FILE_LINES`` lines, as such a file cannot be read in parts."""
    df.write.mode(mode).option("compression", "gzip").option("maxRecordsPerFile", FILE_LINES).json(path)


def write_response_lines(df: DataFrame, path: str) -> None:
    """Responses as compressed JSON lines {request, response}, with the time of writing, the same in all lines, and the
    arrival mark of rows that have one, as the order over several files would be lost otherwise."""
    fields = ["generated_text", "loglikelihood", "target_length", "lm_loss", "token_logprobs"]
    kept = [c for c in df.columns if c not in (*fields, "arrival", "mark", "run_key")]
    kind = dict(df.dtypes).get("arrival")
    mark = F.col("arrival") if kind == "string" else arrival(F.col("arrival")) if kind else None
    lines = df.select(
        F.struct(*kept).alias("request"),
        F.struct(*[c for c in fields if c in df.columns]).alias("response"),
        *([mark.alias("arrival")] if mark is not None else []),
        F.lit(time.time_ns() // 1000).alias("written"),
    )
    write_lines(lines, path)


def stored_responses(spark: SparkSession, path: str, run_key: str | None = None) -> DataFrame:
    """Stored responses of all runs or of one, whose files alone are read."""
    store = Commits(spark, path).read(RESPONSES, run_key)
    return store if run_key is None else store.where(F.col("run_key") == run_key)


def results_json(df: DataFrame, step_type: str, step_name: str) -> DataFrame:
    """A step's one-row result as (key, json), the key being type:name."""
    key = F.concat_ws(":", F.lit(step_type), F.lit(step_name))
    return df.select(key.alias("key"), F.to_json(F.struct(*df.columns)).alias("json"))


#: A result file holds a step's or dataset's result per entry; more than this fails the job.
MOST_ENTRIES = 10_000


def _object(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, JSON) rows as one JSON object; for the handful of rows a result file has."""
    entry = F.concat(json_string(F.col(key)), F.lit(": "), F.col(value))
    listed = rows.limit(MOST_ENTRIES + 1).agg(F.array_sort(F.collect_list(entry)).alias("parts"))
    note = F.raise_error(F.lit(f"more than {MOST_ENTRIES} entries for one result file"))
    text = F.concat(F.lit("{"), F.array_join("parts", ", "), F.lit("}"))
    return listed.select(F.when(F.size("parts") > MOST_ENTRIES, note.cast("string")).otherwise(text).alias("value"))


def write_results(rows: DataFrame, path: str) -> None:
    """(key, json) rows as one JSON object."""
    _object(rows, "key", "json").coalesce(1).write.mode("overwrite").text(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """(dataset, json) rows as one JSON object dataset -> model -> scores."""
    _object(scores, "dataset", "json").coalesce(1).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str, step_name: str) -> None:
    """Replace a step's predictions in a store of committed writes."""
    rows = df.withColumn("step_name", F.lit(step_name))
    Commits(df.sparkSession, path).write(rows, step_name, replace=True)


def read_predictions(spark: SparkSession, path: str, step_name: str) -> DataFrame:
    return Commits(spark, path).read(name=step_name)


def write_choice_predictions(predictions: DataFrame, path: str) -> None:
    """Per problem its [hits, n] as JSON lines."""
    predictions.select("uuid", F.array("hits", "n").alias("result")).write.mode(
        "overwrite"
    ).json(path)


def write_transcripts(turns: DataFrame, rounds: DataFrame, path: str) -> None:
    """Replace the turns and rounds in a store of committed writes, rounds first, as they are read by their turns."""
    store = Commits(turns.sparkSession, path)
    store.write(rounds, "rounds", replace=True)
    store.write(turns, "turns", replace=True)


def read_transcripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    store = Commits(spark, path)
    return store.read(name="turns"), store.read(name="rounds")


_TRANSCRIPT = (
    "uuid string, all_messages array<struct<role:string,content:string>>, evaluation_results array<string>"
)


def read_transcript_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns and rounds of interactive runs saved as JSON arrays, one ``interactive_<key>`` folder
    per run; ``run_key`` is taken from the folder."""
    raw = read_array(spark, path, _TRANSCRIPT)
    folder = F.regexp_extract("file", r"interactive_([^/]+)/[^/]*$", 1)
    rows = raw.select(
        F.col("uuid").alias("conv_id"), "all_messages", "evaluation_results",
        folder.alias("run_key"),
    )
    turns = rows.select("conv_id", "run_key", F.posexplode("all_messages").alias("seq", "m"))
    turns = turns.select(
        "conv_id",
        "seq",
        F.floor(F.col("seq") / 3).cast("int").alias("round"),
        F.col("m.role").alias("party"),
        F.col("m.content").alias("content"),
        "run_key",
    )
    judged = rows.select(
        "conv_id", "run_key", F.posexplode("evaluation_results").alias("round", "content")
    )
    return turns, parse_judge(judged)


def read_validated(spark: SparkSession, path: str) -> DataFrame:
    """(uuid, valid) from {valid_uuids, invalid_uuids}."""
    schema = "valid_uuids array<string>, invalid_uuids array<string>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    valid = raw.select(F.explode("valid_uuids").alias("uuid"), F.lit(True).alias("valid"))
    return valid.unionByName(
        raw.select(F.explode("invalid_uuids").alias("uuid"), F.lit(False).alias("valid"))
    )


def scan_results(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Every step of every result file: (file, pos, key, accuracy, hash)."""
    raw = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
    steps = F.map_entries(
        F.from_json("value", "map<string,struct<accuracy:double,hash:string>>")
    )
    rows = raw.select(
        F.col("_metadata.file_name").alias("file"), F.posexplode(steps).alias("pos", "e")
    )
    return rows.select("file", "pos", "e.key", "e.value.accuracy", "e.value.hash")


def scan_samples(spark: SparkSession, path: str) -> DataFrame:
    """Candidate messages of sample files whose names do not start with ``single``."""
    schema = (
        "data struct<model_details:struct<role_messages:struct<candidate:"
        "array<struct<role:string,content:string>>>>>"
    )
    raw = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    rows = raw.select(
        F.col("_metadata.file_name").alias("file"),
        F.posexplode("data.model_details.role_messages.candidate").alias("seq", "m"),
    ).where(~F.col("file").startswith("single"))
    return rows.select("file", "seq", "m.role", "m.content")


def markdown_row(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns of each row as `` 0.123 | 0.456 |``."""

    def cell(name: str) -> Column:
        value = F.col(f"`{name}`")
        return F.when(value.isNull(), " nan |").otherwise(F.format_string(" %.3f |", value))

    return df.select(F.concat(*[cell(c) for c in columns]).alias("markdown"))
