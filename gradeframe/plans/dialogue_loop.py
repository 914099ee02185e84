"""Multi-round evaluation dialogues: interactor, candidate, judge, until stopped or out of rounds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeframe.functions.messages import drop_system, join_text, merge_config, message
from gradeframe.functions.text import fill, strip
from gradeframe.operators.inference import Responder
from gradeframe.operators.judge import parse_judge
from gradeframe.operators.replies import ask, responder_key
from gradeframe.plans.ordered import int_block, positions
from gradeframe.schemas import ROLES, TURNS
from gradeframe.session import fresh_dir
from gradeframe.sources.commits import Commits
from gradeframe.templates import prompter

#: What has been said: ``seq`` counts a dialogue's entries, three to a round; ``stop`` is a verdict's.
_SAID = "row string, conv_id string, seq int, content string, stop boolean"


def _named_rows(seeds: DataFrame) -> DataFrame:
    """Seeds with a name of their own: the conversation's id, and a number for later copies of it."""
    rows = seeds.select("conv_id", *ROLES, F.monotonically_increasing_id().alias("_id"))
    placed = positions(rows, ["conv_id"], ["_id"], int_block(F.col("_id")), "_copy")
    later = F.concat("conv_id", F.lit("#"), (F.col("_copy") + 1).cast("string"))
    return placed.select("conv_id", *ROLES, F.when(F.col("_copy") == 0, F.col("conv_id")).otherwise(later).alias("row"))


class _Bucketed:
    """Tables bucketed by ``row``, which join and group by it without moving a row. Appended rows are moved once, to
    their bucket. The catalog knows a table while the run lasts; its files stay."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets, self.names = spark, path, buckets, {}

    def add(self, df: DataFrame, table: str) -> None:
        self.names.setdefault(table, f"gradeframe_{table}_{uuid.uuid4().hex}")
        placed = df.repartition(self.buckets, "row")
        writer = placed.write.mode("append").bucketBy(self.buckets, "row").sortBy("row")
        writer.option("path", f"{self.path}/{table}").saveAsTable(self.names[table])

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.names[table])

    def forget(self) -> None:
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _view(role: str, evaluator_prompt: str) -> Column:
    """What a role has seen and said after its seed, from all entries in their order."""
    pairs = F.arrays_zip(*[_entries(i).alias(c) for i, c in enumerate(("asks", "answers", "verdicts"))])
    texts = {"ask": lambda t: t["asks"], "answer": lambda t: t["answers"], "verdict": lambda t: t["verdicts"]}
    if role == "interactor":
        order = [("assistant", texts["ask"]), ("user", texts["answer"])]
    elif role == "candidate":
        order = [("user", texts["ask"]), ("assistant", texts["answer"])]
    else:

        def pair(t):
            text = fill(evaluator_prompt, interactor_content=t["asks"], candidate_content=t["answers"])
            return F.when(t["answers"].isNotNull(), text)

        order = [("user", pair), ("assistant", texts["verdict"])]
    listed = F.transform(pairs, lambda t: F.array(*[message(r, text(t)) for r, text in order]))
    # what has not been said yet is null at the end of the lists
    return F.filter(F.flatten(listed), lambda m: m["content"].isNotNull())


def _entries(kind: int) -> Column:
    """One party's entries of ``_said``, a list of (seq, content)."""
    mine = F.filter("_said", lambda x: x["seq"] % 3 == kind)
    return F.transform(mine, lambda x: x["content"])


def _live(tables: _Bucketed, role: str) -> DataFrame:
    """row, conv_id, _seed and _said of the dialogues that no verdict has stopped."""
    entry = F.struct("seq", "content")
    said = tables.read("said").groupBy("row").agg(
        F.array_sort(F.collect_list(entry)).alias("_said"), F.bool_or("stop").alias("_stop")
    )
    seeds = tables.read("seeds").select("row", "conv_id", F.col(role).alias("_seed"))
    joined = seeds.join(said, "row", "left").where(~F.coalesce("_stop", F.lit(False)))
    nothing = F.array().cast("array<struct<seq:int,content:string>>")
    return joined.withColumn("_said", F.coalesce("_said", nothing))


def opening_requests(
    seeds: DataFrame, role: str, post: dict | None = None, config: dict | None = None
) -> DataFrame:
    """The seeds (conv_id, a message array per role) with the request a role gets before anything is said: messages,
    prompt, generation_config."""
    return _as_requests(seeds, F.col(role), post or {}, config or {})


def _as_requests(df: DataFrame, messages: Column, post: dict, config: dict) -> DataFrame:
    shown = drop_system(messages) if post.get("remove_system") else messages
    settings = [F.lit(x) for pair in config.items() for x in pair]
    given = F.create_map(*settings) if settings else F.lit(None).cast("map<string,string>")
    return df.select(
        *[c for c in df.columns if c not in ("messages", "prompt", "generation_config")],
        messages.alias("messages"),
        join_text(shown, keep_last=False).alias("prompt"),
        merge_config(given, F.lit(None).cast("map<string,string>")).alias("generation_config"),
    )


def _requests(tables: _Bucketed, role: str, prompt: str, post: dict, config: dict) -> DataFrame:
    """One request per live dialogue: messages, their rendered prompt and the generation settings. The seed's constant
    messages are added here and nowhere kept with what has been said."""
    rows = _live(tables, role)
    messages = F.concat("_seed", _view(role, prompt))
    asked = _as_requests(rows.withColumnRenamed("row", "uuid"), messages, post, config)
    return asked.select("uuid", "conv_id", "messages", "prompt", "generation_config")


def _said(replies: DataFrame, seq: int) -> DataFrame:
    """Replies (uuid, conv_id, generated_text) as entries; a dialogue without a reply fails the job."""
    note = F.concat(F.lit("no reply for conversation "), F.col("uuid"))
    text = strip(F.col("generated_text"))
    content = F.when(text.isNull(), F.raise_error(note)).otherwise(text)
    rows = replies.select(F.col("uuid").alias("row"), "conv_id", F.lit(seq).alias("seq"), content.alias("content"))
    stop = F.lit(False)
    if seq % 3 == 2:
        judged = parse_judge(rows.withColumn("_text", F.col("content")))
        rows, stop = judged.withColumn("content", F.col("_text")), F.col("stop_conversation")
    return rows.select("row", "conv_id", "seq", "content", stop.alias("stop"))


def run_dialogue(
    seeds: DataFrame,
    responders: dict[str, str | Responder],
    max_rounds: int = 3,
    out: str | None = None,
    prompts: dict | None = None,
    partitions: int | None = None,
    post: dict[str, dict] | None = None,
    generation: dict[str, dict[str, str]] | None = None,
    commits: int = 1,
    run_keys: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Run the dialogues of ``seeds`` (conv_id and a message array per role).

    Returns (turns, rounds), both with ``row``: every seed is a dialogue of its own, also where several
    have one conv_id. ``post`` ({role: {"remove_system": True}}) shapes a role's rendered prompt,
    ``generation`` gives its settings; requests carry uuid, messages, prompt and generation_config.

    Replies are stored below ``out`` by what was asked of whom (``operators.replies``): later runs with the
    same ``out`` reuse them request by request, and other models, settings, prompts or seeds are asked anew.
    ``run_keys`` names the roles' responders (``identity.run_key``); a role without one is known by its function.

    What is said is one table below ``out``, bucketed by dialogue into ``partitions`` buckets, to which each reply is
    appended. Requests are put together bucket by bucket, so that a round moves and writes its own digests and replies
    and nothing that was said before.
    """
    if set(responders) != set(ROLES):
        raise ValueError(f"responders must be given for {ROLES}")
    spark = seeds.sparkSession
    out = out or fresh_dir(spark, "dialogue")
    p, post, generation = prompts or prompter(), post or {}, generation or {}
    keys = {role: (run_keys or {}).get(role) or responder_key(responders[role]) for role in ROLES}
    buckets = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = _Bucketed(spark, f"{out}/runs/{uuid.uuid4().hex}", buckets)
    store = Commits(spark, f"{out}/replies")
    try:
        tables.add(_named_rows(seeds), "seeds")
        tables.add(spark.createDataFrame([], _SAID), "said")
        for step in range(max_rounds):
            for i, role in enumerate(ROLES):
                requests = _requests(tables, role, p["evaluator_user_prompt"], post.get(role, {}), generation.get(role, {}))
                replies = ask(
                    requests, responders[role], keys[role], store, f"{role}-{step}", commits=commits, keep=("conv_id",)
                )
                tables.add(_said(replies, 3 * step + i), "said")
            if step + 1 < max_rounds and _live(tables, "interactor").isEmpty():
                break
    finally:
        tables.forget()
    return _turns(spark.read.schema(_SAID).parquet(f"{tables.path}/said"))


def _turns(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    number = F.floor(F.col("seq") / 3).cast("int").alias("round")
    party = F.element_at(F.array(*map(F.lit, ROLES)), F.col("seq") % 3 + 1).alias("party")
    rows = said.select("conv_id", "seq", number, party, "content", "row")
    typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TURNS.fields], "row")
    verdicts = rows.where(F.col("seq") % 3 == 2).select("conv_id", "row", "round", "content")
    return typed, parse_judge(verdicts)
