"""Live scoreboards: response and judge files scored as they arrive.

Streams keep no state of their own. What has been seen is a table of committed parts below the sink (``sources.commits``),
one part per micro-batch, and every ``COMPACT`` batches a snapshot of all before. A batch looks up what it needs to know
in the parts before it, so that a repeated batch finds the same, replaces its own part and changes nothing. A table has
a row per key, or per run of rounds, however often old keys come again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeframe.operators.choice import parse_answers, score_answers
from gradeframe.operators.judge import parse_judge
from gradeframe.operators.rounds import ALL_METRICS, block_sums, combine_blocks, merge_blocks
from gradeframe.plans.ordered import BLOCK, int_block
from gradeframe.schemas import arrival
from gradeframe.sources.commits import Bucketed, Commits

RESPONSE_LINE = (
    "run_key string, uuid string, parent_uuid string, generated_text string, lm_loss double, arrival string, written long"
)
ROUND_LINE = "conv_id string, round int, content string, arrival string, written long"


COMPACT = 16
_SNAPSHOT = ""
_SUMS = "run_key string, hits long, groups long, loss double, losses long"
_KEYS = f"problem string, arrival string, {_SUMS}"
_OLD = "struct<hits:long,groups:long,loss:double,losses:long>"


class _Parts:
    """A table of what batches have added."""

    def __init__(self, store: Commits, name: str, schema: str, key: str | None = None):
        """With a key the rows that are added lie by it, in ``buckets`` buckets."""
        self.store, self.name, self.schema, self.key, self.buckets = store, name, schema, key, 0

    def before(self, batch_id: int) -> DataFrame:
        """What the batches before have added."""
        return self.store.read(self.schema, self.name, lambda part: part == _SNAPSHOT or int(part) < batch_id)

    def count(self, batch_id: int, snapshot: bool = False) -> int:
        """How many parts the batches before this one have left, the snapshot counted if asked."""
        records = self.store.records(self.name)
        if self.key and any(self.key not in r["columns"] for r in records):
            raise ValueError(f"{self.name} below {self.store.path} are of an earlier form, without {self.key}: build the sink anew")
        return sum(snapshot if r["part"] == _SNAPSHOT else int(r["part"]) < batch_id for r in records)

    def bucketed(self, batch_id: int) -> AbstractContextManager[Bucketed | None]:
        """What the batches before have added, where it lies."""
        return self.store.bucketed(self.name, self.key, lambda part: part == _SNAPSHOT or int(part) < batch_id)

    def add(self, df: DataFrame, batch_id: int) -> None:
        self.store.write(df, self.name, str(batch_id), buckets=self.buckets, key=self.key, dealt=True)

    def compact(self, batch_id: int, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Once enough batches have come, one snapshot stands in for all before this one."""
        if self.count(batch_id) >= COMPACT:
            merged = merge(self.before(batch_id))
            self.store.write(merged, self.name, _SNAPSHOT, replace=True, buckets=self.buckets, key=self.key)


def _start(lines: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Each batch's lines, with the file they come from, go to ``write``."""
    source = F.struct(
        F.unix_micros("_metadata.file_modification_time").alias("time"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    return (
        lines.withColumn("_file", source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _arrived(batch: DataFrame) -> DataFrame:
    """The batch's lines with the order of stored responses (``sources.files.read_responses``) in ``arrival``."""
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = F.coalesce("written", "_file.time")
    place = [F.coalesce("arrival", F.lit("")), F.col("_file.path"), arrival(F.col("_file.start") + index)]
    return batch.withColumn("arrival", F.concat_ws("/", arrival(written), *place)).drop("_file", "written")


def _problem() -> Column:
    """A problem's uuid and parent as one text: the length tells the parent's beginning, a mark that there is none. It
    begins like the uuid, so that it sorts fast. Null without a uuid."""
    parent = F.coalesce("parent_uuid", F.lit(""))
    length = F.coalesce(F.length("parent_uuid").cast("string"), F.lit("-"))
    return F.concat(F.col("uuid"), F.lit("/"), parent, F.lit("/"), length)


def _newest(rows: DataFrame, *by: Column) -> DataFrame:
    """The last row of each problem and run."""
    values = [c for c in rows.columns if c not in ("problem", "run_key", "arrival")]
    last = rows.groupBy(*by, "problem", "run_key").agg(F.max(F.struct("arrival", *values)).alias("_r"))
    return last.select("problem", "run_key", "_r.*")


def _newest_keys(rows: DataFrame) -> DataFrame:
    """The same, sorted by a hash of the problem first, as texts may begin alike."""
    return _newest(rows, F.xxhash64("problem")).select(*rows.columns)


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session's settings for a while."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: A write's shuffle files are of no use once it has ended.
_CLEANED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows that lie by problem are joined by problem and run where they are.
_IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("run_key").agg(*[F.sum(c).alias(c) for c in ("hits", "groups", "loss", "losses")])


def live_accuracy(
    spark: SparkSession,
    source: str,
    problems: DataFrame,
    sink: str,
    checkpoint: str,
    n_choices: int | None = None,
) -> StreamingQuery:
    """Running accuracy and loss per run over a folder of JSON response lines.

    The last response of a (run, uuid, parent) counts, as in the batch join, also if it comes batches later: the sums
    are corrected by what it adds less what the response before it had added. ``problems`` is a static table (uuid,
    parent_uuid, permutation, answer_idx[, choices]).

    The table of keys is bucketed by problem, in as many buckets from one snapshot to the next. Once it has parts, a batch's
    lines and the problems are moved to it, once each, and it is not moved itself. Where the number of choices is given,
    answers are parsed before the lines are moved.
    """
    lines = spark.readStream.schema(RESPONSE_LINE).json(source)
    static = problems.withColumn("problem", _problem()).drop("uuid", "parent_uuid")
    store = Commits(spark, sink)
    keys, sums = _Parts(store, "keys", _KEYS, "problem"), _Parts(store, "sums", _SUMS)
    names = ["arrival", "hits", "groups", "loss", "losses"]
    answer = "generated_text" if n_choices is None else "prediction_index"

    def answers(batch: DataFrame) -> DataFrame:
        rows = _arrived(batch).withColumn("problem", _problem()).where(F.col("problem").isNotNull())
        rows = rows if n_choices is None else parse_answers(rows, n_choices)
        return rows.select("problem", "run_key", "arrival", "lm_loss", answer)

    def scores(rows: DataFrame, problems: DataFrame) -> DataFrame:
        joined = _newest(rows).join(problems, "problem")
        return score_answers(joined, n_choices, parsed=n_choices is not None).groupBy("problem", "run_key", "arrival").agg(
            F.sum(F.col("hit").cast("long")).alias("hits"),
            F.count(F.lit(1)).alias("groups"),
            F.sum("lm_loss").alias("loss"),
            F.count("lm_loss").alias("losses"),
        )

    def changed(rows: DataFrame, known: list[DataFrame]) -> DataFrame:
        """The scores that are later than what is known, with what is known. A table of it has a problem and run once."""
        for i, table in enumerate(known):
            old = table.select("problem", "run_key", F.struct(*names).alias(f"_old{i}"))
            same = (F.col("r.problem") == F.col("k.problem")) & F.col("r.run_key").eqNullSafe(F.col("k.run_key"))
            rows = rows.alias("r").join(old.alias("k"), same, "left").select("r.*", f"_old{i}")
        olds = [f"_old{i}" for i in range(len(known))]
        # the last of them, as structs are compared by arrival first
        rows = rows.withColumn("_old", F.greatest(*olds) if len(olds) > 1 else F.col(olds[0]))
        later = rows.where(F.col("_old").isNull() | (F.col("arrival") > F.col("_old.arrival")))
        return later.withColumn("_old", F.col("_old").dropFields("arrival"))

    def write(batch: DataFrame, batch_id: int) -> None:
        with _set(batch.sparkSession, _CLEANED):
            add(batch, batch_id)

    def add(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        keys.buckets = int(session.conf.get("spark.sql.shuffle.partitions"))
        keys.compact(batch_id, _newest_keys)
        sums.compact(batch_id, _summed)
        with keys.bucketed(batch_id) as found, _set(session, _IN_PLACE if found else {}):
            if found:
                keys.buckets = found.buckets
            known = found.parts if found else [keys.before(batch_id)]
            if not found and keys.count(batch_id, True) > 1:
                known = [_newest(known[0])]
            rows = scores(answers(batch).repartition(keys.buckets, "problem"), static.repartition(keys.buckets, "problem"))
            rows = changed(rows, known).select("problem", "arrival", "run_key", *names[1:], "_old")
            keys.add(rows if found else rows.repartition(keys.buckets, "problem"), batch_id)
        # the part has been written: what it adds is read from it
        told = store.read(f"{_KEYS}, _old {_OLD}", "keys", lambda p: p == str(batch_id))
        less = [(F.coalesce(c, F.lit(0)) - F.coalesce(f"_old.{c}", F.lit(0))).alias(c) for c in names[1:]]
        sums.add(_summed(told.select("run_key", *less)), batch_id)

    return _start(lines, checkpoint, write)


def read_accuracy(spark: SparkSession, sink: str) -> DataFrame:
    total = _summed(Commits(spark, sink).read(_SUMS, "sums"))
    return total.select(
        "run_key",
        F.col("hits").alias("num_hits"),
        F.col("groups").alias("num_groups"),
        F.try_divide("loss", "losses").alias("avg_loss"),
        F.try_divide("hits", "groups").alias("accuracy"),
    )


_RUN = ["conv_id", "block", "first", "last"]


def _runs_schema() -> str:
    sums = []
    for m in ALL_METRICS:
        sums += [f"{m}_n long"] + [f"{m}_{k} double" for k in ("min", "max", "sum", "w", "s")] + [f"{m}_odd long"]
    return f"conv_id string, block long, first int, last int, rounds long, stopped boolean, {', '.join(sums)}"


def _merged_runs(runs: DataFrame) -> DataFrame:
    """Runs of rounds that follow each other without a gap, as one run: within a conversation and block."""
    ordered = Window.partitionBy("conv_id", "block").orderBy("first")
    begins = F.coalesce(F.col("first") > F.lag("last").over(ordered) + 1, F.lit(True))
    marked = runs.withColumn("_begins", begins)
    marked = marked.withColumn("_run", F.sum(F.col("_begins").cast("int")).over(ordered)).drop("_begins")
    keys = ["conv_id", "block", "_run"]
    sums = merge_blocks(marked.withColumn(BLOCK, F.col("first")).drop("first", "last"), keys)
    ends = marked.groupBy(*keys).agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return ends.join(sums, keys).select(*runs.columns)


def live_rounds(
    spark: SparkSession, source: str, sink: str, checkpoint: str
) -> StreamingQuery:
    """Running conversation scores over a folder of judge lines (conv_id, round, content).

    What is kept is a row of sums per run of rounds without a gap, in blocks of 4096 rounds: rounds may arrive in any
    order, and sums of neighbouring runs combine exactly, but not over a gap, into which a round may still come. The runs
    also tell which rounds have been seen: the first verdict on a round counts, later ones are dropped.
    """
    lines = spark.readStream.schema(ROUND_LINE).json(source)
    parts = _Parts(Commits(spark, sink), "runs", _runs_schema())

    def write(batch: DataFrame, batch_id: int) -> None:
        parts.compact(batch_id, _merged_runs)
        first = F.min_by("content", "arrival").alias("content")
        rows = _arrived(batch).groupBy("conv_id", "round").agg(first).withColumn("block", int_block(F.col("round")))
        seen = parts.before(batch_id).select(*_RUN)
        inside = F.col("r.round").between(F.col("s.first"), F.col("s.last"))
        same = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & F.col("r.block").eqNullSafe(F.col("s.block"))
        fresh = rows.alias("r").join(seen.alias("s"), same & inside, "left_anti")
        # rounds in a row have the same difference of round and number
        nth = F.row_number().over(Window.partitionBy("conv_id", "block").orderBy("round"))
        judged = parse_judge(fresh.withColumn("_run", F.col("round") - nth))
        keys = ["conv_id", "block", "_run"]
        ends = judged.groupBy(*keys).agg(F.min("round").alias("first"), F.max("round").alias("last"))
        sums = block_sums(judged, keys=keys).drop(BLOCK)
        null_safe = [F.col(f"e.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
        told = ends.alias("e").join(sums.alias("t"), null_safe).select(
            *[f"e.{c}" for c in _RUN], *[f"t.{c}" for c in sums.columns if c not in keys]
        )
        parts.add(told, batch_id)

    return _start(lines, checkpoint, write)


def read_rounds(spark: SparkSession, sink: str) -> DataFrame:
    """One row per conversation, as ``conversation_wide`` gives it for the whole table."""
    runs = Commits(spark, sink).read(_runs_schema(), "runs")
    return combine_blocks(runs.withColumn(BLOCK, F.col("first")).drop("block", "first", "last"))
