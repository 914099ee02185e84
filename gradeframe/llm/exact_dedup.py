"""Exact dedup: a persistent digest index, bucketed and sorted by hash, that new data is anti-joined with.

The index is a table of one row per distinct text (digest, keep_id, group_size, batch, seq) in Parquet, bucketed and
sorted by the SHA-256 of the whole text. A batch of new rows is reduced to one row for each digest (aggregated before it
is shuffled, so a text held by a third of all rows is one row per task), joined against the index by a sort-merge
anti-join, for which the index needs no shuffle, and what is new is appended. What a batch adds to texts of earlier ones
goes to a second table, bucketed alike, so that group sizes add up over batches. Rows of a batch get their group's row
back by a join on the digest alone; Spark splits a hot digest there, as both sides are dealt for the join.

A batch may be named. Names have a number, in the order in which they first came; only rows of batches with a smaller
number are earlier ones. A batch that is given again under its name, after a lost job say, gets the rows it got before
and adds nothing; it must hold the same rows. One writer at a time.

Null counts as the empty text. Of equal texts in a batch the largest doc_id stays; of repeated rows with that doc_id one
stays. A text that an earlier batch brought stays there, keep_id is the id that stays there, and none of the new batch is
kept. Null doc_ids come below all others. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.llm.rows import KEY, apart, fresh_name, keyed, prepared, written
from gradeframe.session import fresh_dir

BUCKETS = 64
_SCHEMA = "digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING, seq BIGINT"


def digest_of(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


class DigestIndex:
    """Tables of the digests seen so far. `name` is a table of the session's catalog, what later batches add to its texts
    is in `name`_more; new ones are made if missing."""

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int = BUCKETS):
        self.spark, self.name, self.buckets = prepared(spark), name or fresh_name("digest_index"), buckets
        self.more = f"{self.name}_more"
        for table in (self.name, self.more):
            if not spark.catalog.tableExists(table):
                self._append(table, spark.createDataFrame([], _SCHEMA))

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def _append(self, table: str, rows: DataFrame) -> None:
        rows = rows.repartition(self.buckets, "digest")
        writer = rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
        if not self.spark.catalog.tableExists(table):
            writer = writer.option("path", fresh_dir(self.spark, table))
        writer.saveAsTable(table)

    def _number(self, batch: str) -> tuple[int, bool]:
        """The batch's number, and whether it has been there, in whole or in part."""
        both = self.table().unionByName(self.spark.table(self.more))
        had, last = both.agg(F.max(F.when(F.col("batch") == batch, F.col("seq"))), F.max("seq")).first()
        return (had, True) if had is not None else ((last or 0) + 1, False)

    def ingest(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batch: str | None = None) -> DataFrame:
        """Adds a batch. Returns (key, digest, keep_key, keep_id, group_size, known) for each of its rows, where known
        says that an earlier batch has the text; the batch's rows must have `__row_key` (see rows.keyed)."""
        batch = batch or fresh_name("batch")
        seq, again = self._number(batch)
        marked = docs.select(F.col(KEY), F.col(doc_id).alias("id"), digest_of(text).alias("digest"))
        groups = written(
            marked.groupBy("digest").agg(
                F.max(KEY).alias("keep_key"), F.max("id").alias("keep_id"), F.count("*").alias("group_size")
            ),
            "digest_groups",
        )
        earlier = self.table().filter(F.col("seq") < seq)
        new = groups.join(earlier.hint("merge"), "digest", "left_anti").withColumn("known", F.lit(False))
        first = earlier.select("digest", F.col("keep_id").alias("first_id"), F.col("group_size").alias("before"))
        known = groups.join(first.hint("merge"), "digest")
        more = self.spark.table(self.more).filter(F.col("seq") < seq)
        more = more.groupBy("digest").agg(F.sum("group_size").alias("since"))
        known = known.join(more.hint("merge"), "digest", "left").select(
            "digest",
            "keep_key",
            F.col("first_id").alias("keep_id"),
            (F.col("group_size") + F.col("before") + F.coalesce("since", F.lit(0))).alias("group_size"),
            F.lit(True).alias("known"),
        )
        settled = written(new.unionByName(known), "digests_settled")
        for table, now in ((self.name, False), (self.more, True)):
            mine = settled.filter(F.col("known") == now).select("digest").join(groups, "digest")
            mine = mine.select("digest", "keep_id", "group_size", F.lit(batch).alias("batch"), F.lit(seq).alias("seq"))
            if again:  # only what a lost job left out
                had = self.spark.table(table).filter(F.col("seq") == seq)
                mine = written(mine.join(had.hint("merge"), "digest", "left_anti"), "digests_left_out")
            self._append(table, mine)
        return marked.join(settled.hint("merge"), "digest")


def digest(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row per document: the id that stays, the group's size, whether this row stays, the text's SHA-256."""
    index = index or DigestIndex(docs.sparkSession)
    got = index.ingest(keyed(docs.select("doc_id", "text")), batch=batch)
    return got.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col(KEY) == F.col("keep_key")) & ~F.col("known")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows that stay, columns as they were, whatever their names."""
    index = index or DigestIndex(docs.sparkSession)
    rows = keyed(apart(docs, "doc_id", "text"))
    got = index.ingest(rows, batch=batch)
    kept = got.filter((F.col(KEY) == F.col("keep_key")) & ~F.col("known")).select(KEY)
    return rows.join(kept, KEY, "left_semi").drop(KEY).toDF(*docs.columns)
