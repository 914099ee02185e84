"""Row identity and written intermediate tables for the operators of this package."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeframe.session import fresh_dir, tune

KEY = "__row_key"


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once an application: their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="modules-")) / f"{fresh_name(package.name)}.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for module in sorted(package.rglob("*.py")):
            file.write(module, module.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings that the operators count on: adaptive plans and Arrow batches of bounded size; and the package's
    modules on the executors."""
    tune(spark)
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, *needed: str) -> DataFrame:
    """The rows with all columns but the needed ones under names by place, which no operator uses for its own;
    `toDF(*docs.columns)` gives them their names back."""
    return docs.toDF(*(c if c in needed else f"__column_{i}" for i, c in enumerate(docs.columns)))


def fresh_name(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with a unique long in `__row_key`, in the order of doc_id.

    Where doc_id is unique and never null it is the key itself. Else the rows are sorted by doc_id (null first) and a
    hash of the text, numbered, and written, so that the numbers stay the same in every later read; rows that agree
    in both stay apart.
    """
    prepared(docs.sparkSession)
    integer = dict(docs.dtypes)[doc_id] in ("bigint", "int", "smallint", "tinyint")
    if integer:
        odd = docs.groupBy(F.col(doc_id).alias("id")).count().filter("id IS NULL OR count > 1")
        if odd.isEmpty():
            return docs.select("*", F.col(doc_id).cast("long").alias(KEY))
    ordered = docs.orderBy(F.col(doc_id).asc_nulls_first(), F.xxhash64(text))
    return written(ordered.withColumn(KEY, F.monotonically_increasing_id()), "keyed")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node reaches.

    Large-star and small-star steps: each round links every node to the smallest of its neighbourhood and writes the
    links, so that no task holds a component and a lost executor costs one round at most. Ends when no link changes.
    """
    links = written(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct(), "links"
    )
    before = None
    while True:
        # every larger neighbour of a node is linked to the smallest of node and neighbours
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every smaller neighbour of a node, and the node, are linked to the smallest neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        links = written(
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .filter("a != b")
            .distinct(),
            "links",
        )
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
