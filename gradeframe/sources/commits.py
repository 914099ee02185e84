"""Tables made of finished writes.

Every write goes to a folder of its own below ``data``; only after it has ended does a record of it appear below
``_commits`` (before, ``commits``), in a folder of its own, too, so that writers never share one. Spark passes over that
name, so that all that was ever written can be read as one Parquet table. Readers take the folders on record: a job that
ends half-way leaves them what was there before.

A table's name may have parts. The newest record of a (name, part) counts, so that a repeated write changes nothing, and
a record that replaces the name makes all earlier ones void. Newer is by the writers' clocks, then by the record's id.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

_RECORD = "name string, part string, folder string, at long, id string, replaces boolean, columns string, buckets int"


class Bucketed(NamedTuple):
    parts: list[DataFrame]
    buckets: int


@dataclass(frozen=True)
class Commits:
    """The committed tables below a path that all executors see."""

    spark: SparkSession
    path: str

    def write(
        self,
        df: DataFrame,
        name: str,
        part: str = "",
        replace: bool = False,
        partition_by: Sequence[str] = (),
        buckets: int = 0,
        key: str | None = None,
        dealt: bool = False,
    ) -> None:
        """Write the rows as a part of the table; with ``replace`` they are all that the table has. With ``buckets`` the
        part is bucketed by ``key``, for ``bucketed``; with ``dealt`` the rows lie together by ``key`` already and are not
        moved."""
        folder = f"data/_of={uuid.uuid4().hex}"
        if buckets:
            table = f"gradeframe_{uuid.uuid4().hex}"
            writer = (df if dealt else df.repartition(buckets, key)).write.bucketBy(buckets, key).sortBy(key)
            writer.option("compression", "zstd").option("path", f"{self.path}/{folder}").saveAsTable(table)
            self.spark.sql(f"DROP TABLE {table}")
        else:
            df.write.partitionBy(*partition_by).parquet(f"{self.path}/{folder}")
        record = (name, part, folder, time.time_ns(), uuid.uuid4().hex, replace, df.schema.toDDL(), buckets)
        rows = self.spark.createDataFrame([record], _RECORD).coalesce(1)
        rows.write.parquet(f"{self.path}/_commits/{record[3]:020d}-{record[4]}")

    def records(self, name: str | None = None) -> list[dict]:
        """The records that count, of one table or of all, the oldest first: one for each write, whatever it holds."""
        try:
            rows = self.spark.read.schema(_RECORD).parquet(f"{self.path}/{{_commits,commits}}/*")
        except AnalysisException as missing:
            if missing.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        if name is not None:
            rows = rows.where(rows["name"] == name)
        counted: dict[tuple[str, str], dict] = {}
        for row in sorted(rows.collect(), key=lambda r: (r["at"], r["id"])):
            if row["replaces"]:
                counted = {k: v for k, v in counted.items() if k[0] != row["name"]}
            counted.pop((row["name"], row["part"]), None)
            counted[row["name"], row["part"]] = row.asDict()
        return list(counted.values())

    def read(
        self, schema: str | T.StructType | None = None, name: str | None = None, parts: Callable[[str], bool] | None = None
    ) -> DataFrame:
        """The rows of a table, or of all, as of now; none if nothing has been committed. Without a schema it is the one
        that the newest write had. ``parts`` tells which of them to read."""
        records = [r for r in self.records(name) if parts is None or parts(r["part"])]
        if schema is None:
            if not records:
                raise LookupError(f"nothing has been committed to {name or 'any table'} below {self.path}")
            schema = records[-1]["columns"]
        if not records:
            return self.spark.createDataFrame([], schema)
        wanted = self.spark.createDataFrame([], schema).columns
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*[f"{self.path}/{r['folder']}" for r in records]).select(*wanted)

    @contextmanager
    def bucketed(self, name: str, key: str, parts: Callable[[str], bool] | None = None) -> Iterator[Bucketed | None]:
        """A table's parts, which were written in buckets, known to the catalog as such meanwhile: each joins and groups by
        its key without moving. ``parts`` tells which of them to read. None if there is none, or not all are in the same
        number of buckets."""
        records = [r for r in self.records(name) if parts is None or parts(r["part"])]
        if not records or len({r["buckets"] for r in records}) > 1 or not records[0]["buckets"]:
            yield None
            return
        tables: list[str] = []
        try:
            for r in records:
                tables.append(f"gradeframe_{uuid.uuid4().hex}")
                self.spark.sql(
                    f"CREATE TABLE {tables[-1]} ({r['columns']}) USING parquet "
                    f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {r['buckets']} BUCKETS LOCATION '{self.path}/{r['folder']}'"
                )
            yield Bucketed([self.spark.table(t) for t in tables], records[0]["buckets"])
        finally:
            for table in tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
