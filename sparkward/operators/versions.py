"""Tables that change while others read them: events, dismissals, baselines.

A change writes the rows of the next version to a folder of their own, and is made by one row that is appended to
the table's log: number, batch, folder. A writer that fails before that row has changed nothing, and a batch
that is in the log already changes nothing when it comes again. Readers see the version that the log names last.
A table has one writer at a time (as a streaming query is).

Logs are tables too, of one small row a change; `trimmed` keeps the last of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .routing import FIELDS, active

LOG = "version bigint, batch string, folder string, n bigint"


class Versions:
    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def log(self) -> DataFrame:
        empty = self.spark.createDataFrame([], LOG)
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        except Exception as e:  # no change was made yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return empty

    def last(self) -> tuple[int, str | None]:
        row = self.log().orderBy(F.desc("version")).select("version", "folder").first()
        return (row.version, row.folder) if row else (0, None)

    def read(self) -> DataFrame:
        folder = self.last()[1]
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}") if folder else self.spark.createDataFrame([], self.schema)

    def change(self, batch: str, made: Callable[[DataFrame], DataFrame]) -> bool:
        """The table as `made` makes it of what it is, unless the batch was there before."""
        if not self.log().where(F.col("batch") == batch).isEmpty():
            return False
        version, _ = self.last()
        folder = f"rows-{version + 1}-{uuid.uuid4().hex}"
        made(self.read()).write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/{folder}").count()
        self.spark.createDataFrame([(version + 1, batch, folder, n)], LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return True


    def live(self) -> DataFrame:
        """The table as it is whenever it is read: beside a stream, as of each batch. For managed lists, which one task reads."""
        self.spark.dataSource.register(VersionSource)
        return self.spark.read.format("versioned_table").schema(self.schema).option("path", self.path).load()


class VersionReader(DataSourceReader):
    """Finds the version when it reads, not when it is planned: a stream plans what stands beside it once."""

    def __init__(self, path: str, schema: pa.Schema) -> None:
        self.path, self.schema = path, schema

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path.removeprefix("file:"))
        if system.get_file_info(f"{top}/log").type == fs.FileType.NotFound:
            return
        log = pads.dataset(f"{top}/log", filesystem=system, format="parquet").to_table(columns=["version", "folder"]).to_pylist()
        if log:
            folder = max(log, key=lambda r: r["version"])["folder"]
            yield from pads.dataset(f"{top}/{folder}", schema=self.schema, filesystem=system, format="parquet").to_batches()


class VersionSource(DataSource):
    """The last version of a table of Versions below `path`."""

    @classmethod
    def name(cls) -> str:
        return "versioned_table"

    def reader(self, schema) -> VersionReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return VersionReader(self.options["path"], to_arrow_schema(schema))


def put(rows: DataFrame, new: DataFrame, key: str, order: str, most: int | None = None) -> DataFrame:
    """rows with new ones: those of known keys take their place, of equal keys the last; then the oldest give way down to `most`.

    The table's column `place` says when a key came. A batch is put as a whole: what it brings and drives out is gone.
    """
    columns = rows.columns
    last = new.groupBy(key).agg(F.max(order).alias(order), F.min(order).alias("_came"))
    last = new.join(last, [key, order], "left_semi").dropDuplicates([key]).join(last.select(key, "_came"), key)
    known = rows.select(F.col(key), F.col("place").alias("_place"))
    came = last.join(known, key, "left").withColumn("place", F.coalesce("_place", "_came")).select(*columns)
    out = rows.join(came.select(key), key, "left_anti").select(*columns).unionByName(came)
    return out.orderBy(F.desc("place"), F.desc(key)).limit(most) if most is not None else out


def added(dismissals: DataFrame, new: DataFrame, now_ms: int, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(dismissals with new ones, new ones that are refused with the reason). new: in order of `place`.

    Those that name no field are refused. Where all would be over `most`, what has expired goes first; then only the
    first of the new ones are taken. Both are managed lists.
    """
    named = F.concat(*[F.coalesce(F.col(f), F.lit("")) for f in FIELDS]) != ""
    fit = new.where(named)
    there, more = dismissals.count(), fit.count()
    if there + more > most:
        dismissals, fit = active(dismissals, now_ms), active(fit, now_ms)
        there = dismissals.count()
    taken = fit.orderBy("place", "id").limit(max(0, most - there))
    no_room = fit.join(taken.select("id", "place"), ["id", "place"], "left_anti").withColumn("reason", F.lit(f"maximum of {most} patterns reached"))
    no_field = new.where(~named).withColumn("reason", F.lit("at least one of rule, tool and skill has to be named"))
    return dismissals.unionByName(taken.select(*dismissals.columns)), no_room.unionByName(no_field.select(*no_room.columns))


def swept(dismissals: DataFrame, now_ms: int) -> DataFrame:
    """Dismissals without those that have expired."""
    return active(dismissals, now_ms)


def fed(events: DataFrame) -> DataFrame:
    """What watchers are told of each event: id, message. Line breaks in ids can't start another message."""
    clean = F.regexp_replace(F.coalesce(F.col("id"), F.lit("")), "[\r\n]", "")
    shown = {"id": "id", "timestamp": "ts_ms", "severity": "severity", "category": "category", "title": "title", "action": "action", "ruleName": "rule_name", "toolName": "tool_name"}
    message = F.to_json(F.struct(*[F.col(c).alias(name) for name, c in shown.items()]))
    return events.select(clean.alias("id"), message.alias("message"))
