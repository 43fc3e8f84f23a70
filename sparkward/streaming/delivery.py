"""Delivery of a stream's payloads to a receiver, as a sink.

Each task posts its rows, with their ids as keys by which a receiver can tell repeats; one that isn't taken is tried
again, later and later. What is still not taken goes to a file of the task in the folder of dead letters. A batch
counts by a list of its tasks' files, so that files of tasks that ran again in vain are not read, and a batch that
runs again replaces its list. Only counts and names of files come to the driver.

Once a row was given up, the rest of its task's rows are tried once each, so a receiver that is down doesn't hold a
batch up for all retries of all rows. A task that runs again sends its rows again, with the same ids.
"""

from __future__ import annotations

import json
import random
import time
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..operators.sinks import is_public

LETTERS = "id string, payload string, error string"


@dataclass
class Sent(WriterCommitMessage):
    taken: int
    given_up: int
    file: str | None


def opened(path: str) -> tuple[fs.FileSystem, str]:
    system, top = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system, top.rstrip("/")


class Poster(DataSourceStreamWriter):
    def __init__(self, url: str, dead: str, retries: int, wait: float, headers: dict[str, str]) -> None:
        self.url, self.dead, self.retries, self.wait, self.headers = url, dead, retries, wait, headers

    def post(self, row: Row, retries: int) -> str | None:
        """What is wrong, if the receiver didn't take it."""
        said = None
        for attempt in range(retries + 1):
            try:
                ask = urllib.request.Request(self.url, row.payload.encode(), {"Content-Type": "application/json", "Idempotency-Key": row.id} | self.headers)
                urllib.request.urlopen(ask, timeout=5).close()
                return None
            except OSError as e:
                said = str(e)
                if attempt < retries:
                    time.sleep(min(self.wait * 2**attempt, 10) * (0.5 + random.random() / 2))
        return said

    def write(self, iterator: Iterator[Row]) -> Sent:
        taken, given_up, out, name, retries = 0, 0, None, f"letters-{uuid.uuid4().hex}.jsonl", self.retries
        for row in iterator:
            error = self.post(row, retries)
            if error is None:
                taken += 1
                continue
            retries = 0
            if out is None:
                system, top = opened(self.dead)
                system.create_dir(f"{top}/letters", recursive=True)
                out = system.open_output_stream(f"{top}/letters/{name}")
            out.write(json.dumps({"id": row.id, "payload": row.payload, "error": error}).encode() + b"\n")
            given_up += 1
        if out is not None:
            out.close()
        return Sent(taken, given_up, name if given_up else None)

    def commit(self, messages: list[Sent | None], batchId: int) -> None:
        sent = [m for m in messages if m is not None]
        system, top = opened(self.dead)
        system.create_dir(f"{top}/batches", recursive=True)
        files = [m.file for m in sent if m.file]
        line = {"batch": batchId, "taken": sum(m.taken for m in sent), "given_up": sum(m.given_up for m in sent), "files": files}
        with system.open_output_stream(f"{top}/batches/{batchId}.json") as f:
            f.write(json.dumps(line).encode() + b"\n")

    def abort(self, messages: list[Sent | None], batchId: int) -> None:
        """Nothing counts: the batch will run again."""


class Receiver(DataSource):
    """A sink that posts rows (id, payload)."""

    @classmethod
    def name(cls) -> str:
        return "receiver"

    def streamWriter(self, schema, overwrite: bool) -> Poster:
        o = self.options
        return Poster(o["url"], o["dead"], int(o.get("retries", "2")), float(o.get("wait", "0.5")), json.loads(o.get("headers", "{}")))


def delivered(payloads: DataFrame, url: str, dead: str, checkpoint: str, retries: int = 2, wait: float = 0.5, headers: dict[str, str] | None = None, private: bool = False) -> StreamingQuery:
    """Starts to post a stream's rows (id, payload). Receivers on private hosts are refused unless `private`."""
    spark = payloads.sparkSession
    if not private and not spark.range(1).select(is_public(F.lit(url))).first()[0]:
        raise ValueError(f"not a public address: {url}")
    spark.dataSource.register(Receiver)
    rows = payloads.select("id", "payload").where("id is not null and payload is not null")
    options = {"url": url, "dead": dead, "retries": str(retries), "wait": str(wait), "headers": json.dumps(headers or {}), "checkpointLocation": checkpoint}
    return rows.writeStream.format("receiver").options(**options).trigger(availableNow=True).start()


def batches(spark: SparkSession, dead: str) -> DataFrame:
    """batch, taken, given_up, files of each batch that counts."""
    return spark.read.schema("batch bigint, taken bigint, given_up bigint, files array<string>").json(f"{dead}/batches")


def dead_letters(spark: SparkSession, dead: str) -> DataFrame:
    """id, payload, error of what no receiver took, of batches that count."""
    files = batches(spark, dead).select(F.explode("files").alias("file"))
    try:
        letters = spark.read.schema(LETTERS).json(f"{dead}/letters")
    except Exception as e:  # all was taken
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LETTERS)
    return letters.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).join(files, "file", "left_semi").select("id", "payload", "error")
