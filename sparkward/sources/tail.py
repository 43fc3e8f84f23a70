"""Session logs that grow in place, as a data source: each whole line of each file once.

An offset says how far each file's whole lines reach, and by checksums of its first bytes which file it is. What
a batch reads follows from two offsets alone, so a batch that runs again after a restart reads the same bytes:
a file that got shorter, or whose beginning is another, is read anew; one that is gone is forgotten. A tail without
a line break waits for more. What a file grew by is cut into pieces of PIECE bytes, each read by a task of its
own; a line belongs to the piece in which it starts. Lines of more than LONGEST bytes give a row without a text.

A file that is replaced while its lines are being read gives what is left of them. One that is replaced by a longer one
with the same first bytes (4096 of them, if both have as many) can't be told from one that grew.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at bigint, line string"
#: Bytes of a piece, and of the longest line.
PIECE, LONGEST = 64 << 20, 10 << 20
#: Of how many first bytes an offset holds checksums.
MARKS = (16, 64, 256, 1024, 4096)
BLOCK = 1 << 16


@dataclass
class Piece(InputPartition):
    """Lines of a file that start in [start, stop); fresh: a line starts at start."""

    file: str
    start: int
    stop: int
    fresh: bool


class Folder:
    """The log files below a path."""

    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path, suffix

    def opened(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path:
            system, top = fs.FileSystem.from_uri(self.path)
        else:
            system, top = fs.LocalFileSystem(), self.path.removeprefix("file:")
        return system, top.rstrip("/")

    def offsets(self) -> dict:
        """By file: how far its whole lines reach, and its marks."""
        system, top = self.opened()
        found = system.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
        out = {}
        for info in found:
            if info.type != fs.FileType.File or not info.path.endswith(self.suffix):
                continue
            if isinstance(system, fs.LocalFileSystem) and not os.path.realpath(info.path).startswith(os.path.realpath(top) + os.sep):
                continue  # a link that leads out
            try:
                with system.open_input_file(info.path) as f:
                    at = last_break(f, f.size())
                    head = f.read_at(min(at, MARKS[-1]), 0)
            except FileNotFoundError:
                continue
            out[info.path[len(top) + 1 :]] = {"at": at, "marks": ",".join(f"{crc32(head[:n]):08x}" for n in MARKS if n <= at)}
        return out

    def lines(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        system, top = self.opened()
        rows, size = [], 0
        try:
            f = system.open_input_file(f"{top}/{piece.file}")
        except FileNotFoundError:
            return
        with f:
            for at, line in split_lines(f, piece):
                rows.append((piece.file, at, None if line is None else line.decode(errors="replace")))
                size += len(line or b"")
                if size >= 1 << 20 or len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    files, at, lines = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(at, pa.int64()), pa.array(lines, pa.string())], ["file", "at", "line"])


def last_break(f, size: int) -> int:
    """Where the last whole line of the first `size` bytes ends."""
    while size > 0:
        start = max(0, size - BLOCK)
        found = f.read_at(size - start, start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        size = start
    return 0


def split_lines(f, piece: Piece) -> Iterator[tuple[int, bytes | None]]:
    """(start, line) of the lines that start in a piece; without bytes for too long ones."""
    at = piece.start if piece.fresh else piece.start - 1
    held, begun, over, skip = [], at, 0, not piece.fresh  # parts of the line at hand, where it began, its size, whether it is another piece's
    while begun < piece.stop:
        block = f.read_at(BLOCK, at)
        if not block:
            return
        parts = block.split(b"\n")
        for k, part in enumerate(parts):
            if over <= LONGEST:
                held.append(part)
            over += len(part)
            if k == len(parts) - 1:
                break
            if not skip:
                yield begun, b"".join(held) if over < LONGEST else None
            begun, held, over, skip = begun + over + 1, [], 0, False
            if begun >= piece.stop:
                return
        at += len(block)


def pieces(start: dict, end: dict) -> list[Piece]:
    """What lies between two offsets."""
    out = []
    for file, now in sorted(end.items()):
        was = start.get(file, {"at": 0, "marks": ""})
        known, seen = was["marks"].split(","), now["marks"].split(",")
        same = was["at"] <= now["at"] and (not was["marks"] or known == seen[: len(known)])
        at = was["at"] if same else 0
        for k in range(at, now["at"], PIECE):
            out.append(Piece(file, k, min(k + PIECE, now["at"]), k == at))
    return out


class Reader(DataSourceReader):
    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def partitions(self) -> list[Piece]:
        return pieces({}, self.folder.offsets()) or [Piece("", 0, 0, True)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition) if partition.file else iter(())


class StreamReader(DataSourceStreamReader):
    def __init__(self, folder: Folder) -> None:
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.folder.offsets()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        return pieces(start, end)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return self.folder.lines(partition)


class JsonlTail(DataSource):
    """file, at, line of the log files below `path` whose names end in `suffix` (.jsonl)."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def folder(self) -> Folder:
        return Folder(self.options["path"], self.options.get("suffix", ".jsonl"))

    def reader(self, schema) -> Reader:
        return Reader(self.folder())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.folder())


def tailed(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """Lines of the logs below path: what there is now, or as they grow."""
    spark.dataSource.register(JsonlTail)
    reader = spark.readStream if stream else spark.read
    return reader.format("jsonl_tail").option("path", path).load()


def caught_up(lines: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Writes the lines that there are by now to files in `out`, and goes on from the checkpoint when called again."""
    lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return lines.sparkSession.read.schema(SCHEMA).parquet(out)


def written(lines: DataFrame, path: str, whole: bool = True) -> None:
    """Writes logs (file, place, line) below path, each file anew by one task, in order of place; unless whole, each without its last few bytes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = Folder(path, "").opened()
        at, f, last = None, None, b""

        def close() -> None:
            if f is not None:
                f.write(last if whole else last[: len(last) // 2])
                f.close()

        for batch in batches:
            for file, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist()):
                if file != at:
                    close()
                    system.create_dir(f"{top}/{file}".rsplit("/", 1)[0], recursive=True)
                    at, f, last = file, system.open_output_stream(f"{top}/{file}"), b""
                f.write(last)
                last = line.encode() + b"\n"
        close()
        yield pa.RecordBatch.from_arrays([pa.array([0])], ["n"])

    rows = lines.repartition("file").sortWithinPartitions("file", "place").select("file", "line").mapInArrow(write, "n long")
    rows.write.format("noop").mode("overwrite").save()
