"""Lines of logs, read by byte ranges: a file is as many partitions as its size asks for.

    spark.dataSource.register(LogLines)
    spark.read.format("log_lines").option("path", folder).load()

A range holds the lines whose first byte lies in it, so each line belongs to one range wherever a range is cut. Files are
chosen while partitions are planned: by suffix, by depth below the folder, and by time of change; newest first. A line is
known by its range and its place in it; `numbered` turns that into line numbers of the file, by sums over the ranges
before. Bytes that are no UTF-8 are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from sessionlake.sources.markdown import opened

SPLIT_BYTES, BLOCK, BATCH_BYTES = 64 << 20, 1 << 20, 8 << 20
SCHEMA = "path string, mtime long, range int, place long, line string"


@dataclass
class Range(InputPartition):
    path: str
    mtime: int
    index: int
    start: int
    end: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    parts: list[Range]


def log_files(path: str, suffix: str, max_depth: int, modified_after: float | None) -> list[tuple[str, float, int]]:
    """(path, time, bytes) of the files in at most max_depth folders below a folder, newest first; no such folder, no files."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = opened(path)
    found, level = [], [root]
    for depth in range(max_depth + 1):
        below = []
        for folder in level:
            for info in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
                if info.type == FileType.Directory:
                    below.append(info.path)
                elif info.type == FileType.File and info.path.endswith(suffix):
                    changed = info.mtime.timestamp() if info.mtime else 0.0
                    if modified_after is None or changed > modified_after:
                        found.append((info.path, changed, info.size))
        level = below
        if not level:
            break
    return sorted(found, key=lambda f: (-f[1], f[0]))


def lines_of(stream, start: int, end: int) -> Iterator[bytes]:
    """The lines that begin in [start, end); a line is what stands between line ends, the last one may be empty."""
    at = start
    if start:
        stream.seek(start - 1)
        at = start - 1
    rest, skipping, size = b"", start > 0, max(1, min(BLOCK, end - start + 1))
    while True:
        block = stream.read(size)  # no more than a short range needs, then what its last line takes
        size = min(BLOCK, size * 2)
        if not block:
            break
        rest += block
        if skipping:
            cut = rest.find(b"\n")
            if cut < 0:
                at, rest = at + len(rest), b""
                if at >= end:
                    return
                continue
            at, rest, skipping = at + cut + 1, rest[cut + 1 :], False
        *whole, rest = rest.split(b"\n")
        for line in whole:
            if at >= end:
                return
            yield line
            at += len(line) + 1
    if not skipping and at < end:
        yield rest


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.options = options["path"], options

    def partitions(self) -> list[Ranges]:
        o = self.options
        split = int(o.get("split_bytes", SPLIT_BYTES))
        after = float(o["modified_after"]) if o.get("modified_after") else None
        out = []
        for path, changed, size in log_files(self.path, o.get("suffix", ".jsonl"), int(o.get("max_depth", 12)), after):
            seconds = int(changed) if changed >= 0 else -int(-changed)
            out += [Range(path, seconds, k, at, min(size, at + split)) for k, at in enumerate(range(0, size, split))]
        most, tasks, size = int(o.get("task_bytes", 0)), [], 0
        for part in out:
            size += part.end - part.start
            if not tasks or size > most:
                tasks.append(Ranges([]))
                size = part.end - part.start
            tasks[-1].parts.append(part)
        return tasks or [Ranges([])]

    def read(self, task: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        for part in task.parts:
            yield from self.lines(fs, part)

    @staticmethod
    def lines(fs, part: Range) -> Iterator[pa.RecordBatch]:
        lines, size, place = [], 0, 0

        def batch() -> pa.RecordBatch:
            n = len(lines)
            columns = [pa.array([part.path] * n), pa.array([part.mtime] * n, pa.int64()), pa.array([part.index] * n, pa.int32()), pa.array(range(place - n, place), pa.int64()), pa.array(lines, pa.string())]
            return pa.RecordBatch.from_arrays(columns, names=["path", "mtime", "range", "place", "line"])

        with fs.open_input_file(part.path) as stream:
            for line in lines_of(stream, part.start, part.end):
                lines.append(line.decode("utf-8", "replace"))
                size, place = size + len(line), place + 1
                if size > BATCH_BYTES or len(lines) >= 10_000:
                    yield batch()
                    lines, size = [], 0
        if lines:
            yield batch()


class LogLines(DataSource):
    """Options: path, suffix (.jsonl), max_depth (12), modified_after (seconds), split_bytes (64 MB), task_bytes (ranges that a task reads together; one by default)."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def numbered(rows: DataFrame) -> DataFrame:
    """(path, mtime, line_no, line): a range's numbers start after the lines of the file's ranges before it."""
    counts = rows.groupBy("path", "range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(counts.select("path", "range", before.alias("before")), ["path", "range"]).select("path", "mtime", (F.col("before") + F.col("place")).alias("line_no"), "line")


def read(spark: SparkSession, path: str, **options: str | int | float) -> DataFrame:
    """(path, mtime, line_no, line) of the logs below a folder; see LogLines for the options."""
    spark.dataSource.register(LogLines)
    return numbered(spark.read.format("log_lines").option("path", path).options(**{k: str(v) for k, v in options.items()}).load())
