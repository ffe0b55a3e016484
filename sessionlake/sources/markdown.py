"""The sink of summaries: one Markdown file a session, all of a sweep's files or none.

    spark.dataSource.register(SummaryFiles)
    rows.write.format("summary_files").mode("append").option("path", archive).option("run", run_id).save()

Rows are (archive_path, body, replaces): a path below the archive, the file's text, and the path of the file that it
takes the place of, or null. A task writes below a staging folder of its own attempt and tells the driver that folder's
name only. A commit moves what the committed attempts have written to its place and removes what was replaced; an abort
removes the staging folder. Attempts that were lost or doubled are never moved; what they or a run that died have left
in the staging folder, which no reader sees, is removed by the next write of the same name. A commit that is repeated has
the same result.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

STAGING, REPLACED = "_staging", "_replaced.jsonl"
#: Files that a task holds at once, and tasks that list folders.
READ_FILES, MOST_TASKS = 500, 1000


def opened(path: str):
    """(filesystem, path) of a folder that all executors share: a path, or a URI that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path).rstrip("/"))


def checked(path: str) -> str:
    """A path below the archive; anything that would leave it is an error."""
    parts = path.split("/")
    if not path or any(p in ("", ".", "..") for p in parts) or parts[0] == STAGING:
        raise ValueError(f"not a path below the archive: {path!r}")
    return path


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    files: int
    bytes: int


class Writer(DataSourceWriter):
    def __init__(self, target: str, run: str):
        self.target, self.run = target, run

    def clear(self) -> None:
        fs, root = opened(self.target)
        from pyarrow.fs import FileType

        staging = f"{root}/{STAGING}/{self.run}"
        if fs.get_file_info(staging).type == FileType.Directory:
            fs.delete_dir(staging)

    def write(self, rows: Iterator[Row]) -> Attempt:
        fs, root = opened(self.target)
        folder, files, size, replaced = f"{self.run}/{uuid.uuid4().hex}", 0, 0, []
        made: set[str] = set()
        for row in rows:
            path, body = checked(row["archive_path"]), (row["body"] or "").encode()
            parent = f"{root}/{STAGING}/{folder}/{path.rpartition('/')[0]}"
            if parent not in made:
                fs.create_dir(parent, recursive=True)
                made.add(parent)
            with fs.open_output_stream(f"{root}/{STAGING}/{folder}/{path}") as out:
                out.write(body)
            if row["replaces"] and row["replaces"] != path:
                replaced.append(checked(row["replaces"]))
            files, size = files + 1, size + len(body)
        if files:
            with fs.open_output_stream(f"{root}/{STAGING}/{folder}/{REPLACED}") as out:
                out.write(json.dumps(replaced).encode())
        return Attempt(folder, files, size)

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        fs, root = opened(self.target)
        bases = [f"{root}/{STAGING}/{m.folder}" for m in messages if m is not None and m.files]
        gone: set[str] = set()  # of all files, only the names that were replaced are kept here
        made: set[str] = set()
        for base in bases:
            with fs.open_input_stream(f"{base}/{REPLACED}") as f:
                gone.update(json.loads(f.read()))
        for base in bases:
            for found in fs.get_file_info(FileSelector(base, recursive=True)):
                name = found.path[len(base) + 1 :]
                if found.type != FileType.File or name == REPLACED:
                    continue
                target = f"{root}/{name}"
                if (parent := target.rpartition("/")[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                fs.move(found.path, target)
                gone.discard(name)
        for name in gone:
            if fs.get_file_info(f"{root}/{name}").type == FileType.File:
                fs.delete_file(f"{root}/{name}")
        self.clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self.clear()


class SummaryFiles(DataSource):
    """Options: path (the archive), run (a name for this write, by default a new one)."""

    @classmethod
    def name(cls) -> str:
        return "summary_files"

    def schema(self) -> str:
        return "archive_path string, body string, replaces string"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("files are replaced one by one: use mode append")
        return Writer(self.options["path"], self.options.get("run") or uuid.uuid4().hex)


def write(rows: DataFrame, archive: str, run: str | None = None) -> None:
    """Writes (archive_path, body, replaces); all files are there when it returns, or none of them."""
    spark = rows.sparkSession
    spark.dataSource.register(SummaryFiles)
    if run:
        Writer(archive, run).clear()
    out = rows.select("archive_path", "body", F.col("replaces").cast("string").alias("replaces"))
    out.write.format("summary_files").mode("append").option("path", archive).options(**({"run": run} if run else {})).save()


def read(spark: SparkSession, archive: str) -> DataFrame:
    """(archive_path, body) of the summaries below an archive; what is still staged is not read.

    Tasks list the folders and read the files; the driver has the names of folders only.
    """
    from pyarrow.fs import FileSelector, FileType

    fs, root = opened(archive)
    if fs.get_file_info(f"{root}/sessions").type != FileType.Directory:
        return spark.createDataFrame([], "archive_path string, body string")

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(archive)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = fs.get_file_info(FileSelector(f"{root}/{folder}"))
                for k in range(0, len(found), READ_FILES):
                    part = found[k : k + READ_FILES]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{i.base_name}" for i in part], pa.string()), pa.array([i.type == FileType.Directory for i in part], pa.bool_())], ["path", "is_folder"])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(archive)
        for batch in batches:
            paths = batch.column(0).to_pylist()
            for k in range(0, len(paths), READ_FILES):
                part, texts = paths[k : k + READ_FILES], []
                for path in part:
                    with fs.open_input_stream(f"{root}/{path}") as f:
                        texts.append(f.read())
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(texts, pa.binary())], ["archive_path", "body"])

    def listed(folders: list[str]) -> DataFrame:
        return spark.createDataFrame([(f,) for f in folders], "folder string").repartition(min(len(folders), MOST_TASKS)).mapInArrow(entries, "path string, is_folder boolean")

    folders, level = [], ["sessions"]
    while level:
        folders += level
        level = [r["path"] for r in listed(level).filter("is_folder").collect()]
    files = listed(folders).filter("NOT is_folder AND path LIKE '%.md'").select("path")
    files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(bodies, "archive_path string, body binary")
    return files.select("archive_path", F.col("body").cast("string").alias("body"))
