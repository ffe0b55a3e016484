"""Incremental work: capture of new source files, the high-water mark, and capped gap windows over a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def capture(spark: SparkSession, source: str, target: str, checkpoint: str, glob: str = "*.jsonl*") -> None:
    """Copies each new file of a folder once to `target` (Parquet: id, source_path, size, mtime_secs, content).

    The stream's checkpoint is the manifest: a file is taken when it first appears, in one run over all that is there.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(source)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z0-9.]+)?$", 1)
    rows = files.select(stem.alias("id"), F.col("path").alias("source_path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime_secs"), "content")
    rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def captured(spark: SparkSession, target: str) -> DataFrame:
    """The manifest (id, source_path, size, mtime_secs) of what is captured: the latest copy of each source; none yet is empty.

    Files of the manifest that cannot be read count as not captured: what they held is copied again.
    """
    schema = "id string, source_path string, size long, mtime_secs long"
    try:
        rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(target)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    newest = rows.groupBy("source_path").agg(F.max(F.struct("mtime_secs", "size", "id")).alias("m"))
    return newest.select("m.id", "source_path", "m.size", "m.mtime_secs")


def versions(copies: DataFrame) -> DataFrame:
    """copies (source_path, size, mtime_secs, ...) with valid_from and valid_to: when each was the source's content.

    A version holds from its time on until the next one's, the newest without an end. Copies with a time that another has
    too are told apart by size, and the larger holds; equal copies are one version.
    """
    once = copies.dropDuplicates(["source_path", "mtime_secs", "size"])
    last = once.groupBy("source_path", "mtime_secs").agg(F.max("size").alias("size"))
    known = once.join(last, ["source_path", "mtime_secs", "size"], "left_semi")
    end = F.lead("mtime_secs").over(Window.partitionBy("source_path").orderBy("mtime_secs"))
    return known.withColumns({"valid_from": F.col("mtime_secs"), "valid_to": end})


def as_of(history: DataFrame, seconds: int) -> DataFrame:
    """The version of each source that held at a time; sources that came later are not there."""
    return history.filter((F.col("valid_from") <= seconds) & (F.col("valid_to").isNull() | (F.col("valid_to") > seconds)))


def capture_changed(spark: SparkSession, source: str, target: str, leave_out: DataFrame | None = None, glob: str = "*.jsonl*") -> int:
    """Copies the files whose size or time differs from their captured copy; leave_out: ids that are indexed with a file or deleted.

    A changed file is a new row, and readers take the latest of each source. Gives the number of files that were taken.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(source)
    stem = F.regexp_extract("path", r"([^/]+?)(\.[A-Za-z0-9.]+)?$", 1)
    found = files.select(stem.alias("id"), F.col("path").alias("source_path"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime_secs"), "content")
    if leave_out is not None:
        found = found.join(leave_out.select("id"), "id", "left_anti")
    same = captured(spark, target).select("source_path", "size", "mtime_secs")
    new = found.join(same, ["source_path", "size", "mtime_secs"], "left_anti").select("id", "source_path", "size", "mtime_secs", "content")
    taken = Observation()
    new.observe(taken, F.count(F.lit(1)).alias("files")).write.mode("append").parquet(target)  # counted as they are written
    return taken.get["files"]


def advance(spark: SparkSession, control: str, rows: DataFrame, process: Callable[[DataFrame], bool], column: str = "session_timestamp") -> str:
    """Processes the rows later than the stored mark and moves the mark only if every batch succeeded.

    Rows that come late, below the mark, are left out until a full rebuild.
    """
    try:
        mark = spark.read.schema("mark string").json(control).agg(F.max("mark")).first()[0] or ""
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        mark = ""
    pending = rows.filter(F.col(column) > mark)
    newest = pending.agg(F.max(column)).first()[0]
    if newest is None or not process(pending):
        return mark
    spark.createDataFrame([(newest,)], "mark string").coalesce(1).write.mode("append").json(control)  # the old mark stays until the new one is there
    return newest


def stream_windows(rows: DataFrame, key: str, gap_seconds: int, cap: int) -> DataFrame:
    """(key, event_id, window_no) of a stream of (key, event_id, ts) in order of arrival: exact gap and cap by state.

    State for a key is its last time, its window and the rows in it; rows of a micro-batch are taken in order of time.
    """

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, window, used = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        numbers = []
        for ts in rows["ts"].astype("datetime64[us]").astype("int64"):
            if last is not None and (ts - last > gap_seconds * 10**6 or used >= cap):
                window, used = window + 1, 0
            last, used = int(ts), used + 1
            numbers.append(window)
        state.update((last, window, used))
        yield pd.DataFrame({key: keys[0], "event_id": rows["event_id"].to_numpy(), "window_no": numbers})

    flat = rows.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts"))
    return flat.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, window_no long", "last long, window long, used long", "append", GroupStateTimeout.NoTimeout)


class ClosedWindows(StatefulProcessor):
    """Gap windows of one key: rows wait until the watermark has passed them, then they are placed in order of time.

    State is the open window and the waiting rows; a timer wakes the key for its next waiting row, and, when none waits, a
    gap after its last row, when nothing can join the window any more and the key's state goes.
    """

    def __init__(self, key: str, gap_seconds: int, cap: int):
        self.key, self.gap, self.cap = key, gap_seconds * 10**6, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "last long, first_ts long, first_id long, used long")
        self.waiting = handle.getListState("waiting", "ts long, event_id long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(i)) for frame in rows for t, i in zip(frame["ts"].astype("datetime64[us]").astype("int64"), frame["event_id"], strict=True)]
        self.waiting.appendList(new)
        self.handle.registerTimer(-(-min(new)[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(r[0]), int(r[1])) for r in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        state = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for ts, event in due:
            if state is None or ts - state[0] > self.gap or state[3] >= self.cap:
                state = (ts, ts, event, 0)
            out.append((key[0], event, state[1], state[2], state[3]))
            state = (ts, state[1], state[2], state[3] + 1)
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        elif due:
            self.waiting.clear()
        if state is not None and not later and now > state[0] + self.gap:
            self.open.clear()
        elif state is not None:
            self.open.update(state)
            if not later:
                self.handle.registerTimer((state[0] + self.gap) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=[self.key, "event_id", "first_ts", "first_id", "place"])

    def close(self) -> None:
        pass


def closed_windows(rows: DataFrame, key: str, gap_seconds: int, cap: int, lateness: str = "10 minutes") -> DataFrame:
    """(key, event_id, window_start, first_id, place) of a stream of (key, event_id, ts), for rows that the watermark has passed.

    A window is known by its first row; windows are those of sessions.gap_windows over all rows that were in time, however
    they came. A row that is older than the watermark is dropped, as all rows around it are placed already. State holds
    the rows of the last `lateness`, and of each key a window as long as one may go on. Needs the RocksDB state store.
    """
    flat = rows.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    placed = flat.groupBy(key).transformWithStateInPandas(ClosedWindows(key, gap_seconds, cap), f"{key} long, event_id long, first_ts long, first_id long, place long", "Append", "EventTime")
    return placed.select(key, "event_id", F.timestamp_micros("first_ts").alias("window_start"), "first_id", "place")
