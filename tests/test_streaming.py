"""Capture by fingerprint, the high-water mark and gap windows over a stream."""

import os

import pytest

from sessionlake.streaming import capture


def test_capture_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text("1")
    for text in ("1", "2"):
        (source / "b.jsonl").write_text(text)
        capture.capture(spark, str(source), str(tmp_path / "out"), str(tmp_path / "control"))
    assert sorted((r["id"], bytes(r["content"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", b"1"), ("b", b"1")]


def test_capture_changed(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in "abc":
        (source / f"{name}.jsonl").write_text("one")
    out = spark.createDataFrame([("c",)], "id string")
    assert capture.captured(spark, target).count() == 0
    assert capture.capture_changed(spark, str(source), target, out) == 2
    assert capture.capture_changed(spark, str(source), target, out) == 0
    (source / "a.jsonl").write_text("longer")
    os.utime(source / "b.jsonl", (2_000_000_000, 2_000_000_000))
    assert capture.capture_changed(spark, str(source), target, out) == 2
    assert {(r["id"], r["size"]) for r in capture.captured(spark, target).collect()} == {("a", 6), ("b", 3)}


def test_advance(spark, tmp_path):
    control = str(tmp_path / "mark")
    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "session_timestamp string, id string")
    seen = []

    def take(frame):
        seen.append(sorted(r["id"] for r in frame.collect()))
        return "c" not in seen[-1]

    assert capture.advance(spark, control, rows.filter("id < 'c'"), take) == "2"
    assert capture.advance(spark, control, rows, take) == "2"  # the batch failed: the mark stays
    assert capture.advance(spark, control, rows.filter("id < 'c'"), take) == "2"
    assert seen == [["a", "b"], ["c"]]


@pytest.mark.parametrize("gap,cap,want", [(10, 9, [0, 0, 1, 1, 2]), (1000, 2, [0, 0, 1, 1, 2])])
def test_stream_windows(spark, tmp_path, gap, cap, want):
    times = [0, 5, 20, 25, 60]
    for k in range(0, 5, 2):  # files arrive one after the other
        part = [(7, j, f"2024-01-01 00:00:{t:02d}" if t < 60 else "2024-01-01 00:01:00") for j, t in enumerate(times)][k : k + 2]
        spark.createDataFrame(part, "key long, event_id long, ts string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, event_id long, ts string").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    out = capture.stream_windows(stream, "key", gap, cap).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("event_id").collect()
    assert [r["window_no"] for r in rows] == want


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_closed(spark, folder, gap, cap, lateness):
    """Runs over the files that are there, one a batch; gives the rows of state at the end of each batch."""
    stream = spark.readStream.schema("key long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    query = capture.closed_windows(stream, "key", gap, cap, lateness).writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(op["numRowsTotal"] for op in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]


def test_closed_windows(spark, tmp_path):
    """Rows in any order within the lateness, over several runs: the windows of the whole; later rows are dropped; state goes."""
    import datetime as dt
    import json
    import random

    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        rng = random.Random(4)
        base, rows, t = dt.datetime(2024, 1, 1), [], 0
        for i in range(120):
            t += rng.choice([1, 5, 20, 20, 200])
            rows.append((rng.choice([1] * 12 + list(range(2, 14))), i, t))
        order = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 50))  # at most 50 seconds out of order
        (tmp_path / "in").mkdir()
        write = lambda k, part: (tmp_path / "in" / f"{k:03d}.json").write_text("\n".join(json.dumps({"key": key, "event_id": i, "ts": (base + dt.timedelta(seconds=s)).strftime("%Y-%m-%d %H:%M:%S")}) for key, i, s in part))
        sizes = []
        for k in range(0, 120, 40):
            write(k, order[k : k + 40])
            sizes += run_closed(spark, tmp_path, 60, 4, "60 seconds")
        write(500, [(1, 900, 1)])  # far too late
        write(501, [(9, 901, t + 100_000)])  # moves the watermark beyond everything
        sizes += run_closed(spark, tmp_path, 60, 4, "60 seconds")
        write(502, [(9, 902, t + 200_000)])
        sizes += run_closed(spark, tmp_path, 60, 4, "60 seconds")
        got = {r["event_id"]: (r["key"], r["first_id"], r["place"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
        want, state = {}, {}
        for key, i, s in sorted(rows, key=lambda r: (r[2], r[1])):
            last, first, used = state.get(key, (None, None, 0))
            if last is None or s - last > 60 or used >= 4:
                first, used = i, 0
            want[i] = (key, first, used)
            state[key] = (s, first, used + 1)
        assert {i: v for i, v in got.items() if i < 900} == want and 900 not in got and got[901] == (9, 901, 0)
        assert sizes[-1] < max(sizes) / 2, sizes  # of the thirteen keys none has state any more, but for the last one
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_versions_of_captured_files(spark, tmp_path):
    """Each captured change is a version; the history tells what held when; an unreadable manifest file is copied again."""
    source, target = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for at, text in ((1000, "a"), (2000, "bb"), (3000, "c")):
        (source / "x.jsonl").write_text(text)
        os.utime(source / "x.jsonl", (at, at))
        assert capture.capture_changed(spark, str(source), target) == 1
    history = capture.versions(spark.read.parquet(target))
    assert sorted((r["valid_from"], r["valid_to"], bytes(r["content"])) for r in history.collect()) == [(1000, 2000, b"a"), (2000, 3000, b"bb"), (3000, None, b"c")]
    held = lambda t: [bytes(r["content"]) for r in capture.as_of(history, t).collect()]
    assert (held(999), held(1000), held(2999), held(9999)) == ([], [b"a"], [b"bb"], [b"c"])
    for name in os.listdir(target):
        if name.endswith(".parquet"):
            (tmp_path / "out" / name).write_bytes(b"not parquet at all, and long enough to be read as such")
            (tmp_path / "out" / f".{name}.crc").unlink(missing_ok=True)
    assert capture.captured(spark, target).count() == 0
