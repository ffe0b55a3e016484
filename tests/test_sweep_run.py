"""The sweep broken off after each step, with sources that fail, and its sink with tasks that fail."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import semantic, sweep_run
from sessionlake.sources import markdown

T0 = dt.datetime(2024, 5, 1, 10, 0)


class Stopped(Exception):
    pass


def source(spark, rows):
    names = "id string, project string, source_jsonl string, transcript string, transcript_hash string, session_timestamp timestamp, units array<string>, n_messages long, n_owner long, tool string, fill_pct double, fill_estimated boolean"
    return lambda: spark.createDataFrame([(i, "proj", f"/logs/{i}", text, f"h{text}", T0, [f"[User]\n{text}"], n, own, tool, 12.5, False) for i, text, n, own, tool in rows], names)


def broken():
    raise ValueError("no such export")


def answers(log):
    """A model that counts its calls in files, refuses one session, and tells a secret in another."""

    def summarise(rows):
        def run(frames):
            import pandas as pd

            for f in frames:
                for i in f["id"]:
                    with open(os.path.join(log, "asked"), "a") as out:
                        out.write(i + "\n")
                keep = [(i, "" if i == "c1" else f"About {i}", f"{t}. " + ("password: hunter22" if i == "c2" else ""), "exploration") for i, t in zip(f["id"], f["transcript"], strict=True) if i != "refused"]
                if keep:
                    yield pd.DataFrame(keep, columns=["id", "title", "summary", "session_type"])

        got = rows.mapInPandas(run, "id string, title string, summary string, session_type string")
        empty = F.array().cast("array<string>")
        return got.withColumns({"error_tags": empty, "topic_tags": empty, "highlights": F.when(F.col("id") == "c2", F.array(F.lit(" one "), F.lit("two"))).otherwise(empty)})

    return summarise


def sources(spark, changed=False):
    return {
        "codex": source(spark, [("c1", "fix it now" if changed else "fix it", 9, 4, "Codex"), ("c2", "more", 9, 4, "Codex"), ("hi", "hello", 9, 4, "Codex"), ("refused", "no", 9, 4, "Codex")]),
        "viber": source(spark, [("v1", "talk", 9, 4, "Viber"), ("v2", "short", 2, 1, "Viber")]),
        "grok": broken,
        "whatsapp": broken,
    }


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if f.endswith(".md"))


def sweep(spark, tmp, run="r1", at="2024-06-01 07:08:09", **more):
    return sweep_run.run_sweep(spark, str(tmp / "archive"), more.pop("sources", None) or sources(spark), answers(str(tmp)), run, at, semantic.hash_embedder(8), "m", **more)


def test_a_sweep(spark, tmp_path):
    got = sweep(spark, tmp_path).collect()[0].asDict()
    assert got == {"processed": 3, "skipped": 2, "low_signal_skipped": 1, "business_filtered": 1, "flagged": 1, "errors": 3, "business_errors": 1}
    archive = str(tmp_path / "archive")
    index = {r["id"]: r for r in sweep_run.index_of(spark, archive).collect()}
    assert set(index) == {"c1", "c2", "v1"} and index["c1"]["title"] == "proj - 2024-05-01 10:00" and index["c2"]["secret_flags"] == ["password_assignment"]
    assert files(archive) == sorted(r["archive_path"] for r in index.values())
    bodies = {r["archive_path"]: r["body"] for r in markdown.read(spark, archive).collect()}
    assert bodies[index["c2"]["archive_path"]] == (
        "# About c2\n\n**Tool:** Codex  \n**Provider:** codex  \n**Date created:** 2024-05-01 10:00 +00:00  \n**Archived:** 2024-06-01 07:08 +00:00  \n"
        "**Fill at compact:** 12.5%  \n**Source:** /logs/c2  \n\n---\n\nmore. password: hunter22\n\n## Highlights\n\none\n\ntwo\n\n---\n*Archived by m*\n"
    )
    assert {r["session_id"] for r in sweep_run.vectors_of(spark, archive).collect()} == set(index)
    assert not os.path.exists(f"{archive}/_staging/r1")


def test_broken_off_after_every_step(spark, tmp_path):
    want = sweep(spark, tmp_path / "whole").collect() if not (tmp_path / "whole").mkdir() else None
    calls = (tmp_path / "whole" / "asked").read_text().split()
    steps = []
    while True:
        seen = len(steps)

        def stop(step):
            steps.append(step)
            raise Stopped(step)

        try:
            got = sweep(spark, tmp_path, after=stop).collect()
            break
        except Stopped:
            assert len(steps) == seen + 1
    assert steps == ["scan-codex", "scan-viber", "worklist", "answers", "written", "files", "index", "vectors"]
    assert got == want and sorted((tmp_path / "asked").read_text().split()) == sorted(calls)
    assert files(tmp_path / "archive") == files(tmp_path / "whole" / "archive")


def test_a_second_sweep_replaces_files(spark, tmp_path):
    sweep(spark, tmp_path)
    archive = str(tmp_path / "archive")
    before = files(archive)
    got = sweep(spark, tmp_path, "r2", "2024-06-02 01:02:03", sources=sources(spark, True)).collect()[0]
    assert (got["processed"], got["skipped"], got["errors"]) == (1, 4, 3)
    index = {r["id"]: r["archive_path"] for r in sweep_run.index_of(spark, archive).collect()}
    assert files(archive) == sorted(index.values()) and len(set(before) - set(files(archive))) == 1
    assert index["c1"] == "sessions/proj/2024-06-02/01-02-03-codex-c1-sweep.md"
    assert len(sweep_run.vectors_of(spark, archive).collect()) == 3


def test_no_file_of_a_failed_write(spark, tmp_path):
    archive = str(tmp_path)
    rows = spark.range(200).repartition(4).select(F.format_string("sessions/p/d/%d.md", "id").alias("archive_path"), F.when(F.col("id") == 150, F.raise_error(F.lit("lost"))).otherwise("x").alias("body"), F.lit(None).alias("replaces"))
    with pytest.raises(Exception, match="lost"):
        markdown.write(rows, archive, "r")
    # tasks that were still running when the write was given up may leave staged files; the next write of this run clears them
    assert not os.path.exists(tmp_path / "sessions") and markdown.read(spark, archive).count() == 0
    markdown.write(rows.filter("archive_path NOT LIKE '%150.md'"), archive, "r")
    assert len(files(archive)) == 199 and not os.path.exists(tmp_path / "_staging" / "r")


def test_paths_stay_below_the_archive(spark, tmp_path):
    for path in ("../x.md", "/x.md", "a//b", "", "_staging/x"):
        with pytest.raises(ValueError):
            markdown.checked(path)
    writer = markdown.Writer(str(tmp_path), "r")
    lost = writer.write(iter([{"archive_path": "sessions/a.md", "body": "lost", "replaces": None}]))
    kept = writer.write(iter([{"archive_path": "sessions/a.md", "body": "kept", "replaces": "sessions/old.md"}]))
    (tmp_path / "sessions").mkdir()
    (tmp_path / "sessions" / "old.md").write_text("old")
    writer.commit([kept, None])  # the lost attempt's message never arrives
    assert files(tmp_path) == ["sessions/a.md"] and (tmp_path / "sessions" / "a.md").read_text() == "kept" and lost.files == 1
    assert not (tmp_path / "_staging" / "r").exists()


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_a_transcript_is_stored_once(spark, tmp_path):
    """No step has more than one copy of what is to be processed, the second sweep none of what is the same, and nothing is left."""
    random.seed(1)
    text = [random.randbytes(20_000).hex() for _ in range(60)]
    archive, log = str(tmp_path / "archive"), {}
    kept = f"{archive}/_runs"

    def short(rows):
        empty = F.array().cast("array<string>")
        return rows.select("id", F.col("id").alias("title"), F.left("transcript", F.lit(9)).alias("summary"), F.lit("x").alias("session_type"), *[empty.alias(c) for c in ("error_tags", "topic_tags", "highlights")])

    def swept(run, changed):
        rows = source(spark, [(f"c{i}", f"{t} changed" if i < changed else t, 9, 4, "Codex") for i, t in enumerate(text)])
        log.clear()
        got = sweep_run.run_sweep(spark, archive, {"codex": lambda: rows().withColumn("transcript_hash", F.md5("transcript"))}, short, run, f"2024-06-0{run} 07:08:09", after=lambda step: log.update({step: size(kept)})).collect()[0]
        return got["processed"], max(log.values()), [f for f in os.listdir(f"{kept}/{run}") if os.path.isdir(f"{kept}/{run}/{f}")]

    whole = sum(map(len, text))
    n, most, left = swept("1", 0)
    assert (n, left) == (60, []) and most < 1.2 * whole and size(kept) < whole / 50
    n, most, left = swept("2", 6)
    assert (n, left) == (6, []) and most < whole / 5


def test_an_unreadable_index_is_no_sources_failure(spark, tmp_path):
    sweep(spark, tmp_path)
    folder = tmp_path / "archive" / "index" / "r1"
    for f in folder.glob("*.parquet"):
        f.write_bytes(b"no index")
    for f in folder.glob(".*.crc"):
        f.unlink()
    with pytest.raises(Exception, match="(?i)parquet"):
        sweep(spark, tmp_path, "r2")
    assert not list((tmp_path / "archive" / "_runs").glob("r2/*.failed"))


def test_summaries_are_read_by_tasks(spark, tmp_path):
    """All files, in folders of any depth and name; the driver lists no files and a task reads a part of them."""
    paths = [f"sessions/{project}/2024-06-0{n % 2 + 1}/{n}.md" for n in range(60) for project in ("p", "a/b", "_own", ".dot", "a b%20é")]
    markdown.write(spark.createDataFrame([(p, "" if p.endswith("/7.md") else f"body of {p}é", None) for p in paths], "archive_path string, body string, replaces string"), str(tmp_path))
    (tmp_path / "sessions" / "p" / "notes.txt").write_text("no summary")
    got = markdown.read(spark, str(tmp_path))
    assert {r["archive_path"]: r["body"] for r in got.collect()} == {p: "" if p.endswith("/7.md") else f"body of {p}é" for p in paths}
    assert got.inputFiles() == [] and got.rdd.getNumPartitions() > 1
