"""Logs read by byte ranges: every line once, with its number, wherever the ranges are cut."""

import os
import random

import pytest

from sessionlake.sources import agents, log_lines


def by_file(rows):
    out = {}
    for r in rows:
        out.setdefault(os.path.basename(r["path"]), {})[r["line_no"]] = r["line"]
    return out


@pytest.mark.parametrize("split", [1, 7, 64, 10**6])
def test_every_line_once(spark, tmp_path, monkeypatch, split):
    monkeypatch.setattr(log_lines, "BLOCK", 5)
    rng = random.Random(split)
    texts = {f"f{k}.jsonl": "\n".join("é☃x"[rng.randint(0, 2)] * rng.choice([0, 0, 1, 3, 40]) for _ in range(rng.randint(0, 12))) + rng.choice(["", "\n"]) for k in range(12)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    for name, text in texts.items():
        size, whole = len(text.encode()), []
        for at in range(0, size, split):
            with open(tmp_path / name, "rb") as f:
                whole += log_lines.lines_of(f, at, min(size, at + split))
        want = text.encode().split(b"\n") if text else []
        assert whole == want or whole == want[:-1] and not want[-1], name
    if split > 1:
        got = by_file(log_lines.read(spark, str(tmp_path), split_bytes=split).collect())
        for name, text in texts.items():
            assert {k: v for k, v in got.get(name, {}).items() if v} == {k: v for k, v in enumerate(text.split("\n")) if v}


def test_a_large_log_is_many_tasks(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("\n".join(f'{{"n":{i}}}' for i in range(20_000)))
    spark.dataSource.register(log_lines.LogLines)
    rows = spark.read.format("log_lines").option("path", str(tmp_path)).option("split_bytes", "20000").load()
    assert rows.rdd.getNumPartitions() == -(-os.path.getsize(tmp_path / "big.jsonl") // 20_000)
    assert [r["line_no"] for r in agents.lines(spark, str(tmp_path), split_bytes=20_000).orderBy("line_no").collect()] == list(range(20_000))


def test_depth_suffix_and_time(spark, tmp_path):
    deep = tmp_path
    for k in range(14):
        (deep / f"at{k}.jsonl").write_text("x")
        deep = deep / "d"
        deep.mkdir()
    (tmp_path / "no.json").write_text("x")
    for k in range(14):
        os.utime(tmp_path.joinpath(*["d"] * k) / f"at{k}.jsonl", (1000 + k, 1000 + k))
    os.utime(tmp_path / "at0.jsonl", (-50, -50))
    found = log_lines.log_files(str(tmp_path), ".jsonl", 12, None)
    assert [os.path.basename(p) for p, _, _ in found] == [f"at{k}.jsonl" for k in range(12, -1, -1)]
    rows = agents.lines(spark, str(tmp_path), modified_after=1009).collect()
    assert {os.path.basename(r["path"]): r["mtime"] for r in rows} == {f"at{k}.jsonl": 1000 + k for k in (10, 11, 12)}
    assert {r["mtime"] for r in agents.lines(spark, str(tmp_path)).collect()} >= {-50}
    assert agents.lines(spark, str(tmp_path / "nowhere")).collect() == []
