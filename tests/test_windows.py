"""Windows, prefixes, requests and phone sessions against plain Python, at block sizes that cut keys anywhere."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionlake.operators import distill, messages, sessions, sweep
from sessionlake.sources import agents

T0 = dt.datetime(2024, 1, 1)


def plain_windows(rows, gap, cap):
    out, last = {}, {}
    for key, i, ts in sorted(rows, key=lambda r: (str(r[0]), r[2] is not None, r[2] or T0, r[1])):
        island, n, before = last.get(key, (0, -1, None))
        if before is not None and ts is not None and ts - before > gap:
            island, n = island + 1, -1
        n += 1
        last[key] = (island, n, ts if ts is not None else before)
        out[i] = (island, n // cap, n % cap)
    return out


@pytest.mark.parametrize("block_rows,blocks,cap", [(1, 2, 3), (5, 16, 4), (40, 64, 1000), (10**9, 64, 4)])
def test_gap_windows_in_blocks(spark, block_rows, blocks, cap):
    rng = random.Random(block_rows)
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), i, T0 + dt.timedelta(minutes=rng.choice([0, 1, 7, 40]) + rng.randint(0, 900))) for i in range(600)]
    rows += [(1, 600 + k, None) for k in range(5)] + [(1, 700 + k, T0 + dt.timedelta(minutes=300)) for k in range(30)]
    frame = spark.createDataFrame(rows, "c int, i int, ts timestamp").repartition(5)
    out = sessions.gap_windows(frame, "c", "ts", "i", "9 minutes", cap, block_rows, blocks).collect()
    assert {r["i"]: (r["island"], r["chunk"], r["place"]) for r in out} == plain_windows(rows, dt.timedelta(minutes=9), cap)
    assert len(out) == len(rows)


def test_gap_windows_empty(spark):
    assert sessions.gap_windows(spark.createDataFrame([], "c int, i int, ts timestamp"), "c", "ts", "i").collect() == []


def test_a_hot_key_is_many_blocks(spark):
    """Half of all rows have one key: no block has more than a few hundredths of them."""
    rows = spark.range(40_000).select((F.col("id") % 2 * (F.col("id") % 500)).alias("c"), F.timestamp_seconds(F.col("id") * 97 % 40_000).alias("ts"))
    sizes = [r["count"] for r in sessions.time_blocks(rows, "c", "ts", 1000, 64).groupBy("c", "_block").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 1000 and len(sizes) > 260


@pytest.mark.parametrize("seed", range(4))
def test_prefixes_by_neighbours(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    ids = ["rollout-" + word(rng.randint(0, 12)) for _ in range(60)] + [word(rng.randint(5, 12)) for _ in range(20)]
    asked = [i[: rng.randint(1, len(i))] for i in ids] + [i + "a" for i in ids] + [word(9) for _ in range(30)]
    want = {}
    for c in asked:
        found = {i for i in ids if i.startswith(c)} if len(c) >= 8 else set()
        if c in ids:
            want[c] = c
        elif len(found) == 1:
            want[c] = found.pop()
    got = distill.resolved_prefixes(spark.createDataFrame([(c,) for c in asked], "candidate string"), spark.createDataFrame([(i,) for i in ids], "id string"))
    assert {r["candidate"]: r["id"] for r in got.collect()} == want and len(want) > 20


def test_prefixes_make_no_pairs(spark):
    """4 000 ids that share their first eight characters: no operator of the plan makes more rows than come in, by a small factor."""
    ids = spark.range(4000).select(F.format_string("rollout-%08d", "id").alias("id"))
    found = distill.resolved_prefixes(ids.select(F.left("id", F.lit(13)).alias("candidate")), ids)
    assert found.count() == 0
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().toString()


def test_a_request_is_a_whole_unit(spark):
    cases = [
        (["[User]\nhello\n\nplease fix the parser in main.py"], False),
        (["[User]\nhello", "[Assistant]\nhi there"], True),
        (["[User]\nHello!", "[Assistant]\nsearch previous session", "[User]\nfix it"], False),
        (["[User]\nare you monitoring\n\nthe board"], True),
        (["[Assistant]\nhello"], False),
        (None, False),
    ]
    rows = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(cases)], "k int, units array<string>")
    got = {r["k"]: r["x"] for r in rows.select("k", sweep.low_signal_agent(F.col("units")).alias("x")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def test_low_signal_on_codex_logs(spark):
    """From the log's lines to the rule: units are judged as they are read, not after they were joined."""
    said = lambda kind, text: '{"type":"event_msg","payload":{"type":"%s","message":"%s"}}' % (kind, text)
    lines = [("a", 0, said("user_message", "hello")), ("a", 1, said("assistant_message", "hi there")), ("b", 0, said("user_message", r"hello\n\nplease fix main.py")), ("b", 1, said("assistant_message", "done"))]
    units = agents.session_units(agents.codex_units(spark.createDataFrame(lines, "path string, line_no int, line string")))
    assert {r["path"]: r["x"] for r in units.select("path", sweep.low_signal_agent(F.col("units")).alias("x")).collect()} == {"a": True, "b": False}


def phone(spark, rows):
    frame = spark.createDataFrame(rows, "chat_id int, guid string, ts timestamp, text string, from_me boolean, attachments array<struct<transfer_name:string,mime_type:string,total_bytes:bigint>>")
    talks = spark.createDataFrame([(1, "A", None)], "chat_id int, title string, org string")
    windows = messages.windowed(frame, talks).withColumn("speaker", F.lit("x"))
    return {r["id"]: (r["n_messages"], r["transcript"]) for r in messages.phone_sessions(windows, "apple_messages").collect()}


def test_older_messages_leave_other_ids(spark):
    day = lambda n: T0 + dt.timedelta(days=n)
    rows = [(1, f"g/{n}", day(n), f"t{n}", n % 2 == 0, []) for n in (100, 101, 200, 201)]
    before, after = phone(spark, rows), phone(spark, [(1, "g/0", day(0), "older", False, []), *rows])
    assert set(before) == {"apple_messages-g_100", "apple_messages-g_200"}
    assert after == before | {"apple_messages-g_0": (1, "[User]\nolder")}


def test_attachments_become_text(spark):
    rows = [(1, "a", T0, None, True, [("p.heic", "image/heic", 2_100_000)]), (1, "b", T0 + dt.timedelta(1), "look", False, [(None, None, None)]), (1, "c", T0 + dt.timedelta(2), " ", False, [])]
    assert phone(spark, rows) == {
        "apple_messages-a": (2, "[Assistant]\n[attachment: p.heic · image/heic · 2.1 MB]\n\n[User]\nlook\n[attachment: unnamed · unknown · unknown]")
    }
