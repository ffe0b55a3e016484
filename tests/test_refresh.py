"""A refresh that breaks off asks the model only for what it has no answer for."""

import json
import os

import pytest

from sessionlake.operators import distill, refresh


def sessions(spark, n=40, first=0):
    rows = [(f"a{i:07x}b", f"title {i}", "2024-01-01", f"2024-02-01T00:00:{i:02d}", f"body {i}") for i in range(first, first + n)]
    return spark.createDataFrame(rows, "id string, title string, date string, session_timestamp string, body string").repartition(3)


def models(log, fail=()):
    def count(name):
        with open(os.path.join(log, name), "a") as out:
            out.write("x\n")

    def model(block):
        count("map")
        if any(f"title {i}\n" in block for i in fail):
            raise ValueError("no answer")
        return json.dumps({"facts": [{"section": "preferences", "fact": f"fact of {block.splitlines()[0][-8:]}", "evidence": ["s1", "[S2]"], "date": "2024-01-01"}, {"section": "project", "fact": "works", "evidence": ["S9999"], "date": ""}]})

    def merge(section, old, facts):
        count("merge")
        return (old + "\n" if old else "") + facts + " [deadbeefaa]"

    return model, merge


def calls(log, name):
    path = os.path.join(log, name)
    return len(open(path).readlines()) if os.path.exists(path) else 0


class Stopped(Exception):
    pass


def test_the_chain(spark, tmp_path):
    log, store = str(tmp_path), str(tmp_path / "store")
    model, merge = models(log)
    done = refresh.run_refresh(sessions(spark), store, model, merge, batch=4, wave=3)
    assert (done.sessions, done.facts, done.asked, done.failed_batches, done.watermark) == (40, 10, 10, 0, "2024-02-01T00:00:39")
    assert (calls(log, "map"), calls(log, "merge")) == (10, 1) and not os.path.exists(f"{store}/_runs/pending")
    profile = open(f"{store}/profile.md").read()
    assert "## Conventions & Preferences\n\n- fact of" in profile and profile.count(distill.EMPTY_SECTION) == 6 and "deadbeef" not in profile
    assert "[a0000027b, a0000026b]" in profile and any("deadbeefaa" in w for w in done.warnings)
    # nothing new: nothing is asked or written
    again = refresh.run_refresh(sessions(spark), store, model, merge, batch=4)
    assert again.asked == 0 and calls(log, "map") == 10 and open(f"{store}/profile.md").read() == profile
    # two new sessions: one batch, merged into the old section
    more = refresh.run_refresh(sessions(spark, 42), store, model, merge, batch=4)
    assert (more.asked, more.sessions, calls(log, "map"), more.watermark) == (1, 2, 11, "2024-02-01T00:00:41")
    assert open(f"{store}/profile.md").read().count("- fact of") == 11


@pytest.mark.parametrize("stop", ["answers-000000", "answers-000002", "reduced"])
def test_broken_off_and_started_again(spark, tmp_path, stop):
    log, store = str(tmp_path), str(tmp_path / "store")
    model, merge = models(log)

    def after(step):
        if step == stop:
            raise Stopped(step)

    with pytest.raises(Stopped):
        refresh.run_refresh(sessions(spark), store, model, merge, batch=4, wave=3, after=after)
    asked = calls(log, "map")
    assert asked == {"answers-000000": 3, "answers-000002": 9, "reduced": 10}[stop] and not os.path.exists(f"{store}/profile.md")
    done = refresh.run_refresh(sessions(spark), store, model, merge, batch=4, wave=3)
    assert calls(log, "map") == 10 and (done.sessions, done.facts, done.asked) == (40, 10, 10 - asked)
    assert open(f"{store}/profile.md").read().count("- fact of") == 10


def test_an_unanswered_batch_holds_the_watermark(spark, tmp_path):
    log, store = str(tmp_path), str(tmp_path / "store")
    model, merge = models(log, fail=[5])
    first = refresh.run_refresh(sessions(spark), store, model, merge, batch=4, wave=3)
    assert (first.failed_batches, first.watermark, first.sessions) == (1, "", 36) and os.path.exists(f"{store}/_runs/pending")
    model, merge = models(log)
    second = refresh.run_refresh(sessions(spark), store, model, merge, batch=4, wave=3)
    assert (second.asked, second.failed_batches, second.sessions, second.watermark) == (1, 0, 40, "2024-02-01T00:00:39")


def test_evidence_in_many_forms(spark):
    """A label, an id, the only start of one; not a start of several, a short one, or another batch's id."""
    labels = spark.createDataFrame([(1, "S1", "aaaa-bbbb-1"), (1, "S2", "aaaa-bbbb-2"), (1, "S3", "cccc-dddd-3"), (2, "S1", "eeee-ffff-4")], "batch long, label string, id string")
    given = ["[s1]", "Session 2", "3", "cccc-dddd-3", "cccc-ddd", "aaaa-bbbb", "cccc", "eeee-ffff-4", "S9"]
    facts = [{"section": "identity", "fact": g, "evidence": [g], "date": ""} for g in given] + [{"section": "identity", "fact": "none", "evidence": None}]
    answers = spark.createDataFrame([(1, json.dumps({"facts": facts})), (2, json.dumps({"facts": [{"section": None, "fact": "x"}, {"section": "identity"}, {"section": "zoo", "fact": "y"}]}))], "batch long, answer string")
    got = {r["fact"]: r["evidence"] for r in distill.validated_facts(distill.parsed_facts(answers), labels).collect()}
    assert got == {"[s1]": ["aaaa-bbbb-1"], "Session 2": ["aaaa-bbbb-2"], "3": ["cccc-dddd-3"], "cccc-dddd-3": ["cccc-dddd-3"], "cccc-ddd": ["cccc-dddd-3"]}
    warned = [(r["batch"], r["warning"]) for r in distill.fact_warnings(answers, labels).collect()]
    assert sorted(w for b, w in warned if b == 2) == ["skipped fact with unknown section zoo", "skipped fact without a section", "skipped fact without a text in section identity"]
    assert sum("unknown evidence" in w for _, w in warned) == 4 and sum("without evidence" in w for _, w in warned) == 5


def test_scope_of_a_chat(spark):
    from sessionlake.operators import semantic

    model = semantic.hash_embedder(16)
    rows = [(f"s{k}", model([semantic.query_input(t)])[0]) for k, t in enumerate(["red apples", "blue sky", "green hills"])]
    store = spark.createDataFrame(rows, "session_id string, embedding array<double>")
    assert semantic.scope_ids(store, " red apples ", model)[0] == "s0"
    assert len(semantic.query_input("é" * 2000).encode()) in (1799, 1800)
    with pytest.raises(ValueError, match="no session"):
        semantic.scope_ids(store.limit(0), "x", model)
