"""op12 against brute force for every kind of unit, and its round trip."""

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sessionlake.llm import op12_middle as op

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", "char": r"(?s)."}
TEXTS = st.text(st.sampled_from("ab \n\t<PSM>é☃\x00\r"), max_size=40)


def brute(doc_id, text, plan):
    text = text or ""
    units = re.findall(UNITS[plan.unit], text)
    assert "".join(units) == text
    h = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < plan.spm_rate else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(0, 10**9), st.sampled_from(["line", "word", "char"]), st.sampled_from([100, 60]))
def test_transform(text, doc_id, unit, rate):
    plan = op.Plan(unit=unit, rate=rate)
    events = op.Events(unit)
    got = op.transform(text, doc_id, plan, events)
    assert got == brute(doc_id, text, plan)
    assert op.restore(got[4], got[1], events) == text


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.sampled_from(["line", "word", "char"]))
def test_ranks(text, unit):
    events = op.Events(unit)
    units = op.Units(unit, len(text), events.scan(text)[0])
    ends = [0]
    for u in re.findall(UNITS[unit], text):
        ends.append(ends[-1] + len(u))
    assert [units.end(k) for k in range(len(ends))] == ends and units.n == len(ends) - 1
    assert [units.rank(at) for at in range(len(text) + 1)] == [sum(e <= at for e in ends[1:]) for at in range(len(text) + 1)]


def test_only_its_own_outputs():
    with pytest.raises(ValueError):
        op.restore("<P>a<S>b", op.PSM, op.Events("line"))


def test_frames(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab\n ") for _ in range(rng.randint(0, 30))), "x") for i in range(60)]
    rows += [(None, "a\nb", "x"), (3, rows[3][1], "y"), (70, None, "x"), (71, "", "x"), (72, "q <P> r", "x"), (73, "é\n" * 200_000, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, output string")
    whole = op.fill_in_middle(frame).collect()
    key = lambda r: (r[0] is None, r[0] or 0, str(r[1:]))
    assert sorted((tuple(r) for r in whole), key=key) == sorted(((i, *brute(i, t, op.Plan())) for i, t, _ in rows), key=key)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in op.digests(frame).collect()), key=key)
    assert got == sorted(((i, *b[:4], sha(b[4]), sha(t or "")) for i, t, _ in rows for b in [brute(i, t, op.Plan())]), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert op.digests(frame.limit(0)).collect() == []
