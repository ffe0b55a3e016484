"""Links, threads and reply order of op1 against brute force on random conversations."""

import random

import pytest

from sessionlake.llm import op01_quotes as q

SENTENCES = [f"sentence number {k} is long enough to be linked" for k in range(12)]


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(8):
        for turn in rng.sample(range(3000), rng.randint(1, 14)):
            parts = []
            for _ in range(rng.randint(0, 3)):
                parts.append("\n".join(("> " * rng.randint(0, 3)).strip() + (" " if rng.random() < 0.5 else "") + rng.choice(SENTENCES).upper() for _ in range(rng.randint(1, 2))))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n\n".join(parts) if rng.random() < 0.95 else None))
    return rows + [(None, 3, "user", SENTENCES[0]), (2, None, "user", f"> {SENTENCES[1]}")]


def brute(rows):
    placed = [(c, t, *q.parse(text or "")) for c, t, _, text in rows if None not in (c, t)]
    links = {}
    for c, t, _, passages in placed:
        for number, (level, p) in enumerate(passages):
            found = []
            for kind, h in q.digests(p):
                here = [b for a, b, own, _ in placed if a == c and b < t and h in {x for _, x in q.digests(own)}]
                least = min((b for a, b, own, _ in placed if a == c and h in {x for _, x in q.digests(own)}), default=None)
                if here and least < t:
                    found.append((0, kind, c, least))
                other = min(((a, b) for a, b, own, _ in placed if a != c and h in {x for _, x in q.digests(own)}), default=None)
                if other:
                    found.append((1, kind, *other))
            if found:
                far, kind, a, b = min(found)
                links.setdefault((c, t), []).append((number, level, a, b, kind))
    parent, turns = {}, sorted((c, t) for c, t, *_ in placed)
    for c, t in turns:
        replied = [b for n, level, a, b, k in links.get((c, t), []) if level == 1 and a == c]
        before = [x for a, x in turns if a == c and x < t]
        parent[c, t] = max(replied) if replied else max(before, default=None)
    place = {}
    for c, t in turns:
        root, depth = t, 0
        while parent[c, root] is not None:
            root, depth = parent[c, root], depth + 1
        place[c, t] = (parent[c, t], root, depth)
    order = sorted(turns, key=lambda x: (x[0], place[x][1], place[x][2], x[1]))
    position = {x: sum(1 for y in order[:k] if y[0] == x[0]) for k, x in enumerate(order)}
    return links, {x: (*place[x], position[x]) for x in turns}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, tmp_path, seed, monkeypatch):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    monkeypatch.setattr(q, "BLOCK", 4)
    rows = corpus(seed)
    links, places = brute(rows)
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, passage int, position int").repartition(3)
    got = q.conversations(docs).collect()
    assert len(got) == len(rows) and len(links) > 5
    for r in got:
        key = (r["conv_id"], r["turn"])
        if None in key:
            assert (r["links"], r["root_turn"], r["position"]) == (None, None, None)
            continue
        assert [tuple(x) for x in r["links"] or []] == links.get(key, [])
        assert (r["parent_turn"], r["root_turn"], r["depth"], r["position"]) == places[key]
    own = {(r["conv_id"], r["turn"]): r["text"] for r in got}
    want = {c: [(t, own[c, t]) for _, t in sorted((places[x][3], x[1]) for x in places if x[0] == c) if own[c, t]] for c in {x[0] for x in places}}
    parts = sorted(q.assembled(docs, part=5).collect(), key=lambda r: (r["conv_id"], r["part"]))
    written = {}
    for r in parts:
        assert r["n_messages"] == len(r["conversation"]) <= 5
        written.setdefault(r["conv_id"], []).extend((m["turn"], m["text"]) for m in r["conversation"])
    assert written == {c: m for c, m in want.items() if m}
