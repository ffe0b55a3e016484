"""Originals in other conversations, against brute force."""

from sessionlake.llm import op01_quotes

LINE = "this sentence is said and quoted by several people"


def linked(spark, rows):
    out = op01_quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    return {(r["conv_id"], r["turn"]): [(x["to_conv"], x["to_turn"]) for x in r["links"]] for r in out.collect() if r["links"]}


def brute(rows):
    own = [(c, t) for c, t, _, text in rows if None not in (c, t) and any(x == LINE for x in text.split("\n"))]
    quoting = [(c, t) for c, t, _, text in rows if None not in (c, t) and f"> {LINE}" in text]
    want = {}
    for c, t in quoting:
        found = min((p for p in own if p[0] == c and p[1] < t), default=None) or min((p for p in own if p[0] != c), default=None)
        if found:
            want[c, t] = [found]
    return want


def test_repeated_by_the_quoting_conversation(spark):
    for later in (3, 7):
        rows = [(1, 3, "user", f"> {LINE}\n\n{LINE if later == 3 else 'yes'}"), (1, 7, "user", LINE), (5, 2, "user", LINE), (5, 4, "user", LINE), (8, 0, "user", LINE), (9, 1, "user", f"> {LINE}\n\nno")]
        want = brute(rows)
        assert want[1, 3] == [(5, 2)] and linked(spark, rows) == want


def test_original_without_a_place(spark):
    rows = [(None, 0, "user", LINE), (2, None, "user", LINE), (5, 2, "user", LINE), (1, 3, "user", f"> {LINE}\n\nyes"), (None, 4, "user", f"> {LINE}\n\nyes")]
    assert brute(rows) == {(1, 3): [(5, 2)]} and linked(spark, rows) == brute(rows)
