"""Corpus operators against brute force on a small corpus with copies, near copies, odd rows and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sessionlake.llm import op01_quotes, op02_bpe, op04_anchors, op05_quality, op06_language, op07_suffix, op08_decontaminate, op09_rules, op10_jaccard
from sessionlake.llm.components import components
from sessionlake.llm.queries import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, component long, slice long, bucket int, status binary, at binary, key double, count int"


def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("aehinorstü") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    hot = prose(80)
    texts = [None, "", " \n\t ", "one two", "One TWO", "a b c d e", "\x0b\x0c", "é" * 200, "x" * 5000]
    texts += [f"{prose(rng.randint(5, 60))}\n{hot} {prose(rng.randint(5, 60))}" for _ in range(12)]
    base = prose(300).split()
    for _ in range(25):  # near copies with a few edits each
        w = base[:]
        for _ in range(rng.randint(0, 18)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(" ".join(w))
    texts += [texts[-1], texts[-1], hot, hot.upper(), prose(40_000)]
    texts += [prose(rng.randint(30, 400)) + "." for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], rows[5]]  # repeated rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 2, 3, 4, None, None, 0.5, 1) for i, t in rows], SCHEMA).repartition(5).checkpoint()


@pytest.fixture(scope="module", autouse=True)
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def test_anchors(docs, rows):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    want = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        want[i] = (len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    got = op04_anchors.kept_words(docs).collect()
    assert len(got) == len(rows) and any(r["n_removed"] for r in got)
    assert all((r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]] for r in got)


def brute_bytes(pairs, length=100):
    seen, out = set(), {}
    for i, t in sorted(pairs, key=lambda p: p[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), kept)
    return out


def test_suffix(docs, rows):
    want = brute_bytes(set(rows))
    got = op07_suffix.spans(docs).collect()
    assert len(got) == len(rows)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (*want[r["doc_id"]][:3], sha(want[r["doc_id"]][3])) for r in got)
    cut = {r["doc_id"]: r["text"] for r in op07_suffix.dedup(docs).collect()}
    assert all(cut[i] == (None if t is None else want[i][3].decode(errors="ignore")) for i, t in rows)
    assert op07_suffix.dedup(docs).columns == docs.columns


def brute_classes(pairs):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: shingles(t) for i, t in pairs}
    least = {i: i for i in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                least[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard(docs, rows):
    want = brute_classes(rows)
    got = op10_jaccard.classes(docs).collect()
    assert len(got) == len(rows) and len({c for _, c in want.values()}) < len(want)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in got)
    kept = [r["doc_id"] for r in op10_jaccard.representatives(docs).collect()]
    assert sorted(kept) == sorted({c for _, c in want.values()})


def test_bpe_matches_library(spark, docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path())
    t.no_truncation()
    t.no_padding()
    got = {r["doc_id"]: r for r in op02_bpe.encode(docs, vocabulary_path(), with_ids=True).collect()}
    odd = ["<|startoftext|>a<|endoftext|>", "it's İ ΑΣ ςσ ﬁ\x1c\x85​　 日本語 1234 ...!!", "'s't", "🏽👍 " * 9, "q" * 3000]
    more = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got_odd = {r["doc_id"]: r for r in op02_bpe.encode(more, vocabulary_path(), with_ids=True).collect()}
    for found, pairs in ((got, rows), (got_odd, enumerate(odd))):
        for i, text in pairs:
            ids = t.encode(text or "", add_special_tokens=False).ids
            decoded = t.decode(ids, skip_special_tokens=False)
            r = found[i]
            assert (list(r["ids"]), r["decoded"], r["n_tokens"]) == (ids, decoded, len(ids))
            assert r["ids_sha256"] == sha(" ".join(map(str, ids)).encode()) and r["decoded_sha256"] == sha(decoded.encode())


def test_rules(spark):
    good = " ".join(f"wörd{k}" for k in range(60)) + "."
    cases = {
        0: (None, False), 1: ("", False), 2: (good, True), 3: ("spam " * 100, False), 4: (f"{good}\nAll rights reserved.", True),
        5: ("\n".join(["home | about | shop | cart"] * 30) + "\n" + good[:200], False), 6: ("word### " * 80, False), 7: ("\n\n" + good + "\n\n" + good, False),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in cases.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in op09_rules.assess(docs).collect()}
    assert {i: r["kept"] for i, r in got.items()} == {i: k for i, (_, k) in cases.items()}
    assert got[4]["clean_text"] == good and got[7]["n_dup_lines"] == 1 and got[3]["n_repeat_words"] == 100
    assert (got[0]["n_words"], got[0]["word_chars"], got[6]["n_symbols"]) == (0, 0, 240)
    cleaned = op09_rules.clean(docs)
    assert cleaned.columns == docs.columns and {r["doc_id"] for r in cleaned.collect()} == {2, 4}


def test_decontamination(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(5000)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 50)))) for k in range(30)] + [(90, None), (91, ""), (92, "uniqueword")]
    docs, want = [(0, None), (1, "")], set()
    for k in range(2, 92):
        text = [rng.choice(vocab) for _ in range(300)]
        if k % 3:
            item = items[k % 30]
            w = item[1].split()
            for _ in range(rng.randint(0, len(w) // 6)):
                w[rng.randrange(len(w))] = "changed"
            at = rng.randrange(250)
            text[at : at + len(w)] = [x.upper() + "," for x in w]
            want.add((k, item[0]))
        docs.append((k, " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("distance", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op08_decontaminate.find(frame, bench).collect()}
    assert got == want  # substitutions keep windows aligned, and the tables miss one in thousands
    blocks = {(r["doc_id"], r["item_id"]) for r in op08_decontaminate.find(frame, bench, block=7).collect()}
    assert blocks == want
    left = op08_decontaminate.decontaminate(frame, bench)
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {d for d, _ in want} and left.columns == frame.columns


def test_quality(spark):
    good = [(i, "alpha beta gamma delta " * (1 + i % 5)) for i in range(100)]
    bad = [(i, "omega psi chi phi " * (1 + i % 5)) for i in range(100, 200)]
    docs = spark.createDataFrame([*good, *bad, (200, None), (201, " "), (3, good[3][1])], "doc_id long, text string")
    target = docs.filter("doc_id < 60").select("doc_id")
    got = op05_quality.resample(docs, target, fraction=0.5).collect()
    chosen = [r for r in got if r["selected"]]
    keyed = sorted((r for r in got if r["key"] is not None), key=lambda r: (-r["key"], r["doc_id"]))
    assert len(got) == 203 and {r["doc_id"] for r in keyed[: round(201 * 0.5)]} == {r["doc_id"] for r in chosen}
    assert sum(r["doc_id"] < 100 for r in chosen) > 0.9 * len(chosen)
    assert not any(r["selected"] for r in got if r["doc_id"] >= 200)


def test_language(spark):
    rng = random.Random(1)
    words = {"en": "the and with that from this house water".split(), "de": "der und mit dass aus dieses haus wasser".split(), "fr": "le et avec que de cette maison eau".split(), "es": "el y con que desde esta casa agua".split()}
    rows = [(i, " ".join(rng.choice(words[c]) for _ in range(30)), c) for i, c in enumerate(list(words) * 60)]
    docs = spark.createDataFrame([*rows, (900, None, "en"), (901, "123 !!", "de"), (902, "", None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in op06_language.identify(docs).collect()}
    assert sum(got[i]["lang_pred"] == c for i, _, c in rows if got[i]["held_out"]) >= 0.95 * sum(got[i]["held_out"] for i, *_ in rows)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    none = op06_language.identify(docs.withColumn("lang", F.lit(None).cast("string")).limit(3)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_toxicity(spark):
    from sessionlake.llm import op03_toxicity

    rng = random.Random(2)
    calm = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(calm) for _ in range(60)]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                w[rng.randrange(60)] = rng.choice(["idiot", "m0ron", "zorgface", "you"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    frame = spark.createDataFrame([*docs, (700, None), (701, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in op03_toxicity.score(frame, marks).collect()}
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert len(got) == 602 and sum(p == y for p, y in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert got[700]["predicted"] == got[701]["predicted"] == 0
    assert {r["score"] for r in op03_toxicity.score(frame, marks.filter("toxic = 0")).collect()} == {0.0}


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I bake bread at home?\n\nI have no oven."),
        (1, 1, "assistant", "Use a pan with a lid.\nIt works well enough."),
        (1, 2, "user", "On Monday Bob wrote:\n> how do I bake  bread at home\n>\n> I have no oven.\n\nAlso for me."),
        (1, 3, "assistant", "> > I have no oven.\n> Use a pan with a lid.\nRight."),
        (1, 4, "user", "ok"),
        (2, 0, "user", "> Use a pan with a lid.\n> It works well enough.\nis this true?"),
        (2, 7, "user", None),
        (3, 0, "user", "> nobody said this sentence ever"),
        (None, 0, "user", "lost"),
        (1, 4, "user", "ok"),
    ]
    out = op01_quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r["conv_id"], r["turn"]): r for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1, 2]["text"] == "Also for me." and got[1, 2]["parent_turn"] == 0 and got[1, 2]["depth"] == 1
    assert got[1, 3]["parent_turn"] == 1 and [(x["level"], x["to_turn"]) for x in got[1, 3]["links"]] == [(2, 0), (1, 1)]
    assert got[1, 4]["parent_turn"] == 3 and got[1, 4]["root_turn"] == 0 and got[1, 4]["depth"] == 3
    assert [(x["to_conv"], x["to_turn"], x["kind"]) for x in got[2, 0]["links"]] == [(1, 1, 0)]
    assert got[2, 7]["parent_turn"] == 0 and got[3, 0]["links"] is None and got[None, 0]["root_turn"] is None


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (101, 100), (200, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert op04_anchors.kept_words(none).count() == op07_suffix.spans(none).count() == op10_jaccard.classes(none).count() == 0
    assert op02_bpe.encode(none, vocabulary_path()).count() == op09_rules.assess(none).count() == 0
    assert op06_language.identify(none).count() == 0 and op05_quality.resample(none, none.select("doc_id")).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert op08_decontaminate.find(docs, bench).count() == 0 and op08_decontaminate.find(none, bench).count() == 0
    assert op01_quotes.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
