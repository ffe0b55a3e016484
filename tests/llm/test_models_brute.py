"""op3, op5 and op6 against plain Python: features, weights, noise, decisions and the calibration curve."""

import math
import random
import re
import string
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionlake.llm import hashing as hs
from sessionlake.llm import op03_toxicity as op3
from sessionlake.llm import op05_quality as op5
from sessionlake.llm import op06_language as op6

M = 1 << 64
SPACE = " \t\n\x0b\x0c\r"


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % M
    return x ^ (x >> 31)


def run_hash(values):
    return mix(sum(v * pow(hs.BASE, i, M) for i, v in enumerate(values)) % M)


def word_hash(word):
    return run_hash([mix((b + 1) * hs.BASE % M) for b in word.encode()])


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def noise(seed, doc_id):
    """Spark's xxhash64 of an int and a long."""
    first = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    signed = xxhash.xxh64_intdigest(struct.pack("<q", doc_id), first)
    signed -= M if signed >> 63 else 0
    u = (signed % 2**53 + 0.5) / float(2**53)
    return -math.log(-math.log(u))


@pytest.mark.parametrize("fraction", [0.5, 0.1])
def test_importance_resampling(spark, tmp_path, fraction):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(3)
    vocab = ["good", "Good", "bad", "é☃", "the", "x"]
    rows = [(i, "".join(rng.choice(vocab) + rng.choice(list(SPACE)) for _ in range(rng.randint(0, 25)))) for i in range(200)]
    good = {i for i, t in rows if lowered(t).count("good") > 5}
    counts = {True: {}, False: {}}
    grams = {}
    for i, text in rows:
        words = [word_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", lowered(text))]
        grams[i] = [w % op5.BUCKETS for w in words] + [run_hash(p) % op5.BUCKETS for p in zip(words, words[1:], strict=False)]
        for which in (False, *([True] if i in good else [])):
            for g in grams[i]:
                counts[which][g] = counts[which].get(g, 0) + 1
    total = {k: sum(v.values()) + op5.BUCKETS for k, v in counts.items()}
    log_p = lambda which, g: math.log(counts[which].get(g, 0) + 1) - math.log(total[which])
    weight = {i: sum(log_p(True, g) - log_p(False, g) for g in gs) for i, gs in grams.items() if gs}
    key = {i: w + noise(op5.SEED, i) for i, w in weight.items()}
    chosen = set(sorted(key, key=lambda i: (-key[i], i))[: round(len(key) * fraction)])
    got = {r["doc_id"]: r for r in op5.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in good], "doc_id long"), fraction).collect()}
    assert len(got) == 200 and {i for i, r in got.items() if r["selected"]} == chosen
    for i, r in got.items():
        assert r["log_weight"] == pytest.approx(weight[i], rel=1e-9, abs=1e-9) if i in weight else r["log_weight"] is None
        assert i not in key or r["key"] == pytest.approx(key[i], rel=1e-9, abs=1e-9)


def trigrams(text):
    counts = {}
    data = lowered(text).encode()
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        k = (((a * 65599 + b * 257 + c) * 2654435761) >> 7) & (op6.DIMENSIONS - 1)
        counts[k] = counts.get(k, 0) + 1
    size = math.sqrt(sum(counts.values()))
    return {k: math.sqrt(n) / size for k, n in counts.items()}


def duel_winner(duels, x):
    wins, sums = {n: 0 for n in duels.names}, {n: 0.0 for n in duels.names}
    least = {n: 50.0 for n in duels.names}
    for a, b, w, c in duels.pairs:
        m = sum(float(w[k]) * v for k, v in x.items()) + c
        for side, margin in ((duels.names[a], -m), (duels.names[b], m)):
            wins[side] += margin > 0
            sums[side] += margin
            least[side] = min(least[side], margin)
    best = max(duels.names, key=lambda n: (wins[n], sums[n]))
    return best, 1 / (1 + math.exp(-2 * max(-30, min(30, least[best]))))


def test_one_versus_one(spark, tmp_path):
    """Every prediction follows from the weights that were learned, over trigrams counted by hand."""
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rng = random.Random(6)
    syllables = {"en": "the of and ing ion", "de": "der und ein sch ung", "fr": "les des une eau oux", "es": "los del una cion ado"}
    rows = [(i, " ".join(rng.choice(syllables[lang].split()) for _ in range(rng.randint(0, 40))) + rng.choice(["", "É", " 12"]), lang) for i in range(320) for lang in [rng.choice(list(syllables))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = op6.train(docs)
    assert models[0].names == ["germanic", "romance"] and {n for d in models[1].values() for n in d.names} == set(syllables)
    right = 0
    for r in op6.predict(docs, models).collect():
        text = rows[r["doc_id"]][1]
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        x = trigrams(text)
        family, sure = duel_winner(models[0], x)
        language, also = duel_winner(models[1][family], x)
        assert r["lang_pred"] == language and r["score"] == pytest.approx(sure * also, abs=1e-4)
        right += language == rows[r["doc_id"]][2]
    assert right > 280


LETTERS = re.compile(rb"[A-Za-z\x80-\xff]")


def plain_features(text, seed, learned, you):
    """op3's features, counted byte by byte and word by word."""
    data = text.encode()
    stripped = lambda d: (lowered(w).strip(string.punctuation) for w in re.findall(r"[^\x20\x09-\x0D]+", d.decode()))
    plain = lambda d: [w for w in stripped(d) if w]
    words = plain(data)
    undone = data.translate(bytes(op3.UNDONE))
    hits = [w in seed or w in learned for w in words]
    hidden = max(0, sum(w in seed or w in learned for w in plain(undone)) - sum(hits))
    near = sum(h and any(words[j] in you for j in range(max(0, i - op3.NEAR), min(len(words), i + op3.NEAR + 1))) for i, h in enumerate(hits))
    n_words, n = max(1, len(words)), max(1, len(data))
    is_letter = [bool(LETTERS.match(bytes([b]))) for b in data]
    upper = [65 <= b <= 90 for b in data]
    odd = [not letter and chr(b) not in SPACE for letter, b in zip(is_letter, data, strict=True)]
    mid = range(1, len(data) - 1)
    mixed = sum(is_letter[i - 1] and is_letter[i + 1] and odd[i] and data[i] not in (39, 45) for i in mid)
    last = range(2, len(data))
    stretched = sum(is_letter[i] and data[i] == data[i - 1] == data[i - 2] for i in last)
    shouted = sum(upper[i] and upper[i - 1] and upper[i - 2] for i in last)
    rates = [sum(upper) / n, shouted / n, data.count(33) / n, sum(o and b != 33 for o, b in zip(odd, data, strict=True)) / n, mixed / n, stretched / n]
    return [sum(w in seed for w in words) / n_words, sum(w in learned for w in words) / n_words, hidden / n_words, near / n_words, *rates, math.log1p(len(words))]


def test_toxicity_features():
    rng = random.Random(8)
    learned = ["blurp", "zonk", "é☃"]
    pool = ["you", "You", "idiot", "1diot", "m0ron", "blurp", "ZONK", "the", "sooo", "WHAT", "it's", "a-b", "x.y", "!!!", "é☃", "12", "$tupid", "dich"]
    texts = ["", "!", "ab", *("".join(rng.choice(pool) + rng.choice([" ", "\n", ", ", "!"]) for _ in range(rng.randint(1, 30))) for _ in range(150))]
    (_, data, offsets), *rest = hs.text_slices(pa.array(texts))
    assert not rest
    got = op3.features(data, offsets, op3.hashed(op3.SEED), op3.hashed(learned), op3.hashed(op3.SECOND_PERSON))
    want = [plain_features(t, set(op3.SEED), set(learned), set(op3.SECOND_PERSON)) for t in texts]
    for k, name in enumerate(op3.NAMES):
        assert got[:, k] == pytest.approx([w[k] for w in want]), name


def test_calibration_curve(spark):
    x, y = np.array([0.1, 0.4, 0.9]), np.array([0.0, 0.5, 1.0])
    rows = spark.createDataFrame([(c / 20,) for c in range(21)], "chance double")
    for r in op3.calibrate(rows.withColumn("c", F.col("chance")), x, y).collect():
        c = r["c"]
        want = 0.0 if c <= 0.1 else 1.0 if c >= 0.9 else (c - 0.1) / 0.3 * 0.5 if c <= 0.4 else 0.5 + (c - 0.4) / 0.5 * 0.5
        assert r["score"] == pytest.approx(want)
