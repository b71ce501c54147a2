import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.llm import language_id as L

SCHEMA = "doc_id long, text string, lang string, score string"


def test_held_out_accuracy(spark, sf_check):
    docs = spark.read.parquet(f"{sf_check}/documents.parquet")
    model = L.learn_languages(docs)
    assert set(model.families) == {"germanic", "romance"} and set(model.pair_at) == {("de", "en"), ("es", "fr")}
    got = L.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == docs.count()
    held = got[got["held_out"]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.95
    assert got["score"].between(0, 1).all()
    assert set(held["doc_id"]) == {d for d in got["doc_id"] if zlib.crc32(str(d).encode()) % 4 == 2}


def test_language_is_no_input_of_a_prediction(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    model = L.learn_languages(docs)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy"))
    rows = lambda d: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.languages(d, model).collect()}
    assert rows(docs) == rows(other)


def test_three_in_a_family_and_a_family_of_one(spark):
    words = {"en": "the and with that house water", "de": "der und nicht das haus wasser", "nl": "het een niet maar huis water", "fr": "le est dans une maison eau", "xq": "qqa zzu qqi zzo"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words[k].split(), 12)), k, None) for i, k in enumerate(list(words) * 40)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = L.learn_languages(docs)
    assert model.families["germanic"] == ["de", "en", "nl"] and model.families["xq"] == ["xq"]
    got = {r["doc_id"]: r["lang_pred"] for r in L.languages(docs, model).collect()}
    assert np.mean([got[i] == k for i, _, k, _ in rows]) > 0.97


def test_defined_cases(spark):
    rows = [(1, "the house and the water", "en", "x"), (1, "the house and the water", "en", "x"), (None, "eine Frau", None, None), (2, None, "de", None),
            (3, "", "de", None), (4, " 12 + 3 !", "en", None), (5, "é", "en", None), (6, "the water " * 200_000, "en", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r["doc_id"], r["lang_pred"]) for r in L.languages(docs, L.learn_languages(docs, skip=9)).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (1, "en"), (None, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (6, "en")], key=str)
    none = L.learn_languages(docs.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in L.languages(docs, none).collect()} == {("und", 0.0)}
    assert L.languages(docs.where("false"), none).collect() == []


def test_long_texts_are_read_whole():
    text = "abc déf " * 300_000
    assert L.gram_counts(text).sum() == pytest.approx(4 * len(text.encode()), rel=1e-3)
    assert np.abs(L.gram_counts(text[:800]) / 800 - L.gram_counts(text) / len(text)).max() < 0.01


def plain_grams(text):
    counts = {}
    raw = L.normal_bytes(b" " + text.encode() + b" ").tobytes()
    for n in L.GRAMS:
        for i in range(len(raw) - n + 1):
            value = int.from_bytes(raw[i:i + n], "big") + n
            slot = (value * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - L.BITS
            counts[slot] = counts.get(slot, 0) + 1
    return counts


def plain_prediction(model, text):
    """The decision rule in loops: the family of the largest margin, then a vote for each pair."""
    counts = plain_grams(text)
    whole = sum(counts.values())

    def sure(machine):
        margin = float(model.offsets[machine]) + sum((n / whole) ** 0.5 * float(model.weights[s, machine]) for s, n in counts.items())
        return margin, 1 / (1 + np.exp(-2 * min(15, max(-15, margin))))

    families = sorted(model.families)
    family, score = families[0], 1.0
    if len(families) > 1:
        _, family = max(((sure(model.family_at[f])[0], -k), f) for k, f in enumerate(families))
        score = sure(model.family_at[family])[1]
    members = sorted(model.families[family])
    votes, least = dict.fromkeys(members, 0), dict.fromkeys(members, 1.0)
    for (a, b), machine in model.pair_at.items():
        if a in votes and b in votes:
            p = sure(machine)[1]
            votes[a if p >= 0.5 else b] += 1
            least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
    best = max(members, key=lambda m: (votes[m], -members.index(m)))
    return best, score * least[best]


def test_equals_the_rule_in_loops(spark):
    words = {"en": "the and with that house water", "de": "der und nicht das haus wasser", "nl": "het een niet maar huis water", "fr": "le est dans une maison eau",
             "es": "el es en una casa agua", "xq": "qqa zzu qqi zzo"}
    rng = np.random.default_rng(5)
    mixed = " ".join(words.values()).split()
    rows = [(i, " ".join(rng.choice(words[k].split(), 9)), k, None) for i, k in enumerate(list(words) * 30)]
    rows += [(1000 + i, " ".join(rng.choice(mixed, int(rng.integers(1, 9)))), None, None) for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = L.learn_languages(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.languages(docs, model).collect()}
    for i, text, _, _ in rows:
        name, score = plain_prediction(model, text)
        assert got[i][0] == name and got[i][1] == pytest.approx(score, abs=1e-4), text
    assert {p for p, _ in got.values()} == set(words)


def test_machines_reach_the_smallest_loss():
    """Squared hinge with both classes of equal weight, against plain gradient steps."""
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(120, 6)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=120) > x[:, 1], 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())

    def loss(w, b):
        return float((weight * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum() + L.RIDGE / 2 * (w @ w))

    w, b = np.zeros(6), 0.0
    for _ in range(20_000):
        pull = weight * np.maximum(0, 1 - y * (x @ w + b)) * y
        w, b = w - 0.2 * (L.RIDGE * w - 2 * pull @ x), b + 0.4 * pull.sum()
    own_w, own_b = L.fit_svm(x.astype(np.float32), y)
    assert loss(own_w, own_b) <= loss(w, b) + 2e-3
    assert (np.sign(x @ own_w + own_b) == np.sign(x @ w + b)).mean() > 0.97
