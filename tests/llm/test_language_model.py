import math
import random
import zlib
from collections import Counter

import pytest
from brute import words
from pyspark.sql import functions as F

from paddock.llm import language_model as M

SCHEMA = "doc_id long, text string, score string"


def discounts(values):
    n = [sum(v == k for v in values) for k in (1, 2, 3, 4)]
    out = [0.0, 0.5, 1.0, 1.5]
    if n[0] and n[1]:
        y = n[0] / (n[0] + 2 * n[1])
        out[1] = 1 - 2 * y * n[1] / n[0]
        if n[2]:
            out[2] = 2 - 3 * y * n[2] / n[1]
            if n[3]:
                out[3] = 3 - 4 * y * n[3] / n[2]
    return [min(max(d, 0), k) for k, d in enumerate(out)]


class Brute:
    def __init__(self, texts):
        lists = [words(t) + ["\n"] for t in texts]
        self.count = Counter(w for t in lists for w in t)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.pairs = Counter(p for t in lists for p in zip([" "] + t, t))
        self.seen = Counter(w for _, w in self.pairs)
        self.d2, self.d1 = discounts(self.pairs.values()), discounts(self.seen.values())
        self.context, self.rest = Counter(), Counter()
        for (v, _), n in self.pairs.items():
            self.context[v] += n
            self.rest[v] += self.d2[min(n, 3)]
        self.word_rest = sum(self.d1[min(n, 3)] for n in self.seen.values()) / len(self.pairs) if self.pairs else 1.0

    def p(self, v, w):
        lower = (self.seen[w] - self.d1[min(self.seen[w], 3)]) / max(1, len(self.pairs)) + self.word_rest / (self.v + 1)
        if not self.context[v]:
            return lower
        n = self.pairs.get((v, w), 0)
        return (n - self.d2[min(n, 3)] + self.rest[v] * lower) / self.context[v]

    def row(self, doc_id, text):
        w = words(text) + ["\n"]
        base = sum(math.log10((self.count[x] + 1) / (self.n + self.v + 1)) for x in w)
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2
        return (doc_id, held, len(w), sum(self.count[x] > 0 for x in w), self.n), (base, sum(math.log10(self.p(a, b)) for a, b in zip([" "] + w, w)))


def compare(spark, rows):
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in M.model_scores(docs).collect()), key=str)
    model = Brute([t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 7 != 2])
    want = sorted((a + b for a, b in (model.row(d, t) for d, t in rows)), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    return model


def rows(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)]
    out = [(i, " ".join(vocabulary[min(59, int(rng.expovariate(0.15)))] for _ in range(rng.randrange(0, 40)))) for i in range(n)]
    return out + [(900, None), (901, ""), (902, "never seen words"), (902, "never seen words"), (None, "W1 w1  W2"), (903, "\n\t")]


def test_equals_brute_force(spark):
    model = compare(spark, rows())
    every = [*model.count, "unknown"]
    for v in (" ", "w1", "never", "unknown"):
        assert sum(model.p(v, w) for w in every) == pytest.approx(1)


def test_small_blocks_hot_words_and_large_counts(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(M, "SCORE_TOKENS", 300)
    monkeypatch.setattr(M, "HOT_SHARE", 20)
    monkeypatch.setattr(M, "_small", lambda n, *c: small(n, *c))

    def small(counts, *columns, most=3):
        import numpy as np

        times = (counts + most - 1) // most
        rest = np.repeat(counts, times)
        place = np.arange(len(rest)) - np.repeat(np.cumsum(times) - times, times)
        return (np.minimum(most, rest - place * most).astype("<u2"), *(np.repeat(c, times) for c in columns))

    compare(spark, rows(2) + [(2000 + i, "the cat the cat the cat") for i in range(400)])


def test_counts_over_sixteen_bits():
    import numpy as np

    n, key = M._small(np.array([1, 65535, 65536, 200_000]), np.array([7, 8, 9, 10], dtype=np.uint64))
    assert n.dtype == "<u2" and [int(n[key == k].astype(int).sum()) for k in (7, 8, 9, 10)] == [1, 65535, 65536, 200_000]


def test_given_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    compare(spark, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_empty_tables_and_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(d, "a b", "x") for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2], SCHEMA)
    got = M.model_scores(docs).collect()
    assert len(got) == docs.count() and {(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got} == {(3, 0, 0, 0.0, 0.0)}
    assert M.model_scores(docs.where("false")).collect() == []
    assert M.model_scores(docs.withColumn("doc_id", F.lit(None).cast("long"))).where("held_out").count() == 0
