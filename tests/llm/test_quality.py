import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.llm import quality as Q

SCHEMA = "doc_id long, text string, score string"


def test_held_out_accuracy(spark, sf_check):
    docs = spark.read.parquet(f"{sf_check}/documents.parquet")
    labels = spark.read.parquet(f"{sf_check}/labels.parquet")
    trees = Q.fit_quality(docs, labels)
    got = Q.quality_scores(docs, trees).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 50
    assert (got["predicted"] == got["quality"]).mean() > 0.95
    assert Q.quality_scores(docs, trees).count() == docs.count()
    assert {r["doc_id"] for r in Q.quality_scores(docs, trees).where("held_out").collect()} == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    kept = {r["doc_id"] for r in Q.good_documents(docs, trees).collect()}
    assert kept == {r["doc_id"] for r in Q.quality_scores(docs, trees).where("predicted = 1").collect()}


def test_flat_arrays_equal_a_walk_down_the_trees():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(2000, len(Q.NAMES))), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = Q.grow(x, y)

    def walk(row):
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 2 if row[feature[node]] > cut[node] else 2 * node + 1
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))

    score = trees.score(x)
    assert np.allclose(score[:200], [walk(r) for r in x[:200]])
    assert ((score > 0.5) == y).mean() > 0.97


def test_statistics_do_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = ["", None, "one", "A a A a.\nA a A a.", "é" * 10, "x " * 300_000] + [" ".join(rng.choice("ab cd ef").strip() for _ in range(50)) for _ in range(20)]
    together = Q.statistics(texts)
    assert all((Q.statistics([t])[0] == together[i]).all() for i, t in enumerate(texts))
    assert (together[:2] == 0).all() and np.isfinite(together).all()


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "a good text", "clash"), (1, "a good text", "clash"), (None, None, None), (2, "", None)], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (2, None), (77, 0), (None, 0)], "doc_id long, quality int")
    none = Q.quality_scores(docs, Q.fit_quality(docs, labels.where("false")))
    assert [r["score"] for r in none.collect()] == [0.5] * 4 and [r["predicted"] for r in none.collect()] == [0] * 4
    one = Q.quality_scores(docs, Q.fit_quality(docs, labels)).collect()
    assert all(r["score"] > 0.7 and r["predicted"] == 1 for r in one)
    assert sorted(str(r["doc_id"]) for r in one) == ["1", "1", "2", "None"]
    empty = docs.where("false")
    trees = Q.fit_quality(empty, labels)
    assert Q.quality_scores(empty, trees).collect() == [] and Q.good_documents(empty, trees).collect() == []
    assert Q.good_documents(docs.withColumn("x", F.lit(1.5)), Q.fit_quality(docs, labels)).columns == ["doc_id", "text", "score", "x"]


def test_scores_read_only_the_text(spark):
    a = spark.createDataFrame([(i, f"text number {i}", "en") for i in range(8)], "doc_id long, text string, lang string")
    trees = Q.fit_quality(a, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    b = a.select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit("de").alias("lang"))
    score = lambda d: [r["score"] for r in Q.quality_scores(d, trees).orderBy("doc_id").collect()]
    assert score(a) == pytest.approx(score(b))


def test_trees_grow_by_the_best_splits(monkeypatch):
    """Every split against all features and cuts, rows one by one; leaves against their formula."""
    for name, value in (("TREES", 4), ("DEPTH", 3), ("BINS", 8), ("LEAST", 5)):
        monkeypatch.setattr(Q, name, value)
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(400, 3)), 1)
    x[:, 2] = x[:, 2] > 0
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    y[rng.random(400) < 0.1] = 1
    trees = Q.grow(x, y)
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, Q.BINS + 1)[1:-1]).tolist())) for j in range(3)]
    total = [trees.base] * len(y)
    assert trees.base == pytest.approx(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    inner, split = (1 << Q.DEPTH) - 1, 0
    for t in range(Q.TREES):
        p = [1 / (1 + np.exp(-s)) for s in total]
        g, h = [a - b for a, b in zip(y, p, strict=True)], [q * (1 - q) for q in p]
        members = {0: list(range(len(y)))}
        for node in range(inner):
            rows = members.get(node, [])

            def value(of):
                return sum(g[i] for i in of) ** 2 / (sum(h[i] for i in of) + Q.SMOOTH)

            def gain(j, c, rows=rows):
                low = [i for i in rows if x[i, j] <= c]
                high = [i for i in rows if x[i, j] > c]
                return value(low) + value(high) - value(rows) if min(len(low), len(high)) >= Q.LEAST else 0.0

            best = max((gain(j, c) for j in range(3) for c in cuts[j]), default=0.0)
            j, c = int(trees.feature[t, node]), float(trees.cut[t, node])
            if np.isinf(c):
                assert best <= 1e-6 + 1e-9
            else:
                split += 1
                assert c in cuts[j] and gain(j, c) == pytest.approx(best, abs=1e-9)
            members[2 * node + 1] = [i for i in rows if x[i, j] <= c]
            members[2 * node + 2] = [i for i in rows if x[i, j] > c]
        for leaf in range(inner + 1):
            rows = members[inner + leaf]
            want = Q.RATE * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + Q.SMOOTH)
            assert trees.leaf[t, leaf] == pytest.approx(want, abs=1e-9)
            for i in rows:
                total[i] += want
    assert split > 10
    assert trees.score(x) == pytest.approx(1 / (1 + np.exp(-np.array(total))), abs=1e-9)
