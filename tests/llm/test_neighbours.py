import numpy as np
import pytest
from pyspark.sql import functions as F

from paddock.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, part string"


def brute(rows, queries, k):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    size = np.bincount([len(v) for v in good.values()]).argmax()
    good = {i: v for i, v in good.items() if len(v) == size}
    out = {}
    for q in queries:
        if q in good:
            near = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
            out[q] = [i for _, i in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def recall(got, want):
    return np.mean([len({v for _, v, _ in got.get(q, [])} & set(near)) / len(near) for q, near in want.items()])


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = found(N.nearest_vectors(table, F.col("vec_id") % 20 == 0, sample=1500))
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 10)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    vec = {i: np.array(v, dtype=np.float64) for i, v in rows}
    for q, near in got.items():
        assert [r for r, _, _ in near] == list(range(1, 11))
        assert near == sorted(near, key=lambda x: (x[2], x[1]))
        assert all(s == pytest.approx(float(np.linalg.norm(vec[q] - vec[v])), rel=1e-12) for _, v, s in near)


def test_clusters_need_few_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16)) * 5
    x = centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))
    router = N.learn_router(x, 16, 10)
    assert router.probes <= 4
    assert np.bincount(router.parts(x), minlength=16).max() < 3 * len(x) / 16
    monkeypatch.setattr(N, "ROWS", 200)
    monkeypatch.setattr(N, "QUERIES", 7)
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(x)]
    got = found(N.nearest_vectors(spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA).repartition(4), F.col("vec_id") % 50 == 0))
    assert recall(got, brute(rows, range(0, 4000, 50), 10)) >= 0.9


def test_one_vector_in_a_third_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 100)
    rng = np.random.default_rng(2)
    same = rng.normal(size=8).astype("float32").tolist()
    rows = [(i, same if i % 3 == 0 else rng.normal(size=8).astype("float32").tolist()) for i in range(1500)]
    got = found(N.nearest_vectors(spark.createDataFrame([(i, v, "") for i, v in rows], SCHEMA), F.col("vec_id") % 30 == 0))
    want = brute(rows, range(0, 1500, 30), 10)
    assert recall(got, want) >= 0.9
    assert [v for _, v, _ in got[30]] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]       # ties: smaller ids


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 0.0]), (200, None), (300, [nan, 1.0]), (400, [1.0, None]), (500, [inf, 1.0]), (600, [1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (700, []), (3, [3.0, 0.0])]
    docs = spark.createDataFrame([(i, v, "x") for i, v in rows] + [(None, [1.0, 0.5], "x")], SCHEMA)
    got = found(N.nearest_vectors(docs, F.col("vec_id") % 100 == 0))
    assert {q: [v for _, v, _ in near] for q, near in got.items()} == {0: [1, 3, 2]}
    twice = found(N.nearest_vectors(docs.unionByName(docs), F.col("vec_id") % 100 == 0))
    assert [v for _, v, _ in twice[0]] == [1, 1, 3, 3, 2, 2]
    assert N.nearest_vectors(docs.where("false"), F.col("vec_id") % 100 == 0).collect() == []
    assert N.nearest_vectors(docs.where("vec_id = 0"), F.col("vec_id") % 100 == 0).collect() == []


def test_recall_of_the_registered_query(spark):
    """Production sample and queries, every row a candidate."""
    from paddock.llm.queries import op3_nearest

    folder = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = found(op3_nearest(spark, folder))
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_two_levels_of_parts(spark, monkeypatch):
    """Beyond MAX_PARTS every part is cut again: recall holds, and queries meet fewer rows."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 12)) * 6
    rows = [(i, [float(v) for v in np.float32(centres[i % 60] + rng.normal(size=12))], "p") for i in range(9000)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = brute([(i, v) for i, v, _ in rows], [i for i in range(0, 9000, 100)], 10)
    seen = {}
    tables = {}
    keep = N.stored
    monkeypatch.setattr(N, "stored", lambda df, name: tables.setdefault(name, keep(df, name)))
    for parts in (24, 6):
        monkeypatch.setattr(N, "MAX_PARTS", parts)
        tables.clear()
        got = found(N.nearest_vectors(table, F.col("vec_id") % 100 == 0))
        assert set(got) == set(want) and recall(got, want) >= 0.9
        placed, routed = (tables.get(f"{n}-again", tables[n]) for n in ("placed", "routed"))
        assert placed.count() == 9000
        size = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
        seen[parts] = sum(size.get(r["part"], 0) for r in routed.select("part").collect()) / len(want)
        assert len(size) > 12
    assert "placed-again" in tables and max(seen.values()) < 9000 / 3
