import random

import pytest
from brute import jaccard_components

import __spark_entry__ as E
import corpus_pipeline as C
from paddock.llm import decontaminate, mixing, pseudonyms, quality
from paddock.llm.common import stored


def test_stages_equal_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    now, seen = docs, {}
    for name, stage in C.STAGES:
        now = stored(stage(spark, now, sf_small), f"test-{name}")
        seen[name] = now
        if name != "mixing":
            assert now.columns == docs.columns
    ids = {name: {r["doc_id"] for r in df.collect()} for name, df in seen.items()}

    trees = quality.fit_quality(docs, spark.read.parquet(f"{sf_small}/labels.parquet"))
    good = {d for d, r in rows.items() if trees.score(quality.statistics([r["text"]]))[0] >= quality.THRESHOLD}
    assert ids["quality"] == good and 0 < len(good) < len(rows)

    groups = jaccard_components([(d, rows[d]["text"]) for d in sorted(good)])
    assert ids["near_duplicates"] == {d for d, _, c in groups if d == c}
    assert len(ids["near_duplicates"]) < len(good)

    items = [decontaminate.normal_bytes(r["text"].encode()).tobytes().strip() for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    exact = {d for d in ids["near_duplicates"] if any(i in decontaminate.item_bytes(rows[d]["text"]) for i in items)}
    assert exact and ids["decontamination"] == ids["near_duplicates"] - exact

    p = pseudonyms.Pseudonyms(pseudonyms.key_of(spark))
    assert {r["doc_id"]: r["text"] for r in seen["pii"].collect()} == {d: pseudonyms.rewrite(rows[d]["text"], p)[0] for d in ids["decontamination"]}

    from test_mixing import copies

    kept = [rows[d] for d in ids["pii"]]
    n = {}
    for r in kept:
        n[r["source"]] = n.get(r["source"], 0) + 1
    want = sorted((r["doc_id"], c) for r in kept for c in range(copies(r["doc_id"], 1 / len(n) * len(kept) / n[r["source"]])))
    assert sorted((r["doc_id"], r["copy_no"]) for r in seen["mixing"].collect()) == want
    assert sorted((r["doc_id"], r["copy_no"]) for r in C.run(spark, sf_small).collect()) == want


def test_defined_cases(spark, sf_small):
    """NULLs, repeated rows, odd texts and clashing columns go through every stage."""
    rng = random.Random(1)
    base = spark.read.parquet(f"{sf_small}/documents.parquet").limit(30).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x", 1) for r in base]
    rows += rows[:5] + [(None, None, None, None, None, None, None), (None, "some words here", None, None, None, None, 2), (900, "", "en", "src0", 0, "", 0), (901, "word " * 100_000, "en", "src1", 0, "", 0), (902, None, "en", None, 0, "", 0)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, score int")
    for _, stage in C.STAGES:
        out = stored(stage(spark, docs, sf_small), "test-cases")
        empty = stage(spark, docs.where("false"), sf_small)
        assert empty.collect() == [] and set(docs.columns) <= set(out.columns)
        if stage is C.near_duplicates:
            ids = [r["doc_id"] for r in out.where("doc_id IS NOT NULL").collect()]
            assert len(ids) == len(set(ids)) and {900, 902} <= set(ids)
            assert out.where("doc_id IS NULL").count() == 2
        if stage in (C.decontamination, C.pii):
            assert out.where("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_is_registered(n):
    assert sum(q.startswith(f"op{n}_") for q in E.queries()) == 1


def test_registered_names():
    assert "pipeline" in E.queries() and {"op2_mix", "op9_jaccard"} <= set(E.oracle_sql()) <= set(E.queries())
    assert [name for name, _ in C.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "mixing"]
