import random

import pytest
from brute import jaccard_components as brute
from pyspark.sql import functions as F

from paddock.llm import jaccard_join as J
from paddock.llm.components import components
from paddock.llm.words import CHUNK, shingles, word_hashes

SCHEMA = "doc_id long, text string, digest string"


def corpus(seed=1):
    """Chains of edited copies, exact copies, shared passages, odd texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, passage = [], some(60)
    for _ in range(12):
        base = some(rng.choice([4, 6, 20, 80, 150]))
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append(" ".join(copy))
            base = copy if rng.random() < 0.5 else base
    hot = some(100)
    for _ in range(60):
        copy = list(hot)
        for _ in range(rng.randrange(0, 6)):
            copy[rng.randrange(len(copy))] = rng.choice(vocab)
        rows.append(" ".join(copy))
    rows += [" ".join(some(10) + passage + some(rng.randrange(30))) for _ in range(20)]
    rows += ["A b  C", "a\tB c", "", " \n ", None, None, "one", "one", "One two"] + [rows[3]] * 7
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(J, "MEMBERS", 8)
    monkeypatch.setattr(J, "OUTSIDERS", 3)
    rows = corpus(seed)
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in J.jaccard_components(docs).collect())
    assert got == brute(rows)


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None), (7, "x")]
    docs = spark.createDataFrame([(d, t, None) for d, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in J.jaccard_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (3, 0, 3), (7, 1, 7)], key=str)
    kept = J.one_of_each(docs).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in kept), key=str) == sorted([(1, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None), (7, "x")], key=str)
    assert J.jaccard_components(docs.where("false")).collect() == []
    assert J.one_of_each(docs.where("false")).collect() == []


@pytest.mark.parametrize("max_broadcast", [0, 1000])
def test_one_of_each_with_repeated_and_missing_ids(spark, max_broadcast):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    near = b + " more"
    rows = [(1, a), (2, a), (2, b), (2, b), (2, c), (3, near), (4, d), (4, d + " more"), (5, ""), (5, None), (None, c), (None, c), (None, "e f g"), (None, "e f g"), (None, ""), (None, None), (6, "own")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA).repartition(3)
    out = J.one_of_each(docs, max_broadcast=max_broadcast)
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    four = [g for g in got if g[0] == 4]
    five = [g for g in got if g[0] == 5]
    assert len(four) == len(five) == 1
    want = [(1, a), (2, b), (2, c), (None, c), (None, "e f g"), (None, ""), (None, None), (6, "own")]
    assert sorted((g for g in got if g[0] not in (4, 5)), key=str) == sorted(want, key=str)


def test_components_of_a_long_chain(spark):
    edges = spark.range(40).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)}


def test_hashes_do_not_depend_on_place():
    long = "Word " * (CHUNK // 4)
    texts = ["a b", None, long, "", "xé 中", "b a"]
    together = word_hashes(texts)
    for text, h in zip(texts, together, strict=True):
        assert (word_hashes([text])[0] == h).all()
    assert len(together[2]) == CHUNK // 4 and len(set(together[2])) == 1
    assert together[0][0] == together[5][1]
    assert len(shingles(together[2])) == 1


def test_classes_of_many_copies(spark, monkeypatch):
    """Copies of a heavy class are dealt by one row; frequent classes are joined without a shuffle."""
    rng = random.Random(11)
    base = " ".join(f"w{rng.randrange(500)}" for _ in range(60))
    near = [base.replace(f" {w} ", " changed ", 1) for w in base.split()[5:9]]
    rows = [(i, base) for i in range(300)] + [(1000 + i, near[i % 4]) for i in range(200)] + [(2000 + i, f"other text number {i} of its own kind here") for i in range(100)]
    rows += [(None, base), (None, near[0]), (3000, None), (3001, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    want = sorted(map(str, J.jaccard_components(docs).collect()))
    assert [eval(x.replace("Row", "dict"))["component_id"] for x in want if "doc_id=1001," in x] == [0]
    monkeypatch.setattr(J, "BUCKET_TOKENS", 500)
    dealt = []
    sets = J.candidate_sets
    monkeypatch.setattr(J, "candidate_sets", lambda docs, percent, buckets, copied: dealt.append(copied) or sets(docs, percent, buckets, copied))
    assert sorted(map(str, J.jaccard_components(docs).collect())) == want
    assert len(dealt[0]) == 5
