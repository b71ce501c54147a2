"""Vector codes against plain Python and SQL."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from paddock.llm import vector_codes as V
from paddock.llm.queries import SQL

SCHEMA = "vec_id long, embedding array<float>, label int, code string, position int"


def brute(rows, parts=8, entries=16, rounds=6):
    """[(vec_id, vector, label)] -> sorted (vec_id, code, error, label_error, digest)."""
    sound = [(i, v, c) for i, v, c in rows if v and len(v) % parts == 0 and all(x is not None and np.isfinite(x) for x in v)]
    if not sound:
        return []
    common = max(Counter(len(v) for _, v, _ in sound).items(), key=lambda t: (t[1], t[0]))[0]
    whole = [(i, [int(np.floor(4096 * float(np.float32(x)))) for x in v], c) for i, v, c in sound if len(v) == common]
    width = common // parts
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * width:(p + 1) * width] for r in first] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            members = {}
            for _, v, _ in whole:
                part = v[p * width:(p + 1) * width]
                members.setdefault(near(part, book)[1], []).append(part)
            books[p] = [[sum(x) // len(members[k]) for x in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(book)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for i, v, c in whole:
        found = [near(v[p * width:(p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), c))
        by_label[c] += out[-1][2]
    return sorted(((i, code, e, by_label[c], digest) for i, code, e, c in out), key=repr)


def vectors(n=260, width=16, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(20, width)) / 4
    rows = [(int(i), [float(x) for x in np.float32(centre[i % 20] + rng.normal(size=width) / 30)], int(i % 5)) for i in rng.permutation(n)]
    rows += [(1000 + i, rows[3][1], None) for i in range(120)]                     # one vector of a third of the rows
    rows += [(2000 + i, [round(x, 1) for x in r[1]], 7) for i, r in enumerate(rows[:60])]    # shared prefixes and ties
    rows += [rows[0], rows[0], (None, rows[5][1], 1)]
    return rows


def odd(width=16):
    return [(3000, None, 1), (3001, [], 1), (3002, [0.5] * 8, 1), (3003, [0.5] * (width + 1), 1), (3004, [float("nan")] + [0.0] * (width - 1), 1),
            (3005, [float("inf")] + [0.0] * (width - 1), 2), (3006, [None] + [0.0] * (width - 1), 2)]


def frame(spark, rows, pieces=5):
    return spark.createDataFrame([(i, v, c, "x", 1) for i, v, c in rows], SCHEMA).repartition(pieces)


@pytest.mark.parametrize("bounds", [{}, {"LEAVES": 7, "BLOCK": 64, "MAX_LABELS": 0}, {"LEAVES": 1, "BLOCK": 1}])
def test_equals_brute_force(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(V, name, value)
    rows = vectors() + odd()
    got = V.vector_codes(frame(spark, rows))
    assert got.dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_equals_sql(spark):
    rows = [r for r in vectors(seed=4) if r[0] is not None]
    rows += [r for r in odd() if r[1] is None or len(r[1]) == 16]
    df = frame(spark, rows)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    want = con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({SQL['op11_codes']})").fetchall()
    assert sorted(map(tuple, V.vector_codes(df).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 3, 2), (1, 40, 1), (16, 256, 0), (2, 5, 4)])
def test_other_shapes(spark, parts, entries, rounds):
    rows = vectors(n=40, seed=parts)
    got = V.vector_codes(frame(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, parts, entries, rounds)


def test_few_vectors_and_none(spark):
    few = [(5, [1.0] * 8, 1), (2, [-1.0] * 8, None), (2, [-1.0] * 8, None)]
    assert sorted(map(tuple, V.vector_codes(frame(spark, few)).collect()), key=repr) == brute(few)
    for rows in ([], odd()[:2] + odd()[4:]):
        empty = V.vector_codes(spark.createDataFrame([(i, v, c, "x", 1) for i, v, c in rows], SCHEMA))
        assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_too_large_numbers_raise(spark):
    with pytest.raises(Exception, match="too large"):
        V.vector_codes(frame(spark, [(1, [20_000.0] * 8, 1)])).collect()


def test_trie_shares_prefixes_and_is_exact(monkeypatch):
    monkeypatch.setattr(V, "LEAVES", 50)
    rng = np.random.default_rng(0)
    rows, _ = V.sorted_distinct(rng.integers(-3, 3, (4000, 5)))
    entries = rng.integers(-3, 3, (9, 5))
    walked = []
    leaves = V.Trie.leaves
    monkeypatch.setattr(V.Trie, "leaves", lambda self, low, high, d, *rest: walked.append((low, high, d)) or leaves(self, low, high, d, *rest))
    code, error = V.Trie(rows).nearest(entries)
    d = ((rows[:, None, :] - entries) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (error == d.min(1)).all()
    # Depth first: every row once, from left to right, in bounded runs that begin below the root.
    assert [a for a, _, _ in walked] == [0, *(b for _, b, _ in walked[:-1])] and walked[-1][1] == len(rows)
    assert max(b - a for a, b, _ in walked) <= 50 and min(d for _, _, d in walked) >= 1
