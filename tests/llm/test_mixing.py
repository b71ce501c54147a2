import hashlib
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from paddock.llm import mixing as M
from paddock.llm.queries import SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def copies(doc_id, rate, seed=17):
    """Inverse distribution function at md5 numbers, in parts of at most PART."""
    parts = max(1, math.ceil(rate / M.PART))
    total = 0
    for part in range(parts):
        u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}/{part}".encode()).hexdigest()[:12], 16) / 2**48
        p = c = math.exp(-rate / parts)
        k = 0
        while c <= u:
            k += 1
            p *= rate / parts / k
            c += p
        total += k
    return total


def rows(n=3000):
    hot = [(i, f"t{i}", "en", "hot", 2) for i in range(n)]
    return hot + [(n + i, None, None, None, None) for i in range(40)] + [(9000, "x", "de", "rare", 1), (9001, "", "de", "mid", 0)] * 1 + [(1, "t1", "en", "hot", 2), (None, "n", "en", "hot", 1)]


def test_equals_brute_force_and_sql(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = Counter(tuple(r) for r in M.mixed(docs).select("doc_id", "text", "source", "copy_no").collect())
    n = Counter(r[3] for r in data)
    want = Counter()
    for d, text, _, source, _ in data:
        for c in range(copies(d, 1 / len(n) * len(data) / n[source])):
            want[d, text, source, c] += 1
    assert got == want
    assert max(c for (_, _, s, c), k in want.items() if s == "rare") > M.PART     # a rate of several parts
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64", "n_chars": "Int64"}))
    sql = con.sql(f"SELECT doc_id, copy_no, mix_key FROM ({SQL['op2_mix']})").fetchall()
    own = [tuple(r) for r in M.mixed(docs).select("doc_id", "copy_no", "mix_key").collect()]
    assert sorted(sql, key=str) == sorted(own, key=str)


def test_target_weights_and_size(spark):
    docs = spark.createDataFrame([(i, "t", "en", "a" if i % 3 else "b", 1) for i in range(6000)] + [(-i, "t", "en", "c", 1) for i in range(1, 50)], SCHEMA)
    got = {r["source"]: r["count"] for r in M.mixed(docs, {"a": 1, "b": 3}, size=2.0).groupBy("source").count().collect()}
    assert set(got) == {"a", "b"}
    assert got["a"] == pytest.approx(12098 / 4, rel=0.06) and got["b"] == pytest.approx(12098 * 3 / 4, rel=0.06)


def test_order_is_global_and_independent_of_partitions(spark):
    docs = spark.createDataFrame(rows(300), SCHEMA)
    a = M.mixed(docs).withColumn("p", F.spark_partition_id())
    b = M.mixed(docs.repartition(7)).withColumn("p", F.spark_partition_id())
    key = lambda df: sorted((str(r["doc_id"]), r["copy_no"], r["mix_key"], r["p"]) for r in df.collect())
    assert key(a) == key(b)
    assert len({r["p"] for r in a.select("p").distinct().collect()}) == 8


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "x", "en", "s", 1)] * 2, SCHEMA).withColumns({"copy_no": F.lit("old"), "parts": F.lit(1), "cdf": F.lit(2)})
    out = M.mixed(docs, size=3.0)
    assert sorted(out.columns) == sorted([*SCHEMA.replace("long", "").replace("string", "").replace(" ", "").split(","), "parts", "cdf", "copy_no", "mix_key"])
    assert out.count() == 2 * copies(1, 3.0)
    assert M.mixed(docs.where("false")).collect() == []
