"""Many runners dealt by race in parts of bounded rows: the same rows as the
joins of the small form, and no shuffle of the runners besides the dealing."""

import re
from dataclasses import replace

import pytest

import paddock.operators.breakdown as B
import paddock.operators.fact as fact
from fixture_tables import duck_tables, random_tables, write_tables
from oracle_compare import compare
from oracle_sql import all_courses_sql
from paddock.operators import joins
from paddock.plans.all_courses import all_courses_breakdown
from paddock.plans.check_criteria import CHECK_SINCE
from paddock.sources import bind_driver_tables
from paddock.sources.tables import read_tables

SINCE = "2014-06-01 00:00:00"


@pytest.fixture()
def many(monkeypatch):
    """Tables count as large from 100 rows a part."""
    monkeypatch.setattr(joins, "MIN_PARTS", 2)
    monkeypatch.setattr(fact, "even_parts", lambda df, key: joins.even_parts(df, key, 100))


@pytest.fixture()
def platform(spark):
    """A session without this package's settings, nothing broadcast."""
    conf = {"spark.sql.requireAllClusterKeysForCoPartition": "true", "spark.sql.adaptive.forceOptimizeSkewedJoin": "false",
            "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows(df):
    return sorted(map(str, df.collect()))


def final_plan(df) -> list[str]:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def scans(lines, table):
    return [x for x in lines if "FileScan parquet" in x and re.search(rf"/{table}(\.parquet)?\]", x)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Race rows that stand twice, runners without race or horse number, runners that stand twice, payouts without either."""
    t = random_tables(spark, 11, n_races=150)
    gone = "CASE WHEN hash(race_id, horse_no, {k}) % {n} = 0 THEN NULL ELSE {c} END AS {c}"

    def holes(df, key):
        some = [gone.format(k=key, n=n, c=c) for c, n in (("race_id", 17), ("horse_no", 13))]
        return df.selectExpr(*[next((s for s in some if s.endswith(f"AS {c}")), c) for c in df.columns])

    result = t.result.unionByName(t.result.where("seq % 5 = 0"))
    t = replace(t, race=t.race.unionByName(t.race.where("race_id % 4 = 0")), result=holes(result, "seq"), refund=holes(t.refund, "refund"))
    root = str(tmp_path_factory.mktemp("odd"))
    write_tables(t, root)
    return read_tables(spark, root), duck_tables(root)


def test_dealt_form_equals_the_sql(spark, odd, many, platform):
    tables, con = odd
    df = all_courses_breakdown(tables, SINCE, None, 3, 0)
    assert any("shufflepartitionidpassthrough" in x for x in final_plan(df))
    r = compare(spark, "all", lambda s, p: df, all_courses_sql(SINCE, min_jockey_finishes=3, binding=False), "", con)
    assert r["ok"], r


def test_runners_are_dealt_once(spark, sf_small, many, platform):
    """Neither the payout join nor the in-race rank shuffles the runners; result and refund share their lines."""
    tables = bind_driver_tables(spark, sf_small)
    want = rows(all_courses_breakdown(tables, CHECK_SINCE, None, 3))
    df = all_courses_breakdown(tables, CHECK_SINCE, None, 3, 0)
    lines = final_plan(df)
    assert rows(df) == want and want
    assert not any(re.search(r"Exchange hashpartitioning\(race_id", x) for x in lines)
    assert len(scans(lines, "lineitem")) == 1 and len(scans(lines, "orders")) == 1


def test_rows_of_many_jockeys_are_summed_once(spark, sf_small, monkeypatch, platform):
    tables = bind_driver_tables(spark, sf_small)
    want = rows(all_courses_breakdown(tables, CHECK_SINCE, None, 3, 0))
    monkeypatch.setattr(B, "MAX_RANKED_JOCKEYS", 0)
    df = all_courses_breakdown(tables, CHECK_SINCE, None, 3, 0)
    lines = final_plan(df)
    assert rows(df) == want and want
    # One per plan of the three (keyed, jockey, in-race rank), as with few jockeys.
    sums = [x for x in lines if re.search(r"Exchange hashpartitioning\(place_id.*days.*dim_key", x)]
    assert len(sums) == 3


def test_even_parts(spark, monkeypatch):
    monkeypatch.setattr(joins, "MIN_PARTS", 2)
    even = spark.range(0, 4000, 1, 4).selectExpr("CASE WHEN id % 10 = 0 THEN NULL ELSE id DIV 8 END AS race_id", "id")
    assert joins.even_parts(even, "race_id", 10**6) is None
    assert joins.even_parts(even, "race_id", 400) == 10
    # A hot race would be one part's: the joins that AQE may split are right then.
    assert joins.even_parts(even.selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE race_id END AS race_id"), "race_id", 400) is None
    dealt = joins.dealt(even, "race_id", 10)
    parts = dealt.selectExpr("spark_partition_id() AS at", joins.PART).distinct().collect()
    assert len(parts) == 10 and all(r["at"] == r[joins.PART] for r in parts)
    assert rows(dealt.drop(joins.PART)) == rows(even.where("race_id IS NOT NULL"))
