"""Randomised race tables: Spark plans vs the per-side SQL (DuckDB).

The SQL computes counts, win recovery and place recovery as three
aggregations joined on the value, ranks in-race times on the runner rows
left-joined to each side's payouts, and so covers duplicated payout rows,
NULL / 0 finishes, NULL seq, NULL times and keys, ticket type 3, missing
horses and jockeys and namesake jockeys.
"""

import pytest

from fixture_tables import duck_tables, random_tables, write_tables
from oracle_compare import compare
from oracle_sql import all_courses_sql, analysis_rows_sql, breakdown_sql
from paddock import DIMENSIONS, CourseAnalysis, Criteria
from paddock.plans.all_courses import all_courses_breakdown
from paddock.sources.tables import read_tables

SINCE = "2014-06-01 00:00:00"
CRITERIA = [
    Criteria(3, True, 1200, "良", tuple(range(1, 13)), since=SINCE),
    Criteria(5, False, 1600, "重", (1, 2, 3, 4), since=SINCE),
    Criteria(3, True, 1200, "良", (1,), grade_race="A", since=SINCE),
]


@pytest.fixture(scope="module", params=[11, 23])
def random_db(request, spark, tmp_path_factory):
    tables = random_tables(spark, request.param, n_races=150)
    root = str(tmp_path_factory.mktemp(f"rnd{request.param}"))
    write_tables(tables, root)
    return read_tables(spark, root), duck_tables(root)


@pytest.mark.parametrize("ci", range(len(CRITERIA)))
def test_breakdowns_match_sql(spark, random_db, ci):
    tables, con = random_db
    c = CRITERIA[ci]
    a = CourseAnalysis(tables, c, min_jockey_finishes=3)
    for d in DIMENSIONS:
        r = compare(spark, d.query, lambda s, p: a.breakdown(d), breakdown_sql(c, d, 3, binding=False),
                    "", con)
        assert r["ok"], r


def test_all_courses_match_sql(spark, random_db):
    tables, con = random_db
    r = compare(spark, "all_courses", lambda s, p: all_courses_breakdown(tables, SINCE, None, 3),
                all_courses_sql(SINCE, min_jockey_finishes=3, binding=False), "", con)
    assert r["ok"], r
    assert r["spark_rows"] > 100


def test_reports_match_sql(spark, random_db):
    """JSON payloads of all eleven dimensions (decimal keys, jockey order)."""
    tables, con = random_db
    c = CRITERIA[0]
    a = CourseAnalysis(tables, c, min_jockey_finishes=3)
    r = compare(spark, "reports", lambda s, p: a.reports(DIMENSIONS),
                analysis_rows_sql(c, DIMENSIONS, 3, binding=False), "", con)
    assert r["ok"], r


@pytest.fixture(scope="module")
def hot_db(spark, tmp_path_factory):
    """Race 1 holds 3,000 runners -- about 40 % of all runner rows."""
    tables = random_tables(spark, 7, n_races=800, hot_runners=3000)
    root = str(tmp_path_factory.mktemp("hot"))
    write_tables(tables, root)
    return read_tables(spark, root), duck_tables(root)


def test_hot_race_matches_sql(spark, hot_db):
    tables, con = hot_db
    share = tables.result.where("race_id = 1").count() / tables.result.count()
    assert share > 0.33
    # graded mode on the hot race's name: the hot race is selected
    hot_name = tables.race.where("race_id = 1").first()["name"]
    c = Criteria(3, True, 1200, "良", (1,), grade_race=hot_name, since=SINCE)
    a = CourseAnalysis(tables, c, min_jockey_finishes=3)
    assert a.races().where("race_id = 1").count() == 1
    for d in DIMENSIONS:
        r = compare(spark, d.query, lambda s, p: a.breakdown(d), breakdown_sql(c, d, 3, binding=False),
                    "", con)
        assert r["ok"], r
    r = compare(spark, "all_courses", lambda s, p: all_courses_breakdown(tables, SINCE, None, 3),
                all_courses_sql(SINCE, min_jockey_finishes=3, binding=False), "", con)
    assert r["ok"], r
