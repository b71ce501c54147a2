"""Results do not depend on the size bounds: small (broadcast) and large
(shuffled) forms agree with each other and with the inner-join SQL, with
repeated race, horse and jockey ids in the tables."""

import pytest

import paddock.operators.breakdown as B
from fixture_tables import duck_tables, random_tables, write_tables
from oracle_compare import compare
from oracle_sql import all_courses_sql, breakdown_sql, race_pred
from paddock import DIMENSIONS, CourseAnalysis, Criteria
from paddock.plans.all_courses import all_courses_breakdown, all_courses_reports
from paddock.plans.dimensions import dimension
from paddock.sources.tables import read_tables

SINCE = "2014-06-01 00:00:00"
C = Criteria(3, True, 1200, "良", tuple(range(1, 13)), since=SINCE)
GRADED = Criteria(3, True, 1200, "良", (1,), grade_race="A", since=SINCE)


@pytest.fixture(scope="module")
def twice(spark, tmp_path_factory):
    """Random tables whose every race row, and every third horse and jockey row, stands twice."""
    from dataclasses import replace

    t = random_tables(spark, 5, n_races=120)
    t = replace(t, race=t.race.unionByName(t.race), horse=t.horse.unionByName(t.horse.where("id % 3 = 0")),
                jockey=t.jockey.unionByName(t.jockey.where("id % 3 = 0")))
    root = str(tmp_path_factory.mktemp("twice"))
    write_tables(t, root)
    return read_tables(spark, root), duck_tables(root)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("c", [C, GRADED], ids=["course", "graded"])
def test_both_forms_equal_the_sql(spark, twice, c):
    tables, con = twice
    small, large = (CourseAnalysis(tables, c, max_broadcast_rows=m, min_jockey_finishes=3) for m in (10**6, 0))
    n = con.sql(f"SELECT count(*) FROM result JOIN race USING (race_id) WHERE {race_pred(c)}").fetchall()[0][0]
    races = con.sql(f"SELECT count(*) FROM race WHERE {race_pred(c)}").fetchall()[0][0]
    for a in (small, large):
        assert a.count_horse().first()[0] == n > 0
        s = a.summary().first()
        assert (s["target_race"], s["target_horse"]) == (races, n)
    assert rows(small.breakdown_all()) == rows(large.breakdown_all())
    for d in DIMENSIONS:
        r = compare(spark, d.query, lambda s, p: large.breakdown(d), breakdown_sql(c, d, 3, binding=False), "", con)
        assert r["ok"], r


def test_all_courses_both_forms(spark, twice):
    tables, con = twice
    for m in (10**6, 0):
        r = compare(spark, "all", lambda s, p: all_courses_breakdown(tables, SINCE, None, 3, m),
                    all_courses_sql(SINCE, min_jockey_finishes=3, binding=False), "", con)
        assert r["ok"], r
    a, b = (rows(all_courses_reports(tables, SINCE, max_broadcast_rows=m)) for m in (10**6, 0))
    assert a == b and a


def test_ranks_of_many_jockeys(spark, twice, monkeypatch):
    """Jockeys ranked by pieces of the rate: same rows as by a window, and as the SQL."""
    tables, con = twice
    want = rows(CourseAnalysis(tables, GRADED, min_jockey_finishes=1).breakdown_all(["jockey", "frame_no"]))
    want_all = rows(all_courses_breakdown(tables, SINCE, ["jockey"], 1))
    monkeypatch.setattr(B, "MAX_RANKED_JOCKEYS", 0)
    many = CourseAnalysis(tables, GRADED, min_jockey_finishes=1)
    assert rows(many.breakdown_all(["jockey", "frame_no"])) == want
    assert rows(all_courses_breakdown(tables, SINCE, ["jockey"], 1)) == want_all and want_all
    r = compare(spark, "jockey", lambda s, p: many.breakdown("jockey"), breakdown_sql(GRADED, dimension("jockey"), 1, binding=False), "", con)
    assert r["ok"], r
