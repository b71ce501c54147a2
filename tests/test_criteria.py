"""Criteria: analysis keys, presets, validation, filters."""

import pytest

from fixture_tables import DAY, make_tables, race_row
from paddock import DAY_PRESETS, CourseAnalysis, Criteria


def test_analysis_key_and_presets():
    c = Criteria.preset(9, False, 1800, "稍重", 4)
    assert c.days == (7, 8)
    assert c.analysis_key("jockey") == "jockey-hanshin-dirt-1800-litle_bad-7-8"
    assert Criteria(1, True, 1000, "重", (3,)).analysis_key("x") == "x-sapporo-turf-1000-bad-3"
    assert DAY_PRESETS[6] == tuple(range(5, 13))


def test_validation():
    with pytest.raises(ValueError):
        Criteria(3, True, 1200, "不良", (1,))   # unknown going
    with pytest.raises(ValueError):
        Criteria(11, True, 1200, "良", (1,))    # unknown racecourse
    with pytest.raises(ValueError):
        Criteria(3, True, 1200, "良", ())       # no meeting day


def test_filters(spark):
    import datetime as dt

    races = [
        race_row(1, days=1),                                  # selected
        race_row(2, days=2),                                  # other day
        race_row(3, days=1, race_type="ダ"),                   # other surface
        race_row(4, days=1, when=dt.datetime(2010, 1, 1, 9, 50)),  # at the cut-off: excluded
        race_row(5, days=1, name="x3歳未勝利x", place_id=9, when=dt.datetime(2012, 5, 1)),
        race_row(6, days=1, terms="ハンデ", when=dt.datetime(2015, 7, 2)),
    ]
    t = make_tables(spark, races, [], [])
    ids = lambda c: sorted(r.race_id for r in CourseAnalysis(t, c).races().collect())
    assert ids(Criteria(3, True, 1200, "良", (1,))) == [1, 6]
    assert ids(Criteria(3, True, 1200, "良", (1,), months=(7,))) == [6]
    assert ids(Criteria(3, True, 1200, "良", (1,), terms="ハンデ")) == [6]
    # graded mode ignores the course fields and uses its own cut-off
    assert ids(Criteria(3, True, 1200, "良", (1,), grade_race="3歳未勝利")) == [5]
    assert ids(Criteria(3, True, 1200, "良", (1,), grade_race="3歳未勝利", since="2013-01-01 00:00:00")) == []
    assert DAY.year == 2015
