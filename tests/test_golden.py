"""Golden micro-fixture (FIXTURES.md section 3), worked out by hand."""

import pytest

from fixture_tables import golden
from paddock import CourseAnalysis, Criteria

COLS = ("dim_key", "record", "win_rate_pct", "rentai_rate_pct", "fukusho_rate_pct",
        "win_rate_ranking", "rentai_rate_ranking", "fukusho_rate_ranking",
        "win_recovery_rate", "d_win_recovery_rate", "win_recovery_100_over", "d_win_recovery_100_over")


@pytest.fixture(scope="module")
def analysis(spark):
    return CourseAnalysis(golden(spark), Criteria(3, True, 1200, "良", (1, 2)))


def rows(df):
    return [tuple(r[c] for c in COLS) for r in df.collect()]


def test_by_frame_no(analysis):
    assert rows(analysis.breakdown("frame_no")) == [
        (1, "1-1-0-1/3", "33.3%", "66.7%", "66.7%", 2, 2, 3, "83.3%", "90.0%", 0, 0),
        (2, "1-0-1-0/2", "50.0%", "50.0%", "100.0%", 1, 3, 1, "160.0%", "160.0%", 1, 1),
        (3, "0-1-0-0/1", "0.0%", "100.0%", "100.0%", 3, 1, 1, None, "130.0%", 0, 1),
    ]


def test_by_seconds_3f_rank(analysis):
    # race 1: NULL time ranks 1, the 33.9 pair 2, 34.0 ranks 4; race 2: 34.2 pair 1, 35.0 ranks 3
    assert rows(analysis.breakdown("seconds_3f_rank")) == [
        (1, "1-1-0-0/2", "50.0%", "100.0%", "100.0%", 2, 1, 1, "160.0%", "103.3%", 1, 1),
        (2, "0-1-1-0/2", "0.0%", "50.0%", "100.0%", 3, 3, 1, None, "225.0%", 0, 1),
        (3, "0-0-0-1/1", "0.0%", "0.0%", "0.0%", 3, 4, 4, None, None, 0, 0),
        (4, "1-0-0-0/1", "100.0%", "100.0%", "100.0%", 1, 1, 1, "250.0%", "120.0%", 1, 1),
    ]


def test_counts(analysis):
    assert analysis.count_race().first()["target_race"] == 2
    assert analysis.count_horse().first()["target_race"] == 7
    s = analysis.summary().first()
    assert (s["course"], s["target_race"], s["target_horse"]) == ("", 2, 7)


def test_in_race_rank_operator(spark, analysis):
    from paddock.operators.race_rank import in_race_rank

    runners = analysis.tables.result.select("race_id", "horse_no", "seconds_3f")
    got = {(r.race_id, r.horse_no): r.r for r in in_race_rank(runners, "seconds_3f", "r").collect()}
    assert got == {(1, 4): 1, (1, 2): 2, (1, 3): 2, (1, 1): 4, (2, 2): 1, (2, 3): 1, (2, 1): 3}


def test_highlight_and_payload(analysis):
    import json

    cells = analysis.highlight("frame_no").collect()
    first = cells[0].asDict(recursive=True)
    assert first["枠番"] == {"value": 1, "schema": None}
    assert first["勝率"] == {"value": "33.3%", "schema": "blue"}
    assert first["複勝率"] == {"value": "66.7%", "schema": "red"}
    assert first["単回値"] == {"value": "83.3%", "schema": None}
    assert "win_rate_ranking" not in first
    payload = json.loads(analysis.payload("frame_no").first()["data"])
    assert payload["table_header"] == ["枠番", "着度数", "勝率", "連対率", "複勝率", "単回値", "複回値"]
    assert [r["枠番"]["value"] for r in payload["data"]] == [1, 2, 3]
    assert payload["data"][1]["単回値"] == {"value": "160.0%", "schema": "yellow"}
    assert payload["data"][2]["単回値"] == {"value": None, "schema": None}


def test_display_columns(analysis):
    d = analysis.display("frame_no")
    assert d.columns == ["枠番", "着度数", "勝率", "連対率", "複勝率", "単回値", "複回値"]
