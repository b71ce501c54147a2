"""Report rows: keys, payload JSON and the append sink."""

import json

from paddock import CourseAnalysis
from paddock.plans.check_criteria import CHECK_COURSE, CHECK_GRADED
from paddock.plans.dimensions import INSERTED, dimension
from paddock.schemas import ANALYSIS
from paddock.sources import bind_driver_tables


def test_reports_and_append(spark, sf_small, tmp_path):
    a = CourseAnalysis(bind_driver_tables(spark, sf_small), CHECK_COURSE)
    reports = a.reports()
    assert [(f.name, f.dataType) for f in reports.schema] == [(f.name, f.dataType) for f in ANALYSIS]
    rows = reports.collect()
    assert [r.analysis_key for r in rows] == [
        f"{dimension(n).slug}-fukushima-turf-1200-good-1-2-3-4-5-6-7-8-9-10-11-12" for n in INSERTED]
    for r in rows:
        body = json.loads(r.data)
        assert body["table_header"][1:] == ["着度数", "勝率", "連対率", "複勝率", "単回値", "複回値"]
        assert (r.place_id, r.length, r.turf_cond, r.race_type) == (3, 1200, "良", "芝")
    path = str(tmp_path / "analysis")
    assert a.insert(path=path)
    assert a.insert(path=path)  # append: a second run adds rows
    back = spark.read.parquet(path)
    assert back.count() == 2 * len(INSERTED)


def test_graded_key_keeps_course_fields(spark, sf_small):
    a = CourseAnalysis(bind_driver_tables(spark, sf_small), CHECK_GRADED)
    keys = [r.analysis_key for r in a.reports(["frame_no"]).collect()]
    assert keys == ["wakuban-fukushima-turf-1200-good-1-2-3-4-5-6-7-8-9-10-11-12"]


def test_write_failure_returns_false(spark, sf_small, tmp_path):
    a = CourseAnalysis(bind_driver_tables(spark, sf_small), CHECK_COURSE)
    path = str(tmp_path / "taken")
    assert a.insert(path=path, dims=["frame_no"])
    from paddock.operators.sink import write_analysis

    assert write_analysis(a.reports(["frame_no"]), path=path, mode="errorifexists") is False
