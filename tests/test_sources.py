"""Readers: column names, exact decimals, the racecourse fallback; the sink."""

import datetime as dt
from dataclasses import replace
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType

from fixture_tables import DAY, golden, race_row, write_tables
from paddock import CourseAnalysis, Criteria
from paddock.operators.sink import write_analysis
from paddock.sources.tables import exact, read_tables

C = Criteria(3, True, 1200, "良", (1, 2))


@pytest.fixture()
def root(spark, tmp_path):
    path = str(tmp_path / "t")
    write_tables(golden(spark), path)
    return path


def test_fourth_corner_by_either_name(spark, root, tmp_path):
    import shutil

    result = spark.read.parquet(f"{root}/result").withColumn("corner4", F.col("horse_no"))
    want = None
    for name in ("corner4", "4c", "other"):
        other = str(tmp_path / name)
        shutil.copytree(root, other, ignore=shutil.ignore_patterns("result"))
        result.withColumnRenamed("corner4", name).write.parquet(f"{other}/result")
        if name == "other":
            with pytest.raises(ValueError, match="4c"):
                read_tables(spark, other)
            continue
        got = list(map(tuple, CourseAnalysis(read_tables(spark, other), C).breakdown("leg_type").collect()))
        want = want or got
        assert got == want and len(got) > 1


def test_decimals_that_do_not_fit_raise(spark):
    df = spark.createDataFrame([(Decimal("32.40"), 32.4), (None, None)], "a decimal(5,2), b double")
    assert [tuple(r) for r in df.select(exact("a", DecimalType(4, 1)), exact("b", DecimalType(4, 1))).collect()] == [
        (Decimal("32.4"), Decimal("32.4")), (None, None)]
    bad = spark.createDataFrame([(Decimal("32.45"),)], "a decimal(5,2)")
    with pytest.raises(Exception, match="does not fit"):
        bad.select(exact("a", DecimalType(4, 1))).collect()
    assert bad.select(exact("a", DoubleType())).first()[0] == 32.45


def test_racecourses_fall_back_only_when_missing(spark, root):
    import os
    import shutil

    if os.path.isdir(f"{root}/master_place"):
        shutil.rmtree(f"{root}/master_place")
    assert read_tables(spark, root).master_place.count() == 10
    with pytest.raises(Exception, match="(?i)data source|no_such"):
        read_tables(spark, root, fmt="no_such_format")


def test_sink_raises_what_is_no_write_error(spark, tmp_path):
    reports = CourseAnalysis(golden(spark), C).reports(["frame_no"])
    broken = reports.withColumn("data", F.raise_error(F.lit("cannot compute")))
    with pytest.raises(Exception, match="cannot compute"):
        write_analysis(broken, path=str(tmp_path / "x"))
    assert write_analysis(reports, path=str(tmp_path / "y")) is True


def test_card_and_summary_of_a_course(spark):
    a = CourseAnalysis(golden(spark), C)
    card = a.course_card().collect()
    assert [r["course"] for r in card] == [""] and card[0]["place_name"] is None
    assert tuple(a.summary().first()) == ("", 2, 7)
    assert a.course_card().columns == CourseAnalysis(golden(spark), Criteria(3, True, 1200, "良", (1,), grade_race="R")).course_card().columns


def test_reports_from_a_breakdown_at_hand(spark):
    a = CourseAnalysis(golden(spark), C)
    everything = a.breakdown_all()
    assert sorted(map(str, a.reports(breakdown=everything).collect())) == sorted(map(str, a.reports().collect()))


def graded(tables, name="R"):
    return CourseAnalysis(tables, Criteria(3, True, 1200, "良", (1,), grade_race=name))


def cards(a):
    """The card by ``course_card`` ('' where there is none) and by ``summary``; one row each."""
    card, summary = [r["course"] for r in a.course_card().collect()], a.summary().collect()
    assert len(card) <= 1 and len(summary) == 1
    return (card or [""])[0], summary[0]["course"]


def test_summary_of_a_name_without_a_race(spark):
    a = graded(golden(spark), "no such name")
    assert a.course_card().collect() == []
    assert tuple(a.summary().first()) == ("", 0, 0)


def test_summary_card_is_the_latest_race_with_a_racecourse(spark):
    t = golden(spark)
    later = spark.createDataFrame([race_row(9, place_id=77, when=DAY + dt.timedelta(days=9)), race_row(8, place_id=5, length=1600, when=DAY + dt.timedelta(days=2)),
                                   race_row(7, place_id=None, when=DAY + dt.timedelta(days=20))], t.race.schema)
    a = graded(replace(t, race=t.race.unionByName(later)))
    card, summary = cards(a)
    assert card == summary and "東京" in card and "1600" in card
    assert a.summary().first()["target_race"] == 5           # the races without a racecourse row count


def test_summary_with_repeated_racecourse_and_race_ids(spark):
    t = golden(spark)
    places = t.master_place.unionByName(t.master_place).unionByName(spark.createDataFrame([(3, "zz"), (None, "none"), (3, None)], t.master_place.schema))
    a = graded(replace(t, master_place=places, race=t.race.unionByName(t.race)))
    card, summary = cards(a)
    assert card == summary and "福島" in card
    assert tuple(a.summary().first())[1:] == (4, 14)


def test_card_of_empty_tables(spark):
    t = golden(spark)
    for a in (graded(replace(t, master_place=t.master_place.limit(0))), graded(replace(t, race=t.race.limit(0)))):
        assert cards(a) == ("", "")
