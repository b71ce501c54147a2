"""The all-courses plan sliced to one course equals the single-course plan."""

import pytest
from pyspark.sql import functions as F

from paddock import DAY_PRESETS, DIMENSIONS, CourseAnalysis, Criteria
from paddock.operators.breakdown import METRIC_COLUMNS
from paddock.plans.all_courses import all_courses_breakdown
from paddock.plans.check_criteria import CHECK_SINCE
from paddock.sources import bind_driver_tables

COLS = ["dim", "dim_key", "dim_value", *METRIC_COLUMNS, "total_count"]


@pytest.fixture(scope="module")
def bound(spark, sf_check):
    tables = bind_driver_tables(spark, sf_check)
    everything = all_courses_breakdown(tables, CHECK_SINCE).cache()
    yield tables, everything
    everything.unpersist()


@pytest.mark.parametrize("place,turf,length,going,preset", [
    (3, True, 1200, "良", 7),
    (5, False, 1800, "重", 4),
    (9, True, 1600, "稍重", 6),
])
def test_slice_equals_single_course(bound, place, turf, length, going, preset):
    tables, everything = bound
    c = Criteria.preset(place, turf, length, going, preset, since=CHECK_SINCE)
    single = CourseAnalysis(tables, c).breakdown_all()
    part = everything.where(
        (F.col("place_id") == place) & (F.col("race_type") == c.race_type) & (F.col("length") == length)
        & (F.col("turf_cond") == going) & (F.col("preset") == preset))
    a = sorted(tuple(r) for r in single.select(*COLS).collect())
    b = sorted(tuple(r) for r in part.select(*COLS).collect())
    assert a == b
    assert {r[0] for r in a} >= {d.slug for d in DIMENSIONS if d.name != "jockey"}


def test_shuffle_partitions_do_not_change_results(spark, sf_small):
    tables = bind_driver_tables(spark, sf_small)
    c = Criteria.preset(3, True, 1200, "良", 7, since=CHECK_SINCE)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        one = sorted(tuple(r) for r in CourseAnalysis(tables, c).breakdown_all().collect())
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        many = sorted(tuple(r) for r in CourseAnalysis(tables, c).breakdown_all().collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert one == many


def test_properties(bound):
    """no1+..+no4 = total; win <= top-2 <= top-3 rates; ranks start at 1 (not jockeys)."""
    _, everything = bound
    rows = everything.where(F.col("dim") != "jockey").collect()
    for r in rows:
        counts = [int(x) for x in r.record.replace("/", "-").split("-")]
        assert sum(counts[:4]) == counts[4] == r.total_count
        if r.win_rate_pct is not None:
            rates = [float(x.rstrip("%").replace(",", "")) for x in
                     (r.win_rate_pct, r.rentai_rate_pct, r.fukusho_rate_pct)]
            assert rates[0] <= rates[1] <= rates[2]
    firsts = (everything.where(F.col("dim") != "jockey")
              .groupBy("place_id", "race_type", "length", "turf_cond", "preset", "dim")
              .agg(F.min("win_rate_ranking").alias("m")).where("m != 1").count())
    assert firsts == 0
