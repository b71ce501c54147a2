"""Edge rows of FIXTURES.md section 2."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StructField, StructType

from fixture_tables import DAY, make_tables, race_row, result_row
from paddock import CourseAnalysis, Criteria
from paddock.functions.buckets import (
    HORSE_WEIGHT_LABELS,
    HORSE_WEIGHT_RULES,
    LAST_3F_LABELS,
    LAST_3F_RULES,
    LEG_TYPE_LABELS,
    LEG_TYPE_RULES,
    bucket_sql,
    label_sql,
)
from paddock.functions.text import percent_text_expr


def _buckets(spark, values, rules, dtype):
    df = spark.createDataFrame([(v,) for v in values], StructType([StructField("v", dtype)]))
    return [r.b for r in df.select(F.expr(bucket_sql("v", rules)).alias("b")).collect()]


def test_leg_type_buckets(spark):
    got = _buckets(spark, [0, 1, 2, 6, 7, 14, 15, None], LEG_TYPE_RULES, IntegerType())
    assert got == [None, 1, 2, 2, 3, 3, 4, None]


def test_horse_weight_buckets(spark):
    got = _buckets(spark, [419, 420, 439, 440, 519, 520, None], HORSE_WEIGHT_RULES, IntegerType())
    assert got == [1, 2, 2, 3, 6, 7, None]


def test_last_3f_buckets(spark):
    vals = [Decimal(x) if x else None for x in ("31.4", "31.5", "31.9", "32.0", "32.4", "35.9", "36.0", None)]
    got = _buckets(spark, vals, LAST_3F_RULES, DecimalType(4, 1))
    assert got == [None, 1, 1, 2, 2, 9, 10, None]


def test_labels(spark):
    df = spark.createDataFrame([(1,), (3,), (10,), (11,), (None,)], "b int")

    def labels(texts):
        return [r.t for r in df.select(F.expr(label_sql("b", texts)).alias("t")).collect()]

    assert labels(LEG_TYPE_LABELS) == ["逃げ", "差し", None, None, None]
    assert labels(HORSE_WEIGHT_LABELS) == ["~ 419kg", "440kg ~459kg", None, None, None]
    assert labels(LAST_3F_LABELS) == ["31.5 ~ 31.9", "32.5 ~ 32.9", "36.0 ~", None, None]


def test_last_3f_gap_values_are_null(spark):
    # a finer-grained time between two buckets matches no rule
    got = _buckets(spark, [Decimal("31.95"), Decimal("32.45")], LAST_3F_RULES, DecimalType(5, 2))
    assert got == [None, None]


@pytest.mark.parametrize("num,den,scale,text", [
    (1, 80, 1000, "1.3%"),        # 1.25 % rounds half up
    (1, 8, 1000, "12.5%"),
    (1, 3, 1000, "33.3%"),
    (2, 3, 1000, "66.7%"),
    (0, 5, 1000, "0.0%"),
    (3, 0, 1000, None),           # no counted finishers
    (24692, 20, 10, "1,234.6%"),  # thousands separator
    (1900, 19, 10, "100.0%"),
    (None, 4, 10, None),          # no payouts
])
def test_percent_text(spark, num, den, scale, text):
    schema = StructType([StructField("n", LongType()), StructField("d", LongType())])
    df = spark.createDataFrame([(num, den)], schema)
    assert df.select(percent_text_expr("n", "d", scale).alias("t")).first()["t"] == text


CUTOFF = dt.datetime(2010, 1, 1, 9, 50, 0)


@pytest.fixture(scope="module")
def edge_analysis(spark):
    races = [race_row(r) for r in range(1, 21)] + [race_row(21, when=CUTOFF)]
    results, refunds = [], []
    for r in range(1, 21):
        if r <= 19:  # jockey B (id 3): 19 wins, each paying exactly 100
            results.append(result_row(r, 1, 1, frame_no=1, horse_id=1, jockey_id=3, popularity_order=1))
            refunds.append((r, 1, 1, 100))
            if r == 1:
                refunds.append((r, 1, 3, 1000))  # ticket type 3: ignored
        # jockey C (id 4): 20 second places; place payouts summing to 24692
        results.append(result_row(r, 2, 2, frame_no=2, horse_id=1, jockey_id=4, popularity_order=2))
        refunds.append((r, 2, 2, 1246 if r == 20 else 1234))
        if r <= 12:  # namesakes: jockeys 1 and 2 are both "A"
            results.append(result_row(r, 3, 3, frame_no=3, horse_id=1, jockey_id=1, popularity_order=3))
            results.append(result_row(r, 4, 4, frame_no=4, horse_id=1, jockey_id=2, popularity_order=4))
        # unknown jockey; unknown horse: counted everywhere but the jockey breakdown
        results.append(result_row(r, 5, 5, frame_no=5, horse_id=1, jockey_id=99, popularity_order=5))
        results.append(result_row(r, 6, 6, frame_no=6, horse_id=999, jockey_id=4, popularity_order=6))
        # a non-finisher alone in frame 7
        results.append(result_row(r, 7, None, frame_no=7, horse_id=1, jockey_id=4, popularity_order=7))
    results.append(result_row(21, 1, 1, frame_no=1, horse_id=1, jockey_id=3, popularity_order=1))
    jockeys = [(1, "A"), (2, "A"), (3, "B"), (4, "C")]
    tables = make_tables(spark, races, results, refunds, horses=[1], jockeys=jockeys)
    return CourseAnalysis(tables, Criteria(3, True, 1200, "良", (1,)))


def test_cutoff_is_strict(edge_analysis):
    assert edge_analysis.count_race().first()["target_race"] == 20


def test_jockeys_rank_then_filter(edge_analysis):
    got = [(r.dim_key, r.record, r.win_rate_ranking, r.rentai_rate_ranking, r.fukusho_rate_ranking,
            r.total_count) for r in edge_analysis.breakdown("jockey").collect()]
    # B (19 finishes, all wins) ranks first and is then dropped; A merges two ids
    assert got == [("A", "0-0-12-12/24", 2, 3, 3, 24), ("C", "0-20-0-0/20", 2, 1, 1, 20)]


def test_non_finisher_group_and_recovery_flags(edge_analysis):
    by_frame = {r.dim_key: r for r in edge_analysis.breakdown("frame_no").collect()}
    f7 = by_frame[7]
    assert (f7.record, f7.win_rate_pct, f7.rentai_rate_pct, f7.fukusho_rate_pct) == ("0-0-0-0/0", None, None, None)
    assert f7.win_rate_ranking == max(r.win_rate_ranking for r in by_frame.values())
    f1, f2 = by_frame[1], by_frame[2]
    assert (f1.win_recovery_rate, f1.win_recovery_100_over) == ("100.0%", 1)
    assert (f1.d_win_recovery_rate, f1.d_win_recovery_100_over) == (None, 0)
    assert f2.d_win_recovery_rate == "1,234.6%"


def test_breakdown_counts_rows_without_horse_or_jockey(edge_analysis):
    by_frame = {r.dim_key: r.record for r in edge_analysis.breakdown("frame_no").collect()}
    assert by_frame[5] == "0-0-0-20/20" and by_frame[6] == "0-0-0-20/20"
