"""Physical-plan properties that matter at scale.

The plans are checked on real-table parquet (the bound sf0.001 tables
written out), with automatic broadcasts off and the explicit broadcast
bounds set to 0 -- the shape they take when every table is large.
"""

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fixture_tables import random_tables as random_race_tables
from fixture_tables import write_tables as write_fixture_tables
from paddock import CourseAnalysis, Criteria
from paddock.plans.all_courses import all_courses_breakdown
from paddock.plans.check_criteria import CHECK_COURSE, CHECK_SINCE
from paddock.sources import bind_driver_tables, read_tables, write_tables


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def real_tables(spark, sf_small, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("real"))
    write_tables(bind_driver_tables(spark, sf_small), root)
    return read_tables(spark, root)


@pytest.fixture()
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def test_real_tables_give_the_binding_results(spark, sf_small, real_tables):
    bound = bind_driver_tables(spark, sf_small)
    a = sorted(map(tuple, CourseAnalysis(real_tables, CHECK_COURSE).breakdown_all().collect()))
    b = sorted(map(tuple, CourseAnalysis(bound, CHECK_COURSE).breakdown_all().collect()))
    assert a == b and a


def final_plan(df) -> list[str]:
    df.collect()
    return plan_text(df).split("== Initial Plan ==")[0].splitlines()


def scans_of(lines, table):
    return [line for line in lines if "FileScan parquet" in line and line.split("Location:")[1].split("]")[0].endswith(f"/{table}")]


def test_all_courses_plan_shape(real_tables, no_broadcast):
    df = all_courses_breakdown(real_tables, CHECK_SINCE, max_broadcast_rows=0)
    lines = final_plan(df)
    # Three plans (in-race rank, jockey, keyed) over the same runners: each table is read and shuffled once.
    for name in ("result", "refund", "race"):
        assert len(scans_of(lines, name)) == 1, name
    assert len([line for line in lines if "ReusedExchange" in line and "race_id" in line]) >= 6
    # The payout join on (race_id, horse_no) reuses the race join's partitioning.
    assert not any(re.search(r"hashpartitioning\(race_id#\d+L, horse_no", line) for line in lines)
    # Rank rows: no shuffle between the race join and the window; only they pass it.
    windows = [i for i, line in enumerate(lines) if re.search(r"Window \[.*sum.*race_id", line)]
    assert len(windows) == 1
    below = next(line for line in lines[windows[0]:] if "Exchange" in line or "ShuffleQueryStage" in line)
    assert "ShuffleQueryStage" in below or re.search(r"hashpartitioning\(race_id#\d+L, \d+\)", below)
    # Presets are exploded above the day-level sums.
    explode = next(i for i, line in enumerate(lines) if "Generate explode(element_at(map" in line)
    assert "HashAggregate" not in lines[explode + 1] and any("HashAggregate" in line for line in lines[explode:explode + 6])
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert not any(bad in line for line in lines)


def test_rank_rows_are_sorted_by_race_first(real_tables, no_broadcast):
    plan = plan_text(all_courses_breakdown(real_tables, CHECK_SINCE, ["seconds_3f_rank"], max_broadcast_rows=0))
    window = plan[re.search(r"Window \[.*sum.*race_id", plan).start():]
    assert re.search(r"Sort \[(\w+)#", window)[1] == "race_id"


def test_one_course_reads_its_runners_once(real_tables):
    lines = final_plan(CourseAnalysis(real_tables, CHECK_COURSE).breakdown_all())
    assert sum("ReusedExchange" in line for line in lines) >= 2
    assert len(scans_of(lines, "result")) <= 3


def test_one_dimension_has_one_sum(real_tables, no_broadcast):
    """Scan and payout sums aside, a keyed dimension is summed once, over its key alone."""
    plan = plan_text(CourseAnalysis(real_tables, CHECK_COURSE, max_broadcast_rows=0).breakdown_all(["popularity_order"]))
    by_key = re.findall(r"Exchange hashpartitioning\(([^)]*dim_key[^)]*)\)", plan)
    assert len(by_key) == 1 and "race" not in by_key[0]


def test_rank_in_race_is_one_lazy_plan(spark, real_tables, tmp_path):
    """No job runs while the plan is built; values are counted from two columns, no window holds a race's runners."""
    from paddock.operators.race_rank import in_race_rank

    runners = real_tables.result.select("race_id", "horse_no", "seq", "seconds_3f")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    df = in_race_rank(runners, "seconds_3f", "r")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    lines = plan_text(df).splitlines()
    scans = scans_of(lines, "result")
    assert len(scans) == 2 and sum("horse_no" in s for s in scans) == 1
    window = next(i for i, line in enumerate(lines) if "Window [" in line)
    assert any("HashAggregate(keys=[race_id" in line for line in lines[window:window + 4])
    plain = runners.selectExpr("*", "CAST(rank() OVER (PARTITION BY race_id ORDER BY seconds_3f ASC NULLS FIRST) AS INT) AS r")
    assert sorted(map(str, df.collect())) == sorted(map(str, plain.collect()))


def test_hot_race_is_ranked_in_pieces(spark, no_broadcast):
    """A race of most runners: the join back is split, ranks stay."""
    from paddock.operators.race_rank import in_race_rank

    runners = spark.range(0, 60_000, 1, 8).selectExpr(
        "CAST(CASE WHEN id % 3 > 0 THEN 1 ELSE id END AS BIGINT) AS race_id", "id AS seq",
        "CASE WHEN id % 5 > 1 THEN NULL ELSE CAST(30 + id % 90 / 10 AS DECIMAL(4,1)) END AS seconds_3f")
    want = sorted(map(str, runners.selectExpr("*", "CAST(rank() OVER (PARTITION BY race_id ORDER BY seconds_3f ASC NULLS FIRST) AS INT) AS r").collect()))
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = in_race_rank(runners, "seconds_3f", "r")
        assert sorted(map(str, df.collect())) == want
        assert "skew=true" in plan_text(df).split("== Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_counted_runners_are_dealt_in_bounded_parts(spark, no_broadcast):
    """Counting and ranking run in parts whose rows are bounded, not in the few that AQE coalesces to."""
    from paddock.operators.race_rank import dealt_runners, in_race_rank

    result = spark.range(0, 12_000, 1, 4).selectExpr(
        "CASE WHEN id % 500 = 0 THEN NULL ELSE id DIV 8 END AS race_id", "id AS seq",
        "CASE WHEN id % 5 = 1 THEN NULL ELSE CAST(30 + id % 7 / 10 AS DECIMAL(4,1)) END AS seconds_3f")
    races = spark.range(0, 1400).union(spark.range(0, 20)).selectExpr("id AS race_id")
    assert dealt_runners(result, races, "seconds_3f") is None
    runners = result.join(races, "race_id")
    dealt = dealt_runners(result, races, "seconds_3f", part_rows=500)
    parts = [n for (n,) in dealt.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(parts) == 24 and max(parts) < 1000
    ranked = in_race_rank(runners, "seconds_3f", "r", dealt)
    plain = runners.selectExpr("*", "CAST(rank() OVER (PARTITION BY race_id ORDER BY seconds_3f ASC NULLS FIRST) AS INT) AS r")
    assert sorted(map(str, ranked.collect())) == sorted(map(str, plain.select(ranked.columns).collect()))


def test_hot_race_join_is_split(spark, tmp_path_factory, no_broadcast):
    """One race with about 40 % of the runners: AQE splits the race join, values stay."""
    root = str(tmp_path_factory.mktemp("hot"))
    write_fixture_tables(random_race_tables(spark, 7, n_races=800, hot_runners=3000), root)
    # A partition is split between the tasks that wrote it, so the runners come from several.
    spark.read.parquet(f"{root}/result").repartition(8).write.parquet(f"{root}/spread/result")
    tables = replace(read_tables(spark, root), result=spark.read.parquet(f"{root}/spread/result"))
    graded = Criteria(3, True, 1200, "良", (1,), grade_race="", since="2000-01-01 00:00:00")

    def run():
        df = CourseAnalysis(tables, graded, max_broadcast_rows=0).breakdown_all(["frame_no", "seconds_3f_rank"])
        rows = sorted(map(str, df.collect()))
        return rows, plan_text(df).split("== Initial Plan ==")[0]

    want, plain = run()
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got, plan = run()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and "skew=true" in plan and "skew=true" not in plain


def test_dimension_generate_is_codegen(real_tables):
    df = CourseAnalysis(real_tables, CHECK_COURSE).breakdown_all()
    df.collect()  # AQE applies whole-stage codegen per stage; read the final plan
    plan = plan_text(df).split("== Initial Plan ==")[0]
    generates = [line for line in plan.splitlines() if "Generate inline(" in line]
    assert generates and all(re.search(r"\*\(\d+\) Generate", g) for g in generates), generates


def test_course_filter_reaches_the_scan(real_tables):
    plan = CourseAnalysis(real_tables, CHECK_COURSE).races()._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    for col in ("place_id", "length", "race_type", "turf_cond", "date_and_time"):
        assert re.search(rf"PushedFilters: \[.*{col}", scan), scan
