"""Command line: the course-statistics run for one course or graded race.

    python -m paddock --tables /data/racing --place 3 --turf --length 1200 \\
        --going 良 --preset 4 [--grade-race 3歳未勝利] [--since ...] [--insert /data/analysis]

    python -m paddock --driver-sf /root/testdata/sf0.01 --place 3 --turf --length 1200 \\
        --going 良 --preset 7 --since "1996-01-01 09:50:00"

Prints the course card, the race and runner counts and the eleven
breakdown tables (one job computes all eleven), and with ``--insert``
appends the seven stored reports.
"""

from __future__ import annotations

import argparse
import sys

from paddock.plans.criteria import DAY_PRESET_NAMES, DAY_PRESETS, GOING_EN, Criteria
from paddock.plans.dimensions import DIMENSIONS


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="python -m paddock", description=__doc__.split("\n\n")[0])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder holding race/, result/, refund/, horse/, jockey/ (parquet)")
    src.add_argument("--driver-sf", help="driver TPC-H-like tables folder, bound to the race schema")
    p.add_argument("--format", default="parquet", help="format of --tables (default parquet)")
    p.add_argument("--place", type=int, required=True, help="racecourse id 1-10")
    surface = p.add_mutually_exclusive_group(required=True)
    surface.add_argument("--turf", action="store_true")
    surface.add_argument("--dirt", action="store_true")
    p.add_argument("--length", type=int, required=True, help="distance in metres")
    p.add_argument("--going", required=True, choices=list(GOING_EN), help="going")
    days = p.add_mutually_exclusive_group(required=True)
    days.add_argument("--preset", type=int, choices=sorted(DAY_PRESETS), help="meeting-day preset")
    days.add_argument("--days", type=int, nargs="+", help="meeting days")
    p.add_argument("--grade-race", help="analyse races whose name contains this text")
    p.add_argument("--since", help="cut-off timestamp (races strictly after it)")
    p.add_argument("--insert", help="append the seven stored reports to this folder")
    p.add_argument("--master", default=None, help="Spark master for a local run (default: session's)")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    args = parse(argv)
    from pyspark.sql import SparkSession

    from paddock.operators.breakdown import dimension_view
    from paddock.operators.report import display
    from paddock.plans.course import CourseAnalysis
    from paddock.session import apply_sql_settings
    from paddock.sources import bind_driver_tables, read_tables

    builder = SparkSession.builder.appName("paddock")
    if args.master:
        builder = builder.master(args.master).config("spark.ui.enabled", "false")
    spark = apply_sql_settings(builder.getOrCreate())

    tables = (read_tables(spark, args.tables, args.format) if args.tables
              else bind_driver_tables(spark, args.driver_sf))
    day_tuple = DAY_PRESETS[args.preset] if args.preset else tuple(args.days)
    c = Criteria(args.place, bool(args.turf), args.length, args.going, day_tuple,
                 grade_race=args.grade_race, since=args.since)
    a = CourseAnalysis(tables, c)

    if c.grade_race is not None:
        print(f"graded race: {c.grade_race}")
    else:
        label = DAY_PRESET_NAMES.get(args.preset, c.days_str) if args.preset else c.days_str
        print(f"course: {c.place} {c.race_type} {c.length}m {c.turf_cond} days {label}")
    s = a.summary().first()
    print(s["course"], end="")
    print(f"races: {s['target_race']}  runners: {s['target_horse']}")

    everything = a.breakdown_all().cache()
    try:
        for d in DIMENSIONS:
            print(f"\n{c.analysis_key(d.slug)}  {d.memo}")
            table = display(dimension_view(everything, d), d)
            table.show(max(1, table.count()), truncate=False)
        if args.insert:
            ok = a.insert(path=args.insert, breakdown=everything)
            print("inserted" if ok else "insert failed")
            return 0 if ok else 1
        return 0
    finally:
        everything.unpersist()


if __name__ == "__main__":
    sys.exit(main())
