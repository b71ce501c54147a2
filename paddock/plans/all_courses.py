"""Every course in one job.

The original answers one course per run.  Here every (racecourse, surface,
distance, going) and every meeting-day preset is answered by one plan:

1. runners of all races after the cut-off are summed per (course, meeting
   day, dimension, value) -- partial aggregation runs map-side, so the
   shuffle carries partial sums;
2. these day-level sums (at most 12 days per course) are rolled up into the
   seven presets, which overlap; every measure is a sum (and the side flags
   an OR), so this second aggregation is exact, and it copies a row per
   (course, day, value) to two or three presets, never a runner;
3. ranks are taken per (course, preset, dimension) over the aggregated rows.

A slice of the output for one course and preset equals the single-course
plan for the same criteria (tested).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.operators.breakdown import FLAGS, KEY_COLS, MEASURES, aggregate, breakdown_sums, finish, many_jockeys
from paddock.operators.joins import MAX_BROADCAST_ROWS, bounded_broadcast
from paddock.operators.report import payload_header_sql, payloads, report_memo_sql
from paddock.operators.sink import analysis_frame
from paddock.plans.course import MIN_JOCKEY_FINISHES, _dims
from paddock.plans.criteria import COURSE_SINCE, DAY_PRESETS, GOING_EN, SURFACE
from paddock.plans.dimensions import INSERTED
from paddock.sources.tables import PLACE_ROMAJI, RaceTables

COURSE_COLS = ("place_id", "race_type", "length", "turf_cond")
PRESET_COLS = COURSE_COLS + ("preset",)


def _literal_map(mapping: dict) -> Column:
    return F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])


def day_presets() -> Column:
    """Map meeting day -> array of the presets containing it."""
    days = sorted({d for ds in DAY_PRESETS.values() for d in ds})
    return _literal_map({d: F.array(*[F.lit(p) for p in sorted(DAY_PRESETS) if d in DAY_PRESETS[p]])
                         for d in days})


def all_courses_breakdown(tables: RaceTables, since: str = COURSE_SINCE, dims=None,
                          min_jockey_finishes: int = MIN_JOCKEY_FINISHES,
                          max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    dims = _dims(dims)
    carry = COURSE_COLS + ("days",)
    races = tables.race.where(F.col("date_and_time") > F.lit(since).cast("timestamp_ntz")).select(
        "race_id", *carry)
    races, small = bounded_broadcast(races, max_broadcast_rows)
    per_day = breakdown_sums(tables, races, dims, carry, small)
    per_preset = per_day.select(
        *COURSE_COLS, F.explode(F.try_element_at(day_presets(), F.col("days"))).alias("preset"),
        *KEY_COLS, *MEASURES, *FLAGS)
    return finish(aggregate(per_preset, (*PRESET_COLS, *KEY_COLS)), dims, PRESET_COLS, min_jockey_finishes,
                  many_jockeys(tables, dims))


def all_courses_reports(tables: RaceTables, since: str = COURSE_SINCE, dims=INSERTED,
                        min_jockey_finishes: int = MIN_JOCKEY_FINISHES,
                        max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Analysis rows for every course and preset with a race: one per
    dimension, as a single-course run stores them (an empty table when the
    dimension has no rows)."""
    dims = _dims(dims)
    # Only courses an analysis key can name: known place, surface and going.
    nameable = (F.col("place_id").isin(*PLACE_ROMAJI)
                & F.col("race_type").isin(*[s[0] for s in SURFACE.values()])
                & F.col("turf_cond").isin(*GOING_EN))
    everything = all_courses_breakdown(tables, since, dims, min_jockey_finishes, max_broadcast_rows).where(nameable)
    found = payloads(everything, dims, PRESET_COLS)
    # (course, preset) of every race after the cut-off, times the requested
    # dimensions: a bounded Generate over the distinct courses, no cross join.
    slugs = F.array(*[F.lit(d.slug) for d in dims])
    grid = (tables.race.where(F.col("date_and_time") > F.lit(since).cast("timestamp_ntz")).where(nameable)
            .select(*COURSE_COLS, F.explode(F.try_element_at(day_presets(), F.col("days"))).alias("preset"))
            .distinct()
            .select(*PRESET_COLS, F.explode(slugs).alias("dim")))
    empty = F.expr(f"""concat('{{"table_header":', {payload_header_sql(dims)}, ',"data":[]}}')""")
    place = F.element_at(_literal_map(PLACE_ROMAJI), F.col("place_id"))
    surface = F.element_at(_literal_map({ja: en for ja, en in SURFACE.values()}), F.col("race_type"))
    going = F.element_at(_literal_map(GOING_EN), F.col("turf_cond"))
    days = F.element_at(_literal_map({p: "-".join(map(str, ds)) for p, ds in DAY_PRESETS.items()}),
                        F.col("preset"))
    rows = grid.join(found, [*PRESET_COLS, "dim"], "left")
    return analysis_frame(rows.select(
        F.concat_ws("-", F.col("dim"), place, surface, F.col("length").cast("string"), going, days)
         .alias("analysis_key"),
        "place_id", "length", F.expr(report_memo_sql(dims)).alias("memo"), "turf_cond", "race_type",
        days.alias("days"), F.coalesce(F.col("data"), empty).alias("data")))
