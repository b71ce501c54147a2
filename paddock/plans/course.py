"""Course analysis: the breakdowns, counts and reports of one selection.

``CourseAnalysis(tables, criteria)`` plays the role of the original
``Analysis`` object: each method returns a lazy DataFrame.  The selected
races are measured once; when they are few (always, for one course) their
ids are broadcast, so the result and payout scans are filtered map-side
and nothing big is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.text import percent_text_expr
from paddock.operators.breakdown import breakdown_sums, dimension_view, finish, many_jockeys
from paddock.operators.fact import race_runners
from paddock.operators.joins import MAX_BROADCAST_ROWS, bounded_broadcast
from paddock.operators.report import (
    display,
    highlight_cells,
    highlight_colours,
    payload_header_sql,
    payloads,
    report_memo_sql,
)
from paddock.operators.sink import analysis_frame, write_analysis
from paddock.plans.criteria import Criteria
from paddock.plans.dimensions import DIMENSIONS, INSERTED, Dimension, dimension
from paddock.sources.tables import RaceTables

MIN_JOCKEY_FINISHES = 20
CARD_COLUMNS = ("length", "race_type", "circling", "terms")


def _dims(dims) -> list[Dimension]:
    if dims is None:
        return list(DIMENSIONS)
    return [d if isinstance(d, Dimension) else dimension(d) for d in dims]


class CourseAnalysis:
    def __init__(self, tables: RaceTables, criteria: Criteria,
                 max_broadcast_rows: int = MAX_BROADCAST_ROWS,
                 min_jockey_finishes: int = MIN_JOCKEY_FINISHES):
        self.tables = tables
        self.criteria = criteria
        self.max_broadcast_rows = max_broadcast_rows
        self.min_jockey_finishes = min_jockey_finishes
        self._selected: tuple[DataFrame, bool] | None = None

    # -- selection ----------------------------------------------------------
    def races(self) -> DataFrame:
        """The selected races (course filter or graded-race filter)."""
        return self.criteria.races(self.tables.race)

    def selected_ids(self) -> tuple[DataFrame, bool]:
        """Selected race ids, broadcast when their count is within bounds."""
        if self._selected is None:
            self._selected = bounded_broadcast(self.races().select("race_id"), self.max_broadcast_rows)
        return self._selected

    def _runners(self) -> DataFrame:
        return race_runners(self.tables, *self.selected_ids())

    def _sums(self, dims: list[Dimension]) -> DataFrame:
        ids, small = self.selected_ids()
        return breakdown_sums(self.tables, ids, dims, (), small)

    # -- counts -------------------------------------------------------------
    def count_race(self) -> DataFrame:
        return self.races().agg(F.count(F.lit(1)).alias("target_race"))

    def count_horse(self) -> DataFrame:
        return self._runners().agg(F.count(F.lit(1)).alias("target_race"))

    # -- breakdowns ---------------------------------------------------------
    def breakdown_all(self, dims=None) -> DataFrame:
        """All requested dimensions in one job, keyed by ``dim`` (slug)."""
        dims = _dims(dims)
        return finish(self._sums(dims), dims, (), self.min_jockey_finishes, many_jockeys(self.tables, dims))

    def side_totals(self, dim) -> DataFrame:
        """Per dimension value, before the NULL-key and three-side rules:
        finish counts, payout-side rows and money (native key type)."""
        d = dim if isinstance(dim, Dimension) else dimension(dim)
        return self._sums([d]).withColumn("dim_key", F.col("dim_key").cast(d.key_type))

    def arrival_counts(self, dim) -> DataFrame:
        """Finish counts per value (NULL value included)."""
        return self.side_totals(dim).select(
            "dim_key", "no1", "no2", "no3", "no4",
            (F.col("no1") + F.col("no2") + F.col("no3") + F.col("no4")).alias("total_count"))

    def recovery(self, dim, side: str = "win") -> DataFrame:
        """Payout recovery per value (NULL value included); side 'win' or 'place'."""
        rows, money, name = (("w_rows", "w_money", "win_recovery") if side == "win"
                             else ("p_rows", "p_money", "d_win_recovery"))
        return self.side_totals(dim).select(
            "dim_key", F.col(rows).alias("runners"), F.col(money).alias("payout"),
            percent_text_expr(money, rows, 10).alias(f"{name}_rate"),
            F.when(F.col(money) >= F.col(rows) * 100, F.lit(1)).otherwise(F.lit(0))
             .alias(f"{name}_100_over"))

    def breakdown(self, dim, ordered: bool = True) -> DataFrame:
        d = dim if isinstance(dim, Dimension) else dimension(dim)
        return dimension_view(self.breakdown_all([d]), d, ordered=ordered)

    def display(self, dim) -> DataFrame:
        d = dim if isinstance(dim, Dimension) else dimension(dim)
        return display(self.breakdown(d), d)

    def highlight(self, dim) -> DataFrame:
        d = dim if isinstance(dim, Dimension) else dimension(dim)
        return highlight_cells(self.breakdown(d), d)

    def highlight_colours(self, dim) -> DataFrame:
        d = dim if isinstance(dim, Dimension) else dimension(dim)
        return highlight_colours(self.breakdown(d, ordered=False), d)

    # -- reports ------------------------------------------------------------
    def payload(self, dim) -> DataFrame:
        """One row: the JSON report payload of one dimension."""
        return self.reports([dim]).select("data")

    def reports(self, dims=INSERTED, breakdown: DataFrame | None = None) -> DataFrame:
        """Analysis rows, one per dimension in ``dims`` order, from one job.

        A dimension with no rows still gets its report (an empty table).
        ``breakdown``: the result of ``breakdown_all`` if it is at hand.
        """
        dims = _dims(dims)
        c = self.criteria
        if breakdown is None:
            breakdown = self.breakdown_all(dims)
        else:
            breakdown = breakdown.where(F.col("dim").isin(*[d.slug for d in dims]))
        found = payloads(breakdown, dims)
        spark = found.sparkSession
        wanted = spark.createDataFrame([(i, d.slug) for i, d in enumerate(dims)], "pos int, dim string")
        empty = F.expr(f"""concat('{{"table_header":', {payload_header_sql(dims)}, ',"data":[]}}')""")
        keys = {d.slug: c.analysis_key(d.slug) for d in dims}
        key = F.element_at(F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]), F.col("dim"))
        rows = (F.broadcast(wanted).join(found, "dim", "left")
                .select("pos", key.alias("analysis_key"),
                        F.lit(c.place_id).alias("place_id"),
                        F.lit(c.length).alias("length"),
                        F.expr(report_memo_sql(dims)).alias("memo"),
                        F.lit(c.turf_cond).alias("turf_cond"),
                        F.lit(c.race_type).alias("race_type"),
                        F.lit(c.days_str).alias("days"),
                        F.coalesce(F.col("data"), empty).alias("data"))
                .orderBy("pos"))
        return analysis_frame(rows)

    def insert(self, path: str | None = None, table: str | None = None,
               dims=INSERTED, fmt: str = "parquet", breakdown: DataFrame | None = None) -> bool:
        """Append the reports of ``dims`` (default: the seven stored ones)."""
        return write_analysis(self.reports(dims, breakdown), path=path, table=table, fmt=fmt)

    # -- course card and summary -------------------------------------------
    def _latest_card(self, by_place: DataFrame) -> DataFrame:
        """``by_place`` (one row per racecourse, with its latest race) joined to the
        racecourse names: ``card`` is that race as the original's inner join
        shows it, NULL where the racecourse has no row.

        Races are reduced to one a racecourse before the join, so it is a join of
        two small tables whatever the number of races.  Repeated racecourse ids
        give one row each here: the last name in order."""
        names = self.tables.master_place.groupBy(F.col("id").alias("place_id")).agg(
            F.struct(F.max("name").alias("place_name")).alias("place"))
        card = F.struct("latest.date_and_time", "latest.race_id", "place.place_name", *[f"latest.{c}" for c in CARD_COLUMNS])
        joined = by_place.join(names, "place_id", "left")
        return joined.withColumn("card", F.when(F.col("place").isNotNull() & F.col("latest").isNotNull(), card))

    def course_card(self) -> DataFrame:
        """Latest race whose name contains the graded-race text (no date
        bound); for a course, one row with the empty card text."""
        g = self.criteria.grade_race
        if g is None:
            race = self.tables.race.schema
            empty = [F.lit(None).cast("string").alias("place_name")]
            empty += [F.lit(None).cast(race[c].dataType).alias(c) for c in CARD_COLUMNS]
            return self.tables.race.sparkSession.range(1).select(*empty, F.lit("").alias("course"))
        by_place = self.tables.race.where(F.col("name").contains(g)).groupBy("place_id").agg(
            F.max(_race_struct()).alias("latest"))
        latest = self._latest_card(by_place).agg(F.max("card").alias("card")).where("card IS NOT NULL")
        return latest.select("card.place_name", *[f"card.{c}" for c in CARD_COLUMNS]).select("*", _card_text().alias("course"))

    def summary(self) -> DataFrame:
        """One row: course card text ('' for a course, or when no race matches),
        races, runners.

        Races and card come from one scan of the race table, summed per
        racecourse; the card is chosen after the join to the racecourse names,
        as ``course_card`` chooses it.  Runners come from the same inner join
        ``count_horse`` uses."""
        g = self.criteria.grade_race
        in_card = F.col("name").contains(g) if g is not None else F.lit(False)
        by_place = (
            self.tables.race.withColumns({"in_sel": self.criteria.predicate(), "in_card": in_card})
            .where(F.col("in_sel") | F.col("in_card"))
            .groupBy("place_id").agg(F.count_if("in_sel").alias("races"),
                                     F.max(F.when(F.col("in_card"), _race_struct())).alias("latest")))
        races = self._latest_card(by_place).select("races", F.lit(0).cast("bigint").alias("runners"), "card")
        runners = self._runners().agg(F.count(F.lit(1)).alias("runners")).select(
            F.lit(0).cast("bigint").alias("races"), "runners", F.lit(None).cast(races.schema["card"].dataType).alias("card"))
        stats = races.unionByName(runners).agg(
            F.sum("races").alias("target_race"), F.sum("runners").alias("target_horse"), F.max("card").alias("card"))
        course = F.when(F.col("card").isNotNull(), _card_text()).otherwise("")
        return stats.select("target_race", "target_horse", "card", "card.*").select(course.alias("course"), "target_race", "target_horse")


def _race_struct():
    """A race, so that the greatest one is the latest (ties: larger race id)."""
    return F.struct("date_and_time", "race_id", *CARD_COLUMNS)


# ---------------------------------------------------------------------------
# The course card text (racecourse, distance, surface, turning
# direction, conditions).
# ---------------------------------------------------------------------------
CARD_TEXT = "開催場所: %s競馬場\n距離: %s\nコース: %s\n周り: %s\n条件: %s\n"
# ---------------------------------------------------------------------------


def _card_text():
    def show(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))

    return F.format_string(CARD_TEXT, show("place_name"), show("length"), show("race_type"),
                           show("circling"), show("terms"))
