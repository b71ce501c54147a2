"""Which races to analyse.

Two modes, as in the original program:

* **course** (``grade_race is None``): racecourse, surface, distance, going
  and meeting days, with races strictly after ``since``
  (default ``2010-01-01 09:50:00``);
* **graded race**: race name contains ``grade_race``, strictly after
  ``since`` (default ``2012-01-01 09:50:00``).  The course fields are then
  ignored by the filter but still form the analysis key.

Optional predicates (month, name, terms, race rank) are off by default.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.sources.tables import PLACE_ROMAJI

# ---------------------------------------------------------------------------
# Meeting-day presets and their names, going names in keys,
# surface names, and the default cut-offs.
# ---------------------------------------------------------------------------
DAY_PRESETS = {
    1: (1, 2),
    2: (3, 4),
    3: (5, 6),
    4: (7, 8),
    5: (1, 2, 3, 4),
    6: (5, 6, 7, 8, 9, 10, 11, 12),
    7: (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12),
}
DAY_PRESET_NAMES = {1: "開幕週", 2: "2週目だけ", 3: "3週目だけ", 4: "最終週",
                    5: "開催前半", 6: "開催後半", 7: "全体"}
GOING_EN = {"良": "good", "重": "bad", "稍重": "litle_bad"}
SURFACE = {True: ("芝", "turf"), False: ("ダ", "dirt")}
COURSE_SINCE = "2010-01-01 09:50:00"
GRADED_SINCE = "2012-01-01 09:50:00"
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Criteria:
    place_id: int
    is_turf: bool
    length: int
    turf_cond: str
    days: tuple[int, ...]
    grade_race: str | None = None
    since: str | None = None
    # Optional predicates, off by default.
    months: tuple[int, ...] | None = None
    name_contains: str | None = None
    terms: str | None = None
    race_rank: str | None = None

    def __post_init__(self):
        if self.place_id not in PLACE_ROMAJI:
            raise ValueError(f"unknown place_id {self.place_id}")
        if self.turf_cond not in GOING_EN:
            raise ValueError(f"unknown going {self.turf_cond!r}; expected one of {list(GOING_EN)}")
        if not self.days:
            raise ValueError("days must name at least one meeting day")
        object.__setattr__(self, "days", tuple(int(d) for d in self.days))

    @classmethod
    def preset(cls, place_id: int, is_turf: bool, length: int, turf_cond: str,
               preset: int, **kw) -> "Criteria":
        return cls(place_id, is_turf, length, turf_cond, DAY_PRESETS[preset], **kw)

    # -- key parts --------------------------------------------------------
    @property
    def race_type(self) -> str:
        return SURFACE[self.is_turf][0]

    @property
    def race_type_en(self) -> str:
        return SURFACE[self.is_turf][1]

    @property
    def place(self) -> str:
        return PLACE_ROMAJI[self.place_id]

    @property
    def turf_cond_en(self) -> str:
        return GOING_EN[self.turf_cond]

    @property
    def days_str(self) -> str:
        return "-".join(str(d) for d in self.days)

    @property
    def cutoff(self) -> str:
        if self.since is not None:
            return self.since
        return GRADED_SINCE if self.grade_race is not None else COURSE_SINCE

    def analysis_key(self, slug: str) -> str:
        return f"{slug}-{self.place}-{self.race_type_en}-{self.length}-{self.turf_cond_en}-{self.days_str}"

    # -- filter -------------------------------------------------------------
    def predicate(self) -> Column:
        after = F.col("date_and_time") > F.lit(self.cutoff).cast("timestamp_ntz")
        if self.grade_race is not None:
            preds = [F.col("name").contains(self.grade_race), after]
        else:
            preds = [
                F.col("place_id") == F.lit(self.place_id),
                F.col("length") == F.lit(self.length),
                F.col("race_type") == F.lit(self.race_type),
                after,
                F.col("turf_cond") == F.lit(self.turf_cond),
                F.col("days").isin(*self.days),
            ]
            if self.months:
                preds.append(F.month("date_and_time").isin(*self.months))
            if self.name_contains is not None:
                preds.append(F.col("name").contains(self.name_contains))
            if self.terms is not None:
                preds.append(F.col("terms") == F.lit(self.terms))
            if self.race_rank is not None:
                preds.append(F.col("race_rank") == F.lit(self.race_rank))
        return reduce(lambda a, b: a & b, preds)

    def races(self, race: DataFrame) -> DataFrame:
        return race.where(self.predicate())
