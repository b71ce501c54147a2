"""In-race ranks (ascending, NULL first, ties share).

``RANK() OVER (PARTITION BY race_id ORDER BY c)`` puts a whole race in one
window task.  ``value_ranks`` runs the window over rows already summed per
(race, value) -- at most one per distinct value of a race, so a race holding a
large share of all rows still gives the window task a bounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.sql import ident
from paddock.operators.joins import PART_ROWS, parts_of


def value_ranks(summed: DataFrame, part: tuple, value: str, weights: dict[str, str]) -> DataFrame:
    """``summed`` (one row per ``part`` and ``value``) with the ranks in
    ``weights`` (rank column -> weight column): 1 + the weight of all smaller
    values."""
    by = ", ".join(ident(c) for c in part)
    before = (f"OVER (PARTITION BY {by} ORDER BY {ident(value)} ASC NULLS FIRST "
              f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    return summed.selectExpr("*", *[f"CAST(1 + coalesce(sum({ident(w)}) {before}, 0) AS BIGINT) AS {ident(r)}"
                                    for r, w in weights.items()])


def dealt_runners(result: DataFrame, races: DataFrame, column: str, part_rows: int = PART_ROWS) -> DataFrame | None:
    """Race id and ``column`` of the runners of ``races``, in parts of bounded
    size by race; ``None`` when ``result`` is small.

    Counting and ranking hold a task's rows in two sorts and two hash tables,
    some 450 bytes a row."""
    parts = parts_of(result, part_rows)
    if parts is None:
        return None
    return result.select("race_id", column).repartition(parts, "race_id").join(
        races.select("race_id").repartition(parts, "race_id"), "race_id")


def in_race_rank(runners: DataFrame, column: str, out: str, counted: DataFrame | None = None) -> DataFrame:
    """``runners`` with the in-race rank of ``column``, one plan for any size of race.

    ``counted``: the same runners (race_id and ``column`` at least) in the
    partitions their values are to be counted and ranked in; ``runners`` itself
    where none are given.

    A rank needs the number of runners with smaller values only, so values are
    counted per (race, value) -- reading these two columns, partial counts first
    -- ranked per race, and joined back on (race, value).  A huge race is dealt
    by its values; one value that many of its runners share is a skewed key of
    that join, which AQE splits."""
    counts = (runners if counted is None else counted).groupBy("race_id", column).agg(F.count(F.lit(1)).alias("_n"))
    # One computed key: with race_id as a key of its own the join would keep the clustering
    # by race that the window leaves, and AQE splits only joins of two shuffled sides.
    key = f"concat(race_id, '/', coalesce(concat('=', {ident(column)}), ''))"
    ranks = value_ranks(counts, ("race_id",), column, {"_rank": "_n"}).selectExpr(
        f"{key} AS _of", f"CAST(_rank AS INT) AS {ident(out)}")
    return runners.withColumn("_of", F.expr(key)).join(ranks, "_of").drop("_of")
