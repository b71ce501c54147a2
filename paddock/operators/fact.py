"""Per-runner fact: selected races x results, with payouts attached.

One row per (selected race row, result row) of a race, carrying what the
breakdowns need:

* finish position and ``seq`` (the counted column);
* the raw columns the dimensions are computed from;
* per ticket type, the number of payout rows the runner joins (``w_n``,
  ``p_n``) and their sum (``w_sum``, ``p_sum``).

Races join runners by an inner join whatever their number, so a repeated
race id repeats its runners, as in the original SQL.  Payouts are aggregated
to one row per (race, horse number) *before* the join, so that join never
fans out; a runner with ``n`` payout rows stands for ``max(n, 1)`` rows of
the original left join, which is what the recovery denominator counts.

Many runners are dealt by race in parts of bounded rows, as are races and payouts:
both joins, and the in-race rank later, run in those parts without a further
shuffle (``joins.dealt``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.joins import PART, dealt, even_parts
from paddock.schemas import PLACE_TICKET, WIN_TICKET
from paddock.sources.tables import RaceTables

RUNNER_COLUMNS = (
    "race_id", "horse_no", "seq", "arrival_order", "horse_id", "jockey_id",
    "frame_no", "popularity_order", "horse_sex", "horse_weight", "horse_age",
    "jokey_weight", "corner4", "seconds_3f",
)
RUNNER_KEY = ("race_id", "horse_no")


def refund_by_runner(refund: DataFrame, by: tuple = RUNNER_KEY) -> DataFrame:
    """(race_id, horse_no) -> w_n, w_sum, p_n, p_sum (ticket types 1 and 2 only)."""
    r = refund.where(F.col("ticket_type").isin(WIN_TICKET, PLACE_TICKET))
    win = F.col("ticket_type") == WIN_TICKET
    place = F.col("ticket_type") == PLACE_TICKET
    return r.groupBy(*by).agg(
        F.count_if(win).alias("w_n"),
        F.sum(F.when(win, F.col("refund"))).alias("w_sum"),
        F.count_if(place).alias("p_n"),
        F.sum(F.when(place, F.col("refund"))).alias("p_sum"),
    )


def race_runners(tables: RaceTables, races: DataFrame, races_are_small: bool) -> DataFrame:
    """Result rows joined to the rows of ``races`` (inner, on ``race_id``).

    ``races_are_small``: ``races`` is a checked broadcast; a result table that
    is derived per race (``results_of``) is then derived for these races only."""
    result = tables.results_for(races.select("race_id")) if races_are_small else tables.result
    return result.select(*RUNNER_COLUMNS).join(races, "race_id")


def runner_fact(tables: RaceTables, races: DataFrame, race_cols: tuple = (),
                races_are_small: bool = False) -> DataFrame:
    """Runners of the selected races (``race_id`` + ``race_cols``) with payouts,
    and with the column ``PART`` where they were dealt."""
    races = races.select("race_id", *race_cols)
    parts = None if races_are_small else even_parts(tables.result, "race_id")
    if parts is not None:
        result, refund = tables.dealt_results(parts)
        runners = result.select(*RUNNER_COLUMNS, PART).join(dealt(races, "race_id", parts), ["race_id", PART])
        payouts = refund_by_runner(dealt(refund, "race_id", parts), (*RUNNER_KEY, PART))
        return runners.join(payouts, [*RUNNER_KEY, PART], "left")
    if races_are_small:
        refund = tables.refund.join(races.select("race_id"), "race_id", "left_semi")
    else:
        # Cluster the payouts by race_id like the race join's output, so the
        # (race_id, horse_no) join need not shuffle the runners again (with
        # spark.sql.requireAllClusterKeysForCoPartition=false, see session.py).
        refund = tables.refund.repartition("race_id")
    return race_runners(tables, races, races_are_small).join(
        refund_by_runner(refund), ["race_id", "horse_no"], "left")
