"""Breakdown of runners by dimension values.

For each dimension value the original program ran three aggregations over
the selected runners and joined them on the value:

* finish counts ``no1``..``no4`` (positions 1, 2, 3 and >3; NULL or 0 counted
  nowhere) and the three rates over ``no1+..+no4``;
* win payout recovery ``SUM(refund) / COUNT(*)`` over the runners
  left-joined to their win payouts (every runner counts, finisher or not);
* the same for place payouts.

Here each runner row carries its count and payout measures, and every measure
is summed once per dimension value (partial sums map-side, one shuffle).  The
dimensions fall in three groups, each with a narrow plan of its own:

* keyed dimensions: one ``Generate`` per runner, a row per dimension, summed
  per (dim, key);
* the jockey dimension: runners joined to the jockey and horse rows (inner
  joins, so repeated or missing rows count as in the original) and summed per
  name -- (horse, jockey) pairs on a course are nearly as many as runners, so
  summing them first would only add a shuffle;
* in-race rank dimensions: summed per (race, time), ranked by a window per
  race -- a bounded group even for a huge race -- and summed per rank
  (separately per side when payout rows repeat, as the original ranked the
  left-joined rows).  With runners already clustered by race, as the race
  join leaves them, neither the sum nor the window shuffles again.

The inner joins of the original drop the NULL key and any value missing from
one of the three sides; the ``has_*`` flags keep that rule.

Expressions are written as Spark SQL text (``selectExpr``): the same plan
as the Column API, built with a handful of calls into the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.sql import ident, quote
from paddock.functions.text import percent_text_sql, record_sql
from paddock.operators.fact import runner_fact
from paddock.operators.joins import PART, fits, unpruned
from paddock.operators.race_rank import value_ranks
from paddock.operators.rate_rank import piece_ranks, window_ranks
from paddock.plans.dimensions import BUCKET, JOCKEY, RACE_RANK, Dimension
from paddock.sources.tables import RaceTables

COUNTS = ("no1", "no2", "no3", "no4")
PAYOUTS = ("w_rows", "w_money", "p_rows", "p_money")
MEASURES = COUNTS + PAYOUTS
# Fact columns that the measures are made from.
FACT_MEASURES = ("seq", "arrival_order", "w_n", "w_sum", "p_n", "p_sum")
FLAGS = ("has_c", "has_w", "has_p")
KEY_COLS = ("dim", "dim_key")
KEY_ORDER_TYPE = "DECIMAL(12,1)"
# Rows of the jockey table (an upper bound of the names) up to which a window ranks all jockeys.
MAX_RANKED_JOCKEYS = 200_000

METRIC_COLUMNS = (
    "record", "win_rate_pct", "rentai_rate_pct", "fukusho_rate_pct",
    "win_rate_ranking", "rentai_rate_ranking", "fukusho_rate_ranking",
    "win_recovery_rate", "d_win_recovery_rate",
    "win_recovery_100_over", "d_win_recovery_100_over",
)


def _cols(names) -> list[str]:
    return [ident(c) for c in names]


def finish_sql() -> str:
    """A runner's finish as the counts tell it apart: 1, 2, 3, 4 (any later one) or NULL (none counted)."""
    return "CASE WHEN seq IS NOT NULL AND arrival_order > 0 THEN least(arrival_order, 4) END"


def measures_sql() -> list[str]:
    """Measures of one runner row (a fact row)."""

    def at(cond: str) -> str:
        return f"CAST(CASE WHEN {cond} AND seq IS NOT NULL THEN 1 ELSE 0 END AS BIGINT)"

    return [
        f"{at('arrival_order = 1')} AS no1",
        f"{at('arrival_order = 2')} AS no2",
        f"{at('arrival_order = 3')} AS no3",
        f"{at('arrival_order > 3')} AS no4",
        "CAST(greatest(coalesce(w_n, 0), 1) AS BIGINT) AS w_rows",
        "CAST(w_sum AS BIGINT) AS w_money",
        "CAST(greatest(coalesce(p_n, 0), 1) AS BIGINT) AS p_rows",
        "CAST(p_sum AS BIGINT) AS p_money",
    ]


def _summed(rows: DataFrame, group: tuple, weight: str | None = None) -> DataFrame:
    """Measures summed per group, times ``weight``; every side has rows."""
    times = f" * {weight}" if weight else ""
    return rows.groupBy(*group).agg(*[F.expr(f"sum({m}{times})").alias(m) for m in MEASURES])


def _keyed(rows: DataFrame, carry: tuple) -> DataFrame:
    return rows.selectExpr(*_cols((*carry, *KEY_COLS)), *MEASURES, *[f"1 AS {f}" for f in FLAGS])


def key_sums(fact: DataFrame, dims: list[Dimension], carry: tuple = ()) -> DataFrame:
    """Raw and bucketed dimensions.

    Keys are computed first, one column each, so the generated rows only
    reference columns: the Generate's code stays small enough for the JIT
    (inlining every bucket CASE into the array made it several times
    slower)."""
    keys = [f"CAST({d.key_sql()} AS STRING) AS k{i}" for i, d in enumerate(dims)]
    rows = ", ".join(f"named_struct('dim', {quote(d.slug)}, 'dim_key', k{i})" for i, d in enumerate(dims))
    keyed = fact.selectExpr(*_cols(carry), *measures_sql(), *keys)
    out = keyed.selectExpr(*_cols(carry), *MEASURES, f"inline(array({rows}))")
    return _keyed(_summed(out, (*carry, *KEY_COLS)), carry)


def jockey_sums(fact: DataFrame, horse: DataFrame, jockey: DataFrame, dim: Dimension,
                carry: tuple = ()) -> DataFrame:
    """The jockey dimension: a runner counts once per (horse row, jockey row)
    of its ids; runners without either are missing.

    Horse and jockey tables carry no hint: Spark broadcasts them while their
    size, as planned or as measured by AQE, is under its threshold."""
    horses = horse.groupBy(F.col("id").alias("horse_id")).agg(F.count(F.lit(1)).alias("horse_n"))
    jockeys = jockey.select(F.col("id").alias("jockey_id"), F.col("name").alias("dim_key"))
    # What the measures are made from is narrower than the measures.
    rows = fact.where("horse_id IS NOT NULL AND jockey_id IS NOT NULL").selectExpr(
        *_cols(carry), "horse_id", "jockey_id", f"CAST({finish_sql()} AS TINYINT) AS arrival_order", "w_n", "w_sum", "p_n", "p_sum")
    named = rows.join(horses, "horse_id").join(jockeys, "jockey_id").selectExpr(
        *_cols(carry), "dim_key", "horse_n", "1 AS seq", "arrival_order", "w_n", "w_sum", "p_n", "p_sum").selectExpr(
        *_cols(carry), "dim_key", "horse_n", *measures_sql())
    return _keyed(_summed(named, (*carry, "dim_key"), "horse_n").withColumn("dim", F.lit(dim.slug)), carry)


def _side(key: str, counts: bool, win: bool, place: bool) -> str:
    zero, none = "CAST(0 AS BIGINT)", "CAST(NULL AS BIGINT)"
    fields = [f"'dim_key', CAST({key} AS STRING)"]
    fields += [f"'{c}', {c if counts else zero}" for c in COUNTS]
    fields += [f"'w_rows', {'w_rows' if win else zero}", f"'w_money', {'w_money' if win else none}",
               f"'p_rows', {'p_rows' if place else zero}", f"'p_money', {'p_money' if place else none}"]
    fields += [f"'{name}', {int(flag)}" for name, flag in zip(FLAGS, (counts, win, place))]
    return f"named_struct({', '.join(fields)})"


def rank_sums(fact: DataFrame, dim: Dimension, carry: tuple = ()) -> DataFrame:
    """An in-race rank dimension (rank 1: smallest time, NULL first)."""
    # Race first: rows are sorted by the number that tells most of them apart, not by the few courses.
    part = (*_race(fact), *carry)
    rows = fact.selectExpr(*_cols(part), f"{ident(dim.source)} AS rr_time", "1L AS c_rows", *measures_sql())
    per_time = rows.groupBy(*part, "rr_time").agg(
        F.sum("c_rows").alias("c_rows"), *[F.sum(m).alias(m) for m in MEASURES])
    ranked = value_ranks(per_time, part, "rr_time",
                         {"rank_c": "c_rows", "rank_w": "w_rows", "rank_p": "p_rows"})
    sides = (f"CASE WHEN rank_c = rank_w AND rank_c = rank_p THEN array({_side('rank_c', True, True, True)}) "
             f"ELSE array({_side('rank_c', True, False, False)}, {_side('rank_w', False, True, False)}, "
             f"{_side('rank_p', False, False, True)}) END")
    out = ranked.selectExpr(*_cols(carry), f"{quote(dim.slug)} AS dim", f"inline({sides})")
    return aggregate(out, (*carry, *KEY_COLS)).selectExpr(*_cols((*carry, *KEY_COLS)), *MEASURES, *FLAGS)


def aggregate(rows: DataFrame, group: tuple) -> DataFrame:
    """Sum measures and OR the side flags per group (partial aggregation map-side)."""
    return rows.groupBy(*group).agg(*[F.sum(m).alias(m) for m in MEASURES],
                                    *[F.max(f).alias(f) for f in FLAGS])


def _race(fact: DataFrame) -> tuple:
    """The race id of ``fact``, and its part where the rows were dealt by race."""
    return ("race_id", PART) if PART in fact.columns else ("race_id",)


def shared_fact(fact: DataFrame, dims: list[Dimension], carry: tuple) -> DataFrame:
    """``fact`` with exactly the columns that ``dims`` need together, for several plans over it.

    Race id and carried columns pass beside the Generate, which keeps the clustering by race."""
    names = dict.fromkeys(FACT_MEASURES)
    for d in dims:
        names.update(dict.fromkeys(("horse_id", "jockey_id") if d.kind == JOCKEY else (d.source,)))
    return unpruned(fact, names, (*carry, *_race(fact)))


def breakdown_sums(tables: RaceTables, races: DataFrame, dims: list[Dimension], carry: tuple = (),
                   races_are_small: bool = False) -> DataFrame:
    """One row per (carry, dim, dim_key): measures and side flags."""
    fact = runner_fact(tables, races, carry, races_are_small)
    keyed = [d for d in dims if d.kind not in (RACE_RANK, JOCKEY)]
    if len(dims) - len(keyed) + bool(keyed) > 1:
        if races_are_small:
            # The races were broadcast, so the runners have no exchange yet that the plans
            # could share; dealt by runner, a hot race is spread.
            fact = fact.repartition("race_id", "horse_no", "seq")
        fact = shared_fact(fact, dims, carry)
    parts = [rank_sums(fact, d, carry) for d in dims if d.kind == RACE_RANK]
    parts += [jockey_sums(fact, tables.horse, tables.jockey, d, carry) for d in dims if d.kind == JOCKEY]
    if keyed:
        parts.append(key_sums(fact, keyed, carry))
    return reduce(DataFrame.unionByName, parts)


def _key_order_sql(dims: list[Dimension]) -> str:
    numeric = [quote(d.slug) for d in dims if d.key_type != "string"]
    if not numeric:
        return f"CAST(NULL AS {KEY_ORDER_TYPE})"
    return (f"CAST(CASE WHEN dim IN ({', '.join(numeric)}) "
            f"THEN try_cast(dim_key AS {KEY_ORDER_TYPE}) END AS {KEY_ORDER_TYPE})")


def _label_sql(dims: list[Dimension]) -> str:
    whens = [f"WHEN {quote(d.slug)} THEN {d.label_sql('try_cast(dim_key AS INT)')}"
             for d in dims if d.kind == BUCKET]
    return f"(CASE dim {' '.join(whens)} ELSE dim_key END)" if whens else "dim_key"


def many_jockeys(tables: RaceTables, dims: list[Dimension]) -> bool:
    """Whether the jockey dimension may have more names than one window task should rank."""
    return any(d.kind == JOCKEY for d in dims) and not fits(tables.jockey, MAX_RANKED_JOCKEYS)


def finish(agg: DataFrame, dims: list[Dimension], part: tuple = (),
           min_jockey_finishes: int = 20, jockeys_are_many: bool = False) -> DataFrame:
    """Texts, ranks and flags of aggregated rows.

    Ranks are taken per ``part + (dim,)`` over the unrounded rates, highest
    first, NULL rates last, ties sharing a rank; the jockey rows are then
    limited to names with at least ``min_jockey_finishes`` counted finishes
    (ranks stay those among all jockeys).  ``jockeys_are_many``: jockey rows are
    ranked by pieces of the rate, the other dimensions' few values by a window.
    """
    kept = agg.where("has_c = 1 AND has_w = 1 AND has_p = 1 AND dim_key IS NOT NULL").selectExpr(
        *_cols(part), *KEY_COLS, *MEASURES,
        "no1 + no2 + no3 + no4 AS total_count", "no1 + no2 AS n12", "no1 + no2 + no3 AS n123")
    group = (*part, "dim")
    rates = {"win_rate_ranking": ("no1", "total_count"), "rentai_rate_ranking": ("n12", "total_count"),
             "fukusho_rate_ranking": ("n123", "total_count")}
    jockey_slugs = ", ".join(quote(d.slug) for d in dims if d.kind == JOCKEY)
    if jockeys_are_many and jockey_slugs:
        # Three plans read these rows: without this each would sum the runners again.
        kept = unpruned(kept, kept.columns)
        few, many = (kept.where(f"dim {is_in} ({jockey_slugs})") for is_in in ("NOT IN", "IN"))
        ranked = window_ranks(few, group, rates).unionByName(piece_ranks(many, group, "dim_key", rates))
    else:
        ranked = window_ranks(kept, group, rates)

    def over_100(money: str, rows: str) -> str:
        return f"CASE WHEN {money} >= {rows} * 100 THEN 1 ELSE 0 END"

    out = ranked.selectExpr(
        *_cols(part), *KEY_COLS,
        f"{_key_order_sql(dims)} AS key_order",
        f"{_label_sql(dims)} AS dim_value",
        f"{record_sql(*COUNTS)} AS record",
        f"{percent_text_sql('no1', 'total_count', 1000)} AS win_rate_pct",
        f"{percent_text_sql('n12', 'total_count', 1000)} AS rentai_rate_pct",
        f"{percent_text_sql('n123', 'total_count', 1000)} AS fukusho_rate_pct",
        *rates,
        f"{percent_text_sql('w_money', 'w_rows', 10)} AS win_recovery_rate",
        f"{percent_text_sql('p_money', 'p_rows', 10)} AS d_win_recovery_rate",
        f"{over_100('w_money', 'w_rows')} AS win_recovery_100_over",
        f"{over_100('p_money', 'p_rows')} AS d_win_recovery_100_over",
        "total_count",
    )
    if jockey_slugs:
        out = out.where(f"dim NOT IN ({jockey_slugs}) OR total_count >= {int(min_jockey_finishes)}")
    return out


def dimension_view(df: DataFrame, dim: Dimension, part: tuple = (), ordered: bool = True) -> DataFrame:
    """One dimension of a finished breakdown, with its key in its native type."""
    cols = [*_cols(part), f"CAST(dim_key AS {dim.key_type}) AS dim_key", "dim_value", *METRIC_COLUMNS]
    if dim.kind == JOCKEY:
        cols.append("total_count")
    out = df.where(f"dim = {quote(dim.slug)}").selectExpr(*cols)
    if not ordered:
        return out
    if dim.kind == JOCKEY:
        return out.orderBy(*part, "win_rate_ranking", "dim_key")
    return out.orderBy(*part, "dim_key")
