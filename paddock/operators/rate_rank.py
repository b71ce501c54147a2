"""Ranks of rates within groups: highest first, NULL last, ties share a rank.

``window_ranks`` is ``rank()`` over each group: one task holds a group, which is
right while groups are small.  ``piece_ranks`` gives the same ranks for groups of
any size:

1. rows are counted per distinct rate (partial counts first), so a rate that many
   rows share -- no win at all, say -- is one row;
2. the range of rates is cut in ``PIECES`` equal pieces; the rows of all higher
   pieces are counted by a window over at most ``PIECES + 2`` sums a group;
3. within a piece a second window counts the rows of higher rates; its group is
   one piece's distinct rates;
4. the ranks are joined back on the rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.sql import ident, quote
from paddock.functions.text import ratio_sql

PIECES = 1024


def _by(group: tuple) -> str:
    return ", ".join(ident(c) for c in group)


def window_ranks(rows: DataFrame, group: tuple, rates: dict[str, tuple[str, str]]) -> DataFrame:
    """``rows`` with a rank column for each entry of ``rates`` (name -> numerator, denominator)."""
    return rows.selectExpr("*", *[
        f"rank() OVER (PARTITION BY {_by(group)} ORDER BY {ratio_sql(*rate)} DESC NULLS LAST) AS {ident(name)}"
        for name, rate in rates.items()])


def piece_ranks(rows: DataFrame, group: tuple, key: str, rates: dict[str, tuple[str, str]]) -> DataFrame:
    """The same for groups of any size; rates lie between 0 and 1, ``key`` is unique in a group."""
    each = ", ".join(f"named_struct('_metric', {quote(name)}, '_rate', {ratio_sql(*rate)})" for name, rate in rates.items())
    long = rows.selectExpr(*[ident(c) for c in (*group, key)], f"inline(array({each}))")
    metric = (*group, "_metric")
    per_rate = long.groupBy(*metric, "_rate").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_piece", F.expr(f"CAST(floor(coalesce(_rate, -1) * {PIECES}) AS INT)"))
    within = per_rate.selectExpr(
        "*", f"coalesce(sum(_n) OVER (PARTITION BY {_by(metric)}, _piece ORDER BY _rate DESC NULLS LAST "
             f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _in")
    above = per_rate.groupBy(*metric, "_piece").agg(F.sum("_n").alias("_m")).selectExpr(
        *[ident(c) for c in (*metric, "_piece")],
        f"coalesce(sum(_m) OVER (PARTITION BY {_by(metric)} ORDER BY _piece DESC "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _above")
    ranks = _same(within, above, (*metric, "_piece")).selectExpr(
        *[ident(c) for c in (*metric, "_rate")], "CAST(1 + _above + _in AS INT) AS _rank")
    ranked = _same(long, ranks, (*metric, "_rate")).groupBy(*group, key).agg(
        *[F.max(F.when(F.col("_metric") == name, F.col("_rank"))).alias(name) for name in rates])
    return _same(rows, ranked, (*group, key))


def _same(left: DataFrame, right: DataFrame, columns: tuple) -> DataFrame:
    """Inner join on equal ``columns``, NULLs equal."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in columns})
    on = [left[c].eqNullSafe(renamed[f"_r_{c}"]) for c in columns]
    return left.join(renamed, on).drop(*[f"_r_{c}" for c in columns])
