"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.sql import ident, quote

# Largest number of rows a side may have to be broadcast by ``bounded_broadcast``.
# A selected-races side is (race_id + a few small columns), ~50 bytes a row,
# so the bound keeps a broadcast under ~25 MB.
MAX_BROADCAST_ROWS = 500_000
# Rows of a part that ``parts_of`` aims at, and the parts below which the session's own
# partitions are as small.
PART_ROWS = 500_000
MIN_PARTS = 16
# Part number of a row dealt by ``dealt``, and how much larger than aimed at the largest part may be.
PART = "_part"
MAX_PART_FACTOR = 4


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    A plain ``count()``: partial counts per task, no column read for a bare
    table scan.  (``limit(n).count()`` would funnel up to n rows per
    partition into one task.)"""
    return df.count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` when ``df`` has at most ``max_rows`` rows.

    The row count is measured with a small job on ``df`` (for selected races:
    a pruned, filter-pushed scan of the race table).  Above the bound the
    DataFrame is returned unhinted, so joins shuffle it (and AQE may still
    switch to a broadcast once it has measured the shuffle).
    """
    if fits(df, max_rows):
        return F.broadcast(df), True
    return df, False


def parts_of(df: DataFrame, part_rows: int = PART_ROWS) -> int | None:
    """Partitions of at most about ``part_rows`` rows for ``df``; ``None`` when
    it is small enough for the session's own.

    AQE coalesces shuffles to few partitions of a size in compressed bytes,
    whatever the sorts and hash tables of their tasks make of them; a number
    given to ``repartition`` stands.  Counted as in ``fits``."""
    parts = -(-df.count() // part_rows)
    return parts if parts >= MIN_PARTS else None


def unpruned(df: DataFrame, columns, beside: tuple = ()) -> DataFrame:
    """``df`` with the columns ``beside`` and ``columns``, for several plans over it.

    Each plan reads other columns and rows, and Catalyst would cut each one's scans
    and exchanges to its own: the same rows read, summed and shuffled once a plan.
    The rows pass a Generate of one row that names ``columns``; nothing is cut
    through it, so the exchanges below are equal and Spark reuses them."""
    fields = ", ".join(f"{quote(c)}, {ident(c)}" for c in columns)
    return df.selectExpr(*[ident(c) for c in beside], f"inline(array(named_struct({fields})))")


def _part_sql(key: str, parts: int) -> str:
    return f"pmod(hash({ident(key)}), {int(parts)})"


def even_parts(df: DataFrame, key: str, part_rows: int = PART_ROWS) -> int | None:
    """``parts_of(df)``, but ``None`` as well where a value of ``key`` has so many
    rows that its part would be much larger than the others: joins that AQE may
    split are right then.  Reads ``key`` alone; a task hands on one number a part."""
    parts = parts_of(df, part_rows)
    if parts is None:
        return None
    rows = df.where(f"{ident(key)} IS NOT NULL").groupBy(F.expr(_part_sql(key, parts)).alias(PART)).count()
    largest = rows.agg(F.max("count")).first()[0] or 0
    return parts if largest <= MAX_PART_FACTOR * part_rows else None


def dealt(df: DataFrame, key: str, parts: int) -> DataFrame:
    """``df`` in ``parts`` partitions by ``key``, whose number is the column ``PART``;
    rows without a key, which no join keeps, are left out.

    Joins, sums and windows by ``PART``, ``key`` and any further columns run in
    these partitions without a shuffle.  Dealt by ``key`` as such, a join on more
    columns shuffles both sides by all of them, unless
    ``spark.sql.requireAllClusterKeysForCoPartition`` is off."""
    numbered = df.where(f"{ident(key)} IS NOT NULL").withColumn(PART, F.expr(_part_sql(key, parts)))
    return numbered.repartitionById(parts, F.col(PART))
