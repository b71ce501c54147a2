"""Report text: finish record and percentages.

Percentages are rounded once, half up, to one decimal, on exact integer
arithmetic: ``tenths = (2*k*num + den) div (2*den)`` is ``round(k*num/den)``
for non-negative values.  The text keeps thousands separators
(``1,234.6%``).  A zero denominator or a NULL numerator gives NULL text,
as a division by zero or a sum over no payouts does in the original SQL.

The helpers take SQL of already-aggregated BIGINT values and return SQL
text (``*_sql``) or a Column, so everything stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tenths_sql(num: str, den: str, scale: int) -> str:
    """SQL for round(scale * num / den) half up as BIGINT; NULL when den <= 0."""
    return (f"(CASE WHEN {den} > 0 THEN "
            f"(CAST({2 * scale} AS BIGINT) * {num} + {den}) div (2 * {den}) END)")


def percent_text_sql(num: str, den: str, scale: int) -> str:
    """'12.3%' text of ``scale * num / den`` tenths.

    ``scale`` is 1000 for a rate of counts (num/den*100 with one decimal)
    and 10 for a payout recovery (payout per 100-yen stake, in percent).
    """
    t = tenths_sql(num, den, scale)
    # Under 1,000 % there is no separator to place, and a plain cast is far cheaper.
    whole = f"CASE WHEN {t} < 10000 THEN CAST({t} div 10 AS STRING) ELSE format_number({t} div 10, 0) END"
    return f"concat({whole}, '.', CAST({t} % 10 AS STRING), '%')"


def percent_text_expr(num: str, den: str, scale: int) -> Column:
    return F.expr(percent_text_sql(num, den, scale))


def ratio_sql(num: str, den: str) -> str:
    """Exact-as-decimal num/den for ordering; NULL when den is 0."""
    return f"try_divide(CAST({num} AS DECIMAL(20,0)), CAST({den} AS DECIMAL(20,0)))"


def record_sql(no1: str, no2: str, no3: str, no4: str) -> str:
    """'n1-n2-n3-n4/total' finish record."""
    parts = [f"CAST({c} AS STRING)" for c in (no1, no2, no3, no4)]
    total = f"CAST({no1} + {no2} + {no3} + {no4} AS STRING)"
    return f"concat({parts[0]}, '-', {parts[1]}, '-', {parts[2]}, '-', {parts[3]}, '/', {total})"
