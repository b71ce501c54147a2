"""Bucket and label expressions for the bucketed dimensions.

A bucket rule list is evaluated like a searched CASE: the first matching
rule wins and a value no rule matches (NULL, or a value in a gap between
rules) gets NULL.  Rules keep the original bounds exactly, including the
overlap at 14 for the running style (14 is caught by bucket 3) and the
gaps between half-second time buckets.

Expressions are produced as Spark SQL text, so a whole CASE is one
expression handed to the JVM.
"""

from __future__ import annotations

from decimal import Decimal

from paddock.functions.sql import quote

# ---------------------------------------------------------------------------
# Bucket bounds and display labels.  They must equal the
# original course-statistics definitions byte for byte (labels include their
# original spacing, e.g. "440kg ~459kg", "34.0 ~  34.4", "520kg ~ ").
# Rule forms: ("eq", v), ("lt", v), ("ge", v), ("between", lo, hi).
# ---------------------------------------------------------------------------

# Running style from the 4th-corner position.
LEG_TYPE_RULES = [
    (1, ("eq", 1)),
    (2, ("between", 2, 6)),
    (3, ("between", 7, 14)),
    (4, ("ge", 14)),
]
LEG_TYPE_LABELS = {1: "逃げ", 2: "先行", 3: "差し", 4: "追込"}

# Body weight in kg.
HORSE_WEIGHT_RULES = [
    (1, ("lt", 420)),
    (2, ("between", 420, 439)),
    (3, ("between", 440, 459)),
    (4, ("between", 460, 479)),
    (5, ("between", 480, 499)),
    (6, ("between", 500, 519)),
    (7, ("ge", 520)),
]
HORSE_WEIGHT_LABELS = {
    1: "~ 419kg",
    2: "420kg ~ 439kg",
    3: "440kg ~459kg",
    4: "460kg ~ 479kg",
    5: "480kg ~ 499kg",
    6: "500kg ~ 519kg",
    7: "520kg ~ ",
}

# Last-3-furlong time in seconds.
LAST_3F_RULES = [
    (1, ("between", Decimal("31.5"), Decimal("31.9"))),
    (2, ("between", Decimal("32.0"), Decimal("32.4"))),
    (3, ("between", Decimal("32.5"), Decimal("32.9"))),
    (4, ("between", Decimal("33.0"), Decimal("33.4"))),
    (5, ("between", Decimal("33.5"), Decimal("33.9"))),
    (6, ("between", Decimal("34.0"), Decimal("34.4"))),
    (7, ("between", Decimal("34.5"), Decimal("34.9"))),
    (8, ("between", Decimal("35.0"), Decimal("35.4"))),
    (9, ("between", Decimal("35.5"), Decimal("35.9"))),
    (10, ("ge", Decimal("36.0"))),
]
LAST_3F_LABELS = {
    1: "31.5 ~ 31.9",
    2: "32.0 ~ 32.4",
    3: "32.5 ~ 32.9",
    4: "33.0 ~ 33.4",
    5: "33.5 ~ 33.9",
    6: "34.0 ~  34.4",
    7: "34.5 ~ 34.9",
    8: "35.0 ~ 35.4",
    9: "35.5 ~ 35.9",
    10: "36.0 ~",
}
# ---------------------------------------------------------------------------

_OPS = {"eq": "=", "lt": "<", "ge": ">="}


def _literal(v) -> str:
    # Decimals keep their scale (31.5 is DECIMAL(3,1)), so comparisons with
    # a DECIMAL column are exact.
    return str(v)


def _rule_sql(value: str, rule: tuple) -> str:
    op = rule[0]
    if op == "between":
        return f"{value} BETWEEN {_literal(rule[1])} AND {_literal(rule[2])}"
    if op in _OPS:
        return f"{value} {_OPS[op]} {_literal(rule[1])}"
    raise ValueError(f"unknown bucket rule {rule!r}")


def bucket_sql(value: str, rules: list) -> str:
    """Searched CASE over ``rules``; no match gives NULL (no ELSE)."""
    whens = " ".join(f"WHEN {_rule_sql(value, rule)} THEN {bucket_id}" for bucket_id, rule in rules)
    return f"(CASE {whens} END)"


def label_sql(bucket: str, labels: dict) -> str:
    """Simple CASE from bucket id to label; unknown id gives NULL."""
    whens = " ".join(f"WHEN {bucket_id} THEN {quote(text)}" for bucket_id, text in labels.items())
    return f"(CASE {bucket} {whens} END)"
