"""The eleven breakdown dimensions.

Each dimension says how a runner's key is computed (raw column, bucket of
a column, in-race rank of the last-3F time, or jockey name) and how the key
is labelled and reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from paddock.functions.buckets import (
    HORSE_WEIGHT_LABELS,
    HORSE_WEIGHT_RULES,
    LAST_3F_LABELS,
    LAST_3F_RULES,
    LEG_TYPE_LABELS,
    LEG_TYPE_RULES,
    bucket_sql,
    label_sql,
)
from paddock.functions.sql import ident

RAW, BUCKET, RACE_RANK, JOCKEY = "raw", "bucket", "race_rank", "jockey"


@dataclass(frozen=True)
class Dimension:
    name: str        # method name, also the query suffix
    slug: str        # analysis-key prefix
    column_ja: str   # label column of the display table
    header: str      # first entry of the stored table header
    memo: str
    kind: str
    source: str      # runner column the key is computed from
    key_type: str    # Spark type of the native key
    rules: tuple = ()
    labels: tuple = ()

    @property
    def query(self) -> str:
        return "by_" + QUERY_SUFFIX.get(self.name, self.name)

    def key_sql(self) -> str:
        """SQL of the key over a runner row (not for RACE_RANK / JOCKEY)."""
        if self.kind == BUCKET:
            return bucket_sql(ident(self.source), list(self.rules))
        return ident(self.source)

    def label_sql(self, key: str) -> str:
        """SQL of the display label of a native key."""
        if self.kind == BUCKET:
            return label_sql(key, dict(self.labels))
        return f"CAST({key} AS STRING)"

def _b(rules, labels):
    return tuple(rules), tuple(labels.items())


# ---------------------------------------------------------------------------
# Method name, key slug, display label, stored header, memo.
# ---------------------------------------------------------------------------
DIMENSIONS = (
    Dimension("frame_no", "wakuban", "枠番", "枠番", "枠番別成績", RAW, "frame_no", "int"),
    Dimension("horse_no", "umaban", "馬番", "馬番", "馬番別成績", RAW, "horse_no", "int"),
    Dimension("popularity_order", "ninnki", "人気順", "人気", "人気順成績", RAW,
              "popularity_order", "int"),
    Dimension("horse_sex", "seibetu", "性別", "性別", "性別別成績", RAW, "horse_sex", "string"),
    Dimension("leg_type", "kyakusitu", "脚質", "脚質", "脚質別成績", BUCKET, "corner4", "int",
              *_b(LEG_TYPE_RULES, LEG_TYPE_LABELS)),
    Dimension("horse_weight", "bataijuu", "馬体重", "馬体重", "馬体重別成績", BUCKET,
              "horse_weight", "int", *_b(HORSE_WEIGHT_RULES, HORSE_WEIGHT_LABELS)),
    Dimension("horse_age", "barei", "馬齢", "馬齢", "馬齢別成績", RAW, "horse_age", "int"),
    Dimension("jokey_weight", "kinryo", "斤量", "斤量", "斤量別成績", RAW, "jokey_weight",
              "decimal(4,1)"),
    Dimension("seconds_3f", "last3f", "3Fタイム", "3Fタイム", "上がり3Fタイム別成績", BUCKET,
              "seconds_3f", "int", *_b(LAST_3F_RULES, LAST_3F_LABELS)),
    Dimension("seconds_3f_rank", "3f_rank", "3F速さ順位", "3F速さ順位", "3F速さ順位", RACE_RANK,
              "seconds_3f", "int"),
    Dimension("jockey", "jockey", "騎手", "騎手", "騎手別", JOCKEY, "jockey_id", "string"),
)
# The dimensions stored by the batch insert, in insert order.
INSERTED = ("frame_no", "horse_no", "horse_weight", "popularity_order", "leg_type",
            "seconds_3f", "seconds_3f_rank")
# Display order of the report columns after the label.
TABLE_COLUMNS = ("着度数", "勝率", "連対率", "複勝率", "単回値", "複回値")
# ---------------------------------------------------------------------------

QUERY_SUFFIX = {"popularity_order": "popularity", "jokey_weight": "carried_weight"}

_BY_NAME = {d.name: d for d in DIMENSIONS}
_BY_SLUG = {d.slug: d for d in DIMENSIONS}


def dimension(name: str) -> Dimension:
    """Look a dimension up by method name (``frame_no``) or slug (``wakuban``)."""
    if name in _BY_NAME:
        return _BY_NAME[name]
    if name in _BY_SLUG:
        return _BY_SLUG[name]
    raise KeyError(f"unknown dimension {name!r}")


def table_header(dim: Dimension) -> list[str]:
    return [dim.header, *TABLE_COLUMNS]
