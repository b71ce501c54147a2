"""Report building: cell highlighting, JSON payload, analysis rows, display.

A report cell is ``struct(value, schema)`` where ``schema`` is a colour or
NULL: the three rates are coloured by their rank (1 yellow, 2 blue, 3 red)
and the two recoveries yellow when at or above 100 %.  The payload is
``{"table_header": [...], "data": [row, ...]}`` with rows in key order
(jockeys in win-rate rank order), written with ``to_json`` keeping nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from paddock.functions.sql import ident, quote
from paddock.plans.dimensions import BUCKET, JOCKEY, TABLE_COLUMNS, Dimension, table_header

# ---------------------------------------------------------------------------
# Highlight colours by rank, and for a recovery at or over 100 %.
# ---------------------------------------------------------------------------
RANK_COLOURS = {1: "yellow", 2: "blue", 3: "red"}
RECOVERY_COLOUR = "yellow"
# ---------------------------------------------------------------------------

# (display column, value column, rank or flag column)
_CELLS = (
    ("着度数", "record", None),
    ("勝率", "win_rate_pct", "win_rate_ranking"),
    ("連対率", "rentai_rate_pct", "rentai_rate_ranking"),
    ("複勝率", "fukusho_rate_pct", "fukusho_rate_ranking"),
    ("単回値", "win_recovery_rate", "win_recovery_100_over"),
    ("複回値", "d_win_recovery_rate", "d_win_recovery_100_over"),
)
assert tuple(c[0] for c in _CELLS) == TABLE_COLUMNS

JSON_OPTIONS = "map('ignoreNullFields', 'false')"


def rank_colour_sql(rank: str) -> str:
    whens = " ".join(f"WHEN {r} THEN {quote(c)}" for r, c in RANK_COLOURS.items())
    return f"(CASE {rank} {whens} END)"


def flag_colour_sql(flag: str) -> str:
    return f"(CASE WHEN {flag} = 1 THEN {quote(RECOVERY_COLOUR)} END)"


def _colour_sql(driver: str | None) -> str:
    if driver is None:
        return "CAST(NULL AS STRING)"
    if driver.endswith("_ranking"):
        return rank_colour_sql(driver)
    return flag_colour_sql(driver)


def label_value_sql(dim: Dimension) -> str:
    """The label column's value: bucket label, else the key in its native type."""
    return "dim_value" if dim.kind == BUCKET else f"try_cast(dim_key AS {dim.key_type})"


def highlight_colours(view: DataFrame, dim: Dimension, part: tuple = ()) -> DataFrame:
    """Flat colour columns of a dimension view (one per coloured cell)."""
    return view.selectExpr(
        *[ident(c) for c in part], "dim_key",
        f"{rank_colour_sql('win_rate_ranking')} AS win_rate_color",
        f"{rank_colour_sql('rentai_rate_ranking')} AS rentai_rate_color",
        f"{rank_colour_sql('fukusho_rate_ranking')} AS fukusho_rate_color",
        f"{flag_colour_sql('win_recovery_100_over')} AS win_recovery_color",
        f"{flag_colour_sql('d_win_recovery_100_over')} AS d_win_recovery_color",
    )


def _cell(value: str, colour: str) -> str:
    return f"named_struct('value', {value}, 'schema', {colour})"


def report_row_sql(dim: Dimension) -> str:
    """One payload row: label cell then the six report cells, by display name."""
    fields = [f"{quote(dim.column_ja)}, {_cell(label_value_sql(dim), 'CAST(NULL AS STRING)')}"]
    fields += [f"{quote(name)}, {_cell(value, _colour_sql(driver))}" for name, value, driver in _CELLS]
    return f"named_struct({', '.join(fields)})"


def highlight_cells(view: DataFrame, dim: Dimension, part: tuple = ()) -> DataFrame:
    """The view as cell structs, rank and flag columns dropped."""
    cols = [ident(c) for c in part]
    return (view.selectExpr(*cols, "dim_key", f"{report_row_sql(dim)} AS row")
            .selectExpr(*cols, "dim_key", "row.*"))


def _by_dim(dims: list[Dimension], value) -> str:
    whens = " ".join(f"WHEN {quote(d.slug)} THEN {value(d)}" for d in dims)
    return f"(CASE dim {whens} END)"


def payload_header_sql(dims: list[Dimension]) -> str:
    """JSON text of the table header of the dimension in ``dim``."""
    return _by_dim(dims, lambda d: f"to_json(array({', '.join(quote(h) for h in table_header(d))}))")


def report_memo_sql(dims: list[Dimension]) -> str:
    """Memo of the dimension in ``dim``."""
    return _by_dim(dims, lambda d: quote(d.memo))


def payloads(df: DataFrame, dims: list[Dimension], part: tuple = ()) -> DataFrame:
    """``part`` + ``dim`` + ``data``: the JSON payload of each (group, dimension).

    One aggregation serves every dimension: each row is turned into its JSON
    text by its dimension's cell layout, and the rows of a group are gathered
    with ``collect_list`` -- one row per dimension value, so a group is
    bounded by the dimension's cardinality -- and sorted by key (jockeys:
    win-rate rank, then name).  The envelope is written around the row
    texts, so the output equals ``to_json`` of the whole payload.
    """
    jockey = [quote(d.slug) for d in dims if d.kind == JOCKEY]
    rank_first = (f"CASE WHEN dim IN ({', '.join(jockey)}) THEN win_rate_ranking ELSE 0 END"
                  if jockey else "0")
    row_json = _by_dim(dims, lambda d: f"to_json({report_row_sql(d)}, {JSON_OPTIONS})")
    cols = [ident(c) for c in part]
    entries = df.selectExpr(
        *cols, "dim",
        f"named_struct('o0', {rank_first}, 'o1', key_order, 'o2', dim_key, 'j', {row_json}) AS entry")
    grouped = entries.groupBy(*part, "dim").agg({"entry": "collect_list"}).withColumnRenamed(
        "collect_list(entry)", "rows")
    body = (f"concat('{{\"table_header\":', {payload_header_sql(dims)}, ',\"data\":[', "
            f"array_join(transform(sort_array(rows), x -> x.j), ','), ']}}')")
    return grouped.selectExpr(*cols, "dim", f"{body} AS data")


def display(view: DataFrame, dim: Dimension) -> DataFrame:
    """The display table: label column, then the six report columns."""
    cols = [f"{label_value_sql(dim)} AS {ident(dim.column_ja)}"]
    cols += [f"{value} AS {ident(name)}" for name, value, _ in _CELLS]
    return view.selectExpr(*cols)
