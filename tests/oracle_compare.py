"""Run a registered query in Spark and its oracle SQL in DuckDB; compare.

Columns are compared by name (sorted), rows as an order-insensitive
multiset of normalised values, types by family (integer, text, decimal,
float, timestamp).
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if v != v:
            return None
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v.to_integral_value() else str(v.normalize())
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, bool):
        return int(v)
    return v


def _family(spark_type: str) -> str:
    t = spark_type.lower()
    if t in ("int", "integer", "bigint", "long", "smallint", "tinyint", "hugeint"):
        return "int"
    if t.startswith("decimal"):
        return "decimal"
    if t in ("double", "float", "real"):
        return "float"
    if t.startswith("timestamp"):
        return "timestamp"
    if t in ("string", "varchar") or t.startswith("varchar"):
        return "text"
    return t


def compare(spark, name: str, query, sql: str, sf_dir: str, con=None) -> dict:
    df = query(spark, sf_dir)
    s_cols = [(f.name, _family(f.dataType.simpleString())) for f in df.schema.fields]
    s_rows = [tuple(r) for r in df.collect()]
    con = con or duck(sf_dir)
    rel = con.execute(sql)
    d_cols = [(d[0], _family(str(d[1]).split("(")[0] if not str(d[1]).startswith("DECIMAL")
                             else "decimal")) for d in rel.description]
    d_rows = rel.fetchall()
    s_order = sorted(range(len(s_cols)), key=lambda i: s_cols[i][0])
    d_order = sorted(range(len(d_cols)), key=lambda i: d_cols[i][0])
    out = {
        "query": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": [s_cols[i][0] for i in s_order] == [d_cols[i][0] for i in d_order],
        "types": {s_cols[i][0]: (s_cols[i][1], d_cols[j][1]) for i, j in zip(s_order, d_order)
                  if s_cols[i][1] != d_cols[j][1]},
    }
    s_vals = Counter(tuple(_norm(r[i]) for i in s_order) for r in s_rows)
    d_vals = Counter(tuple(_norm(r[i]) for i in d_order) for r in d_rows)
    out["values_match"] = s_vals == d_vals
    if not out["values_match"]:
        out["only_spark"] = list((s_vals - d_vals).elements())[:5]
        out["only_oracle"] = list((d_vals - s_vals).elements())[:5]
    out["ok"] = (out["columns_match"] and out["values_match"] and not out["types"]
                 and out["spark_rows"] == out["oracle_rows"])
    return out
