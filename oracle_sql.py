"""DuckDB oracle SQL for the registered queries.

Each statement derives the race tables from the driver's views with the
same formulas as ``paddock.sources.binding`` (FIXTURES.md section 4) and
then computes the query in the original per-side form: finish counts,
win-payout recovery and place-payout recovery are three separate
aggregations over the runners (the payout ones over runners left-joined to
their payouts), inner-joined on the dimension value.  The Spark plans
compute the same in one aggregation; agreement checks that rewrite.

Percentages use exact integer half-up rounding, in-race ranks put NULL
times first, rate ranks put NULL rates last.
"""

from __future__ import annotations

from dataclasses import dataclass

# Nothing is imported from the library: presets, keys, bucket edges, labels,
# headers and names are written out here, so a wrong value on either side shows.

# ---------------------------------------------------------------------------
# Racecourses, surfaces, goings, meeting-day presets, cut-offs.
# ---------------------------------------------------------------------------
PLACE_NAMES = {1: "札幌", 2: "函館", 3: "福島", 4: "新潟", 5: "東京",
               6: "中山", 7: "中京", 8: "京都", 9: "阪神", 10: "小倉"}
PLACE_ROMAJI = {1: "sapporo", 2: "hakodate", 3: "fukushima", 4: "niigata", 5: "tokyo",
                6: "nakayama", 7: "chukyo", 8: "kyoto", 9: "hanshin", 10: "kokura"}
SURFACE = {True: ("芝", "turf"), False: ("ダ", "dirt")}
GOING_EN = {"良": "good", "重": "bad", "稍重": "litle_bad"}
DAY_PRESETS = {1: (1, 2), 2: (3, 4), 3: (5, 6), 4: (7, 8), 5: (1, 2, 3, 4),
               6: (5, 6, 7, 8, 9, 10, 11, 12), 7: (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)}
TABLE_COLUMNS = ("着度数", "勝率", "連対率", "複勝率", "単回値", "複回値")
# ---------------------------------------------------------------------------

RAW, BUCKET, RACE_RANK, JOCKEY = "raw", "bucket", "race_rank", "jockey"


@dataclass(frozen=True)
class Dim:
    """A dimension as the statements need it: SQL of key and label written out."""

    name: str
    query: str
    slug: str
    column_ja: str
    header: str
    memo: str
    kind: str
    source: str
    key_type: str
    bucket: str = ""
    label: str = ""


# ---------------------------------------------------------------------------
# Query, key slug, display label, stored header, memo, bucket
# edges and labels of the dimensions.
# ---------------------------------------------------------------------------
DIMENSIONS = (
    Dim("frame_no", "by_frame_no", "wakuban", "枠番", "枠番", "枠番別成績", RAW, "frame_no", "int"),
    Dim("horse_no", "by_horse_no", "umaban", "馬番", "馬番", "馬番別成績", RAW, "horse_no", "int"),
    Dim("popularity_order", "by_popularity", "ninnki", "人気順", "人気", "人気順成績", RAW, "popularity_order", "int"),
    Dim("horse_sex", "by_horse_sex", "seibetu", "性別", "性別", "性別別成績", RAW, "horse_sex", "string"),
    Dim("leg_type", "by_leg_type", "kyakusitu", "脚質", "脚質", "脚質別成績", BUCKET, "corner4", "int",
        "CASE WHEN {c} = 1 THEN 1 WHEN {c} BETWEEN 2 AND 6 THEN 2 WHEN {c} BETWEEN 7 AND 14 THEN 3 WHEN {c} >= 14 THEN 4 END",
        "CASE {k} WHEN 1 THEN '逃げ' WHEN 2 THEN '先行' WHEN 3 THEN '差し' WHEN 4 THEN '追込' END"),
    Dim("horse_weight", "by_horse_weight", "bataijuu", "馬体重", "馬体重", "馬体重別成績", BUCKET, "horse_weight", "int",
        "CASE WHEN {c} < 420 THEN 1 WHEN {c} BETWEEN 420 AND 439 THEN 2 WHEN {c} BETWEEN 440 AND 459 THEN 3 "
        "WHEN {c} BETWEEN 460 AND 479 THEN 4 WHEN {c} BETWEEN 480 AND 499 THEN 5 WHEN {c} BETWEEN 500 AND 519 THEN 6 "
        "WHEN {c} >= 520 THEN 7 END",
        "CASE {k} WHEN 1 THEN '~ 419kg' WHEN 2 THEN '420kg ~ 439kg' WHEN 3 THEN '440kg ~459kg' WHEN 4 THEN '460kg ~ 479kg' "
        "WHEN 5 THEN '480kg ~ 499kg' WHEN 6 THEN '500kg ~ 519kg' WHEN 7 THEN '520kg ~ ' END"),
    Dim("horse_age", "by_horse_age", "barei", "馬齢", "馬齢", "馬齢別成績", RAW, "horse_age", "int"),
    Dim("jokey_weight", "by_carried_weight", "kinryo", "斤量", "斤量", "斤量別成績", RAW, "jokey_weight", "decimal(4,1)"),
    Dim("seconds_3f", "by_seconds_3f", "last3f", "3Fタイム", "3Fタイム", "上がり3Fタイム別成績", BUCKET, "seconds_3f", "int",
        "CASE WHEN {c} BETWEEN 31.5 AND 31.9 THEN 1 WHEN {c} BETWEEN 32.0 AND 32.4 THEN 2 WHEN {c} BETWEEN 32.5 AND 32.9 THEN 3 "
        "WHEN {c} BETWEEN 33.0 AND 33.4 THEN 4 WHEN {c} BETWEEN 33.5 AND 33.9 THEN 5 WHEN {c} BETWEEN 34.0 AND 34.4 THEN 6 "
        "WHEN {c} BETWEEN 34.5 AND 34.9 THEN 7 WHEN {c} BETWEEN 35.0 AND 35.4 THEN 8 WHEN {c} BETWEEN 35.5 AND 35.9 THEN 9 "
        "WHEN {c} >= 36.0 THEN 10 END",
        "CASE {k} WHEN 1 THEN '31.5 ~ 31.9' WHEN 2 THEN '32.0 ~ 32.4' WHEN 3 THEN '32.5 ~ 32.9' WHEN 4 THEN '33.0 ~ 33.4' "
        "WHEN 5 THEN '33.5 ~ 33.9' WHEN 6 THEN '34.0 ~  34.4' WHEN 7 THEN '34.5 ~ 34.9' WHEN 8 THEN '35.0 ~ 35.4' "
        "WHEN 9 THEN '35.5 ~ 35.9' WHEN 10 THEN '36.0 ~' END"),
    Dim("seconds_3f_rank", "by_seconds_3f_rank", "3f_rank", "3F速さ順位", "3F速さ順位", "3F速さ順位", RACE_RANK, "seconds_3f", "int"),
    Dim("jockey", "by_jockey", "jockey", "騎手", "騎手", "騎手別", JOCKEY, "jockey_id", "string"),
)
# The dimensions that a run stores, in order.
INSERTED = ("frame_no", "horse_no", "horse_weight", "popularity_order", "leg_type", "seconds_3f", "seconds_3f_rank")


def dimension(name) -> Dim:
    """By name; a library dimension (tests pass them) gives its own entry here."""
    name = getattr(name, "name", name)
    return next(d for d in DIMENSIONS if d.name == name)


def table_header(dim: Dim) -> list[str]:
    return [dim.header, *TABLE_COLUMNS]


@dataclass(frozen=True)
class Selection:
    """The races of a statement and the course fields of its keys."""

    place_id: int
    is_turf: bool
    length: int
    turf_cond: str
    days: tuple
    cutoff: str
    grade_race: str | None = None
    months: tuple | None = None
    name_contains: str | None = None
    terms: str | None = None
    race_rank: str | None = None

    @property
    def race_type(self) -> str:
        return SURFACE[self.is_turf][0]

    @property
    def days_str(self) -> str:
        return "-".join(map(str, self.days))

    def analysis_key(self, slug: str) -> str:
        return f"{slug}-{PLACE_ROMAJI[self.place_id]}-{SURFACE[self.is_turf][1]}-{self.length}-{GOING_EN[self.turf_cond]}-{self.days_str}"


# The selections of the registered queries.
CHECK_SINCE = "1996-01-01 09:50:00"
_ALL_DAYS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)
CHECK_COURSE = Selection(3, True, 1200, "良", _ALL_DAYS, CHECK_SINCE)
CHECK_GRADED = Selection(3, True, 1200, "良", _ALL_DAYS, CHECK_SINCE, grade_race="URGENT")
CHECK_COURSE_OPT = Selection(3, True, 1200, "良", _ALL_DAYS, CHECK_SINCE, months=(1, 2, 3, 4, 5, 6), race_rank="オープン")
CHECK_COURSE_TERMS = Selection(3, True, 1200, "良", _ALL_DAYS, CHECK_SINCE, name_contains="URGENT", terms="ハンデ")
CHECK_NO_RACE = Selection(3, True, 1200, "良", _ALL_DAYS, CHECK_SINCE, grade_race="NO SUCH RACE")

BINDING = """
race AS (
  SELECT o_orderkey AS race_id,
         CAST(1 + o_custkey % 10 AS INTEGER) AS place_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 1200 WHEN o_orderkey % 3 = 1 THEN 1600 ELSE 1800 END AS length,
         CASE WHEN CAST(FLOOR(o_totalprice) AS BIGINT) % 2 = 0 THEN '芝' ELSE 'ダ' END AS race_type,
         CASE o_orderstatus WHEN 'F' THEN '良' WHEN 'O' THEN '重' ELSE '稍重' END AS turf_cond,
         CAST(1 + (o_orderkey + o_custkey) % 12 AS INTEGER) AS days,
         o_orderpriority AS name,
         o_orderdate AS date_and_time,
         CASE WHEN o_custkey % 2 = 0 THEN '右' ELSE '左' END AS circling,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'ハンデ' ELSE '定量' END AS terms,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'オープン' ELSE '1勝クラス' END AS race_rank
  FROM orders
),
result AS (
  SELECT l_orderkey * 8 + l_linenumber AS seq,
         l_orderkey AS race_id,
         CAST(l_linenumber AS INTEGER) AS horse_no,
         l_partkey AS horse_id,
         l_suppkey AS jockey_id,
         CASE WHEN l_tax = 0 THEN NULL
              ELSE CAST(RANK() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS INTEGER) END
           AS arrival_order,
         CAST(1 + (l_linenumber + l_suppkey) % 8 AS INTEGER) AS frame_no,
         CAST(1 + l_partkey % 18 AS INTEGER) AS popularity_order,
         l_returnflag AS horse_sex,
         CAST(400 + 3 * l_quantity AS INTEGER) AS horse_weight,
         CAST(2 + l_partkey % 7 AS INTEGER) AS horse_age,
         CAST(50 + (l_suppkey % 16) * 0.5 AS DECIMAL(4,1)) AS jokey_weight,
         CAST(1 + (l_suppkey + l_linenumber) % 18 AS INTEGER) AS corner4,
         CASE WHEN l_tax = 0 THEN NULL ELSE CAST((310 + l_partkey % 60) / 10.0 AS DECIMAL(4,1)) END
           AS seconds_3f
  FROM lineitem
),
refund AS (
  SELECT race_id, horse_no, ticket_type, CAST(MAX(refund) AS BIGINT) AS refund
  FROM (
    SELECT race_id, horse_no, 1 AS ticket_type, 110 + (horse_id * 37) % 1900 AS refund
    FROM result WHERE arrival_order = 1
    UNION ALL
    SELECT race_id, horse_no, 2 AS ticket_type, 100 + (horse_id * 17) % 400 AS refund
    FROM result WHERE arrival_order <= 3
  ) t
  GROUP BY race_id, horse_no, ticket_type
),
horse AS (SELECT p_partkey AS id FROM part),
jockey AS (
  SELECT s_suppkey AS id, 'J' || CAST(CAST(FLOOR(SQRT(s_suppkey)) AS INTEGER) AS VARCHAR) AS name
  FROM supplier
),
master_place AS (
  SELECT * FROM (VALUES {PLACES}) t(id, name)
)""".replace("{PLACES}", ", ".join(f"({k}, '{v}')" for k, v in sorted(PLACE_NAMES.items())))

DUCK_TYPES = {"int": "INTEGER", "string": "VARCHAR", "decimal(4,1)": "DECIMAL(4,1)"}


def with_binding(*ctes: str, binding: bool = True) -> str:
    """WITH clause: the binding CTEs (unless the race tables already exist) + ``ctes``."""
    parts = ([BINDING.strip()] if binding else []) + list(ctes)
    return ("WITH " + ",\n".join(parts) + "\n") if parts else ""


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def race_pred(c: Selection) -> str:
    after = f"date_and_time > TIMESTAMP {q(c.cutoff)}"
    if c.grade_race is not None:
        return f"contains(name, {q(c.grade_race)}) AND {after}"
    preds = [f"place_id = {c.place_id}", f"length = {c.length}", f"race_type = {q(c.race_type)}",
             after, f"turf_cond = {q(c.turf_cond)}", f"days IN ({', '.join(map(str, c.days))})"]
    if c.months:
        preds.append(f"month(date_and_time) IN ({', '.join(map(str, c.months))})")
    if c.name_contains is not None:
        preds.append(f"contains(name, {q(c.name_contains)})")
    if c.terms is not None:
        preds.append(f"terms = {q(c.terms)}")
    if c.race_rank is not None:
        preds.append(f"race_rank = {q(c.race_rank)}")
    return " AND ".join(preds)


def key_sql(dim: Dim, alias: str = "re", partition: str = "re.race_id") -> str:
    col = f"{alias}.{dim.source}"
    if dim.kind == BUCKET:
        return dim.bucket.format(c=col)
    if dim.kind == JOCKEY:
        return "j.name"
    if dim.kind == RACE_RANK:
        return f"RANK() OVER (PARTITION BY {partition} ORDER BY {col} ASC NULLS FIRST)"
    return col


def label_sql(dim: Dim, key: str = "k") -> str:
    if dim.kind == BUCKET:
        return dim.label.format(k=key)
    return f"CAST({key} AS VARCHAR)"


def pct(num: str, den: str, scale: int) -> str:
    t = f"((CAST({2 * scale} AS BIGINT) * {num} + {den}) // (2 * {den}))"
    return (f"CASE WHEN {den} > 0 THEN format('{{:,}}', {t} // 10) || '.' || "
            f"CAST({t} % 10 AS VARCHAR) || '%' END")


def side_ctes(prefix: str, base: str, key: str, extra: str = "", group_extra: str = "") -> list[str]:
    """count / win / place aggregations of ``base`` rows keyed by ``key``."""
    sel_extra = f"{extra}, " if extra else ""
    grp = f"{group_extra}, " if group_extra else ""
    ctes = [
        f"{prefix}cnt_src AS (SELECT {sel_extra}{key} AS k, re.arrival_order, re.seq FROM {base})",
        f"""{prefix}cnt AS (
  SELECT {grp}k,
         COUNT(CASE WHEN arrival_order = 1 THEN seq END) AS no1,
         COUNT(CASE WHEN arrival_order = 2 THEN seq END) AS no2,
         COUNT(CASE WHEN arrival_order = 3 THEN seq END) AS no3,
         COUNT(CASE WHEN arrival_order > 3 THEN seq END) AS no4
  FROM {prefix}cnt_src GROUP BY {grp}k)""",
    ]
    for side, ticket in (("win", 1), ("plc", 2)):
        ctes.append(
            f"{prefix}{side}_src AS (SELECT {sel_extra}{key} AS k, rf.refund FROM {base} "
            f"LEFT JOIN refund rf ON rf.race_id = re.race_id AND rf.horse_no = re.horse_no "
            f"AND rf.ticket_type = {ticket})")
        ctes.append(
            f"{prefix}{side} AS (SELECT {grp}k, CAST(SUM(refund) AS BIGINT) AS money, COUNT(*) AS n "
            f"FROM {prefix}{side}_src GROUP BY {grp}k)")
    on = " AND ".join([f"c.{g.strip()} = {{s}}.{g.strip()}" for g in group_extra.split(",") if g.strip()]
                      + ["c.k = {s}.k"])
    ctes.append(f"""{prefix}j AS (
  SELECT c.*, c.no1 + c.no2 + c.no3 + c.no4 AS total,
         w.money AS w_money, w.n AS w_n, p.money AS p_money, p.n AS p_n
  FROM {prefix}cnt c
  JOIN {prefix}win w ON {on.format(s='w')}
  JOIN {prefix}plc p ON {on.format(s='p')})""")
    return ctes


def metrics_sql(partition: str = "") -> str:
    over = f"PARTITION BY {partition} " if partition else ""
    rank = lambda num: (f"CAST(RANK() OVER ({over}ORDER BY CAST({num} AS DOUBLE) / NULLIF(total, 0) "
                        f"DESC NULLS LAST) AS INTEGER)")
    return f"""
  CAST(no1 AS VARCHAR) || '-' || CAST(no2 AS VARCHAR) || '-' || CAST(no3 AS VARCHAR) || '-' ||
    CAST(no4 AS VARCHAR) || '/' || CAST(total AS VARCHAR) AS record,
  {pct('no1', 'total', 1000)} AS win_rate_pct,
  {pct('(no1 + no2)', 'total', 1000)} AS rentai_rate_pct,
  {pct('(no1 + no2 + no3)', 'total', 1000)} AS fukusho_rate_pct,
  {rank('no1')} AS win_rate_ranking,
  {rank('(no1 + no2)')} AS rentai_rate_ranking,
  {rank('(no1 + no2 + no3)')} AS fukusho_rate_ranking,
  {pct('w_money', 'w_n', 10)} AS win_recovery_rate,
  {pct('p_money', 'p_n', 10)} AS d_win_recovery_rate,
  CASE WHEN w_money >= 100 * w_n THEN 1 ELSE 0 END AS win_recovery_100_over,
  CASE WHEN p_money >= 100 * p_n THEN 1 ELSE 0 END AS d_win_recovery_100_over"""


def _base(dim: Dim, races: str) -> str:
    base = f"result re JOIN {races} USING (race_id)"
    if dim.kind == JOCKEY:
        base += " JOIN horse h ON re.horse_id = h.id JOIN jockey j ON re.jockey_id = j.id"
    return base


def breakdown_ctes(c: Selection, dim: Dim) -> list[str]:
    return [f"sel AS (SELECT race_id FROM race WHERE {race_pred(c)})",
            *side_ctes("", _base(dim, "sel"), key_sql(dim))]


def breakdown_sql(c: Selection, dim: Dim, min_jockey_finishes: int = 20,
                  binding: bool = True) -> str:
    dim = dimension(dim)
    body = (f"SELECT CAST(k AS {DUCK_TYPES[dim.key_type]}) AS dim_key, {label_sql(dim)} AS dim_value,"
            f"{metrics_sql()}")
    if dim.kind == JOCKEY:
        body += ",\n  CAST(total AS BIGINT) AS total_count"
    sql = with_binding(*breakdown_ctes(c, dim), binding=binding) + body + "\nFROM j WHERE k IS NOT NULL"
    if dim.kind == JOCKEY:
        sql = f"SELECT * FROM ({sql}) t WHERE total_count >= {min_jockey_finishes}"
    return sql


def over_breakdown(c: Selection, dim: Dim, select: str) -> str:
    return f"SELECT {select} FROM ({breakdown_sql(c, dim)}) b"


# -- fine-grained operators -------------------------------------------------

def arrival_counts_sql(c: Selection, dim: Dim) -> str:
    return (with_binding(*breakdown_ctes(c, dim)) +
            f"SELECT CAST(k AS {DUCK_TYPES[dim.key_type]}) AS dim_key, no1, no2, no3, no4, "
            f"no1 + no2 + no3 + no4 AS total_count FROM cnt")


def recovery_sql(c: Selection, dim: Dim, side: str) -> str:
    name = "win_recovery" if side == "win" else "d_win_recovery"
    return (with_binding(*breakdown_ctes(c, dim)) +
            f"SELECT CAST(k AS {DUCK_TYPES[dim.key_type]}) AS dim_key, n AS runners, money AS payout, "
            f"{pct('money', 'n', 10)} AS {name}_rate, "
            f"CASE WHEN money >= 100 * n THEN 1 ELSE 0 END AS {name}_100_over FROM {side}")


def rank_3f_sql() -> str:
    return (with_binding() +
            "SELECT re.race_id, re.horse_no, re.seq, re.seconds_3f, "
            "CAST(RANK() OVER (PARTITION BY re.race_id ORDER BY re.seconds_3f ASC NULLS FIRST) AS INTEGER) "
            "AS seconds_3f_rank FROM result re JOIN race USING (race_id)")


def colours_select() -> str:
    def rank_colour(col):
        return f"CASE {col} WHEN 1 THEN 'yellow' WHEN 2 THEN 'blue' WHEN 3 THEN 'red' END"

    return (f"dim_key, {rank_colour('win_rate_ranking')} AS win_rate_color, "
            f"{rank_colour('rentai_rate_ranking')} AS rentai_rate_color, "
            f"{rank_colour('fukusho_rate_ranking')} AS fukusho_rate_color, "
            "CASE WHEN win_recovery_100_over = 1 THEN 'yellow' END AS win_recovery_color, "
            "CASE WHEN d_win_recovery_100_over = 1 THEN 'yellow' END AS d_win_recovery_color")


def display_select(dim: Dim) -> str:
    label = "dim_value" if dim.kind == BUCKET else "dim_key"
    return (f'{label} AS "{dim.column_ja}", record AS "着度数", win_rate_pct AS "勝率", '
            'rentai_rate_pct AS "連対率", fukusho_rate_pct AS "複勝率", '
            'win_recovery_rate AS "単回値", d_win_recovery_rate AS "複回値"')


def _card_text(alias: str = "") -> str:
    def show(c):
        return f"coalesce(CAST({alias}{c} AS VARCHAR), 'None')"

    return ("'開催場所: ' || " + show("place_name") + " || '競馬場' || chr(10) || '距離: ' || "
            + show("length") + " || chr(10) || 'コース: ' || " + show("race_type")
            + " || chr(10) || '周り: ' || " + show("circling") + " || chr(10) || '条件: ' || "
            + show("terms") + " || chr(10)")


def course_card_sql(c: Selection) -> str:
    return (with_binding(f"""latest AS (
  SELECT mp.name AS place_name, r.length, r.race_type, r.circling, r.terms
  FROM race r JOIN master_place mp ON r.place_id = mp.id
  WHERE contains(r.name, {q(c.grade_race)})
  ORDER BY r.date_and_time DESC, r.race_id DESC
  LIMIT 1)""") + f"SELECT place_name, length, race_type, circling, terms, {_card_text()} AS course FROM latest")


def summary_sql(c: Selection) -> str:
    card = (f"(SELECT course FROM ({course_card_sql(c)}) cc)" if c.grade_race is not None else "''")
    return (with_binding(f"sel AS (SELECT race_id FROM race WHERE {race_pred(c)})") +
            f"SELECT coalesce({card}, '') AS course, "
            "(SELECT COUNT(*) FROM sel) AS target_race, "
            "(SELECT COUNT(*) FROM sel JOIN result USING (race_id)) AS target_horse")


# -- JSON payloads ------------------------------------------------------------

def payload_json_sql(dim: Dim, source: str, group: str = "") -> str:
    """``group`` columns + ``data`` JSON built from a breakdown subquery."""
    label = "dim_value" if dim.kind == BUCKET else "dim_key"

    def rank_colour(col):
        return f"CASE {col} WHEN 1 THEN 'yellow' WHEN 2 THEN 'blue' WHEN 3 THEN 'red' END"

    cells = [
        (dim.column_ja, label, "NULL"),
        ("着度数", "record", "NULL"),
        ("勝率", "win_rate_pct", rank_colour("win_rate_ranking")),
        ("連対率", "rentai_rate_pct", rank_colour("rentai_rate_ranking")),
        ("複勝率", "fukusho_rate_pct", rank_colour("fukusho_rate_ranking")),
        ("単回値", "win_recovery_rate", "CASE WHEN win_recovery_100_over = 1 THEN 'yellow' END"),
        ("複回値", "d_win_recovery_rate", "CASE WHEN d_win_recovery_100_over = 1 THEN 'yellow' END"),
    ]
    row = "json_object(" + ", ".join(
        f"{q(name)}, json_object('value', {val}, 'schema', {colour})" for name, val, colour in cells) + ")"
    order = "win_rate_ranking, dim_key" if dim.kind == JOCKEY else "dim_key"
    header = "json_array(" + ", ".join(q(h) for h in table_header(dim)) + ")"
    data = (f"CAST(json_object('table_header', {header}, 'data', "
            f"coalesce(to_json(list({row} ORDER BY {order})), json_array())) AS VARCHAR)")
    if group:
        return f"SELECT {group}, {data} AS data FROM ({source}) b GROUP BY {group}"
    return f"SELECT {data} AS data FROM ({source}) b"


def analysis_rows_sql(c: Selection, dims, min_jockey_finishes: int = 20, binding: bool = True) -> str:
    parts = []
    for d in map(dimension, dims):
        parts.append(
            f"SELECT {q(c.analysis_key(d.slug))} AS analysis_key, CAST({c.place_id} AS INTEGER) AS place_id, "
            f"CAST({c.length} AS INTEGER) AS length, {q(d.memo)} AS memo, {q(c.turf_cond)} AS turf_cond, "
            f"{q(c.race_type)} AS race_type, {q(c.days_str)} AS days, data "
            f"FROM ({payload_json_sql(d, breakdown_sql(c, d, min_jockey_finishes, binding))}) p")
    return "\nUNION ALL\n".join(parts)


# -- all courses ----------------------------------------------------------------

COURSE = "place_id, race_type, length, turf_cond, preset"


def breakdown_all_sql(c: Selection) -> str:
    """All dimensions, told apart by slug."""
    parts = []
    for i, d in enumerate(DIMENSIONS):
        order = "CAST(b.dim_key AS DECIMAL(12,1))" if d.key_type != "string" else "CAST(NULL AS DECIMAL(12,1))"
        total = "total_count" if d.kind == JOCKEY else "CAST(split_part(record, '/', 2) AS BIGINT)"
        parts.append(f"SELECT {q(d.slug)} AS dim, CAST(b.dim_key AS VARCHAR) AS dim_key, {order} AS key_order, dim_value, record, "
                     f"win_rate_pct, rentai_rate_pct, fukusho_rate_pct, win_rate_ranking, rentai_rate_ranking, fukusho_rate_ranking, "
                     f"win_recovery_rate, d_win_recovery_rate, win_recovery_100_over, d_win_recovery_100_over, {total} AS total_count "
                     f"FROM ({breakdown_sql(c, d)}) b")
    return "\nUNION ALL\n".join(parts)


def highlight_sql(c: Selection, dim: Dim) -> str:
    """Cells as JSON text: {value, schema}."""
    def cell(value, colour="NULL"):
        return f"CAST(json_object('value', {value}, 'schema', {colour}) AS VARCHAR)"

    def by_rank(col):
        return f"CASE {col} WHEN 1 THEN 'yellow' WHEN 2 THEN 'blue' WHEN 3 THEN 'red' END"

    def over(col):
        return f"CASE WHEN {col} = 1 THEN 'yellow' END"

    return over_breakdown(c, dim, (
        f'dim_key, {cell("dim_value" if dim.kind == BUCKET else "dim_key")} AS "{dim.column_ja}", {cell("record")} AS "着度数", '
        f'{cell("win_rate_pct", by_rank("win_rate_ranking"))} AS "勝率", {cell("rentai_rate_pct", by_rank("rentai_rate_ranking"))} AS "連対率", '
        f'{cell("fukusho_rate_pct", by_rank("fukusho_rate_ranking"))} AS "複勝率", '
        f'{cell("win_recovery_rate", over("win_recovery_100_over"))} AS "単回値", {cell("d_win_recovery_rate", over("d_win_recovery_100_over"))} AS "複回値"'))


def all_courses_sql(since: str, dims=DIMENSIONS, min_jockey_finishes: int = 20,
                    binding: bool = True) -> str:
    presets = ", ".join(f"({p}, [{', '.join(map(str, ds))}])" for p, ds in sorted(DAY_PRESETS.items()))
    ctes = [
        f"r AS (SELECT race_id, place_id, race_type, length, turf_cond, days FROM race "
        f"WHERE date_and_time > TIMESTAMP {q(since)})",
        f"presets AS (SELECT * FROM (VALUES {presets}) t(preset, pdays))",
        "rp AS (SELECT r.*, p.preset FROM r JOIN presets p ON list_contains(p.pdays, r.days))",
    ]
    selects = []
    cols = ", ".join(f"rp.{c.strip()}" for c in COURSE.split(","))
    for i, d in enumerate(dims):
        key = key_sql(d, partition="re.race_id, rp.preset")
        ctes += side_ctes(f"d{i}_", _base(d, "rp"), key, extra=cols, group_extra=COURSE)
        order = (f"CAST(k AS DECIMAL(12,1))" if d.key_type != "string" else "CAST(NULL AS DECIMAL(12,1))")
        sel = (f"SELECT {COURSE}, {q(d.slug)} AS dim, CAST(k AS VARCHAR) AS dim_key, {order} AS key_order, "
               f"{label_sql(d)} AS dim_value,{metrics_sql(COURSE)},\n  CAST(total AS BIGINT) AS total_count "
               f"FROM d{i}_j WHERE k IS NOT NULL")
        if d.kind == JOCKEY:
            sel = f"SELECT * FROM ({sel}) t WHERE total_count >= {min_jockey_finishes}"
        selects.append(sel)
    return (with_binding(*ctes, binding=binding)
            + "\nUNION ALL\n".join(f"SELECT * FROM ({s}) x{i}" for i, s in enumerate(selects)))


def all_courses_reports_sql(since: str, dims) -> str:
    place = "CASE place_id " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in sorted(PLACE_ROMAJI.items())) + " END"
    surface = "CASE race_type " + " ".join(f"WHEN {q(ja)} THEN {q(en)}" for ja, en in SURFACE.values()) + " END"
    going = "CASE turf_cond " + " ".join(f"WHEN {q(ja)} THEN {q(en)}" for ja, en in GOING_EN.items()) + " END"
    days = "CASE preset " + " ".join(f"WHEN {p} THEN {q('-'.join(map(str, ds)))}"
                                     for p, ds in sorted(DAY_PRESETS.items())) + " END"
    nameable = (f"place_id IN ({', '.join(map(str, sorted(PLACE_ROMAJI)))}) "
                f"AND race_type IN ({', '.join(q(ja) for ja, _ in SURFACE.values())}) "
                f"AND turf_cond IN ({', '.join(q(ja) for ja in GOING_EN)})")
    presets = ", ".join(f"({p}, [{', '.join(map(str, ds))}])" for p, ds in sorted(DAY_PRESETS.items()))
    # every (course, preset) with a race after the cut-off
    grid = with_binding(f"presets AS (SELECT * FROM (VALUES {presets}) t(preset, pdays))") + (
        f"SELECT DISTINCT r.place_id, r.race_type, r.length, r.turf_cond, p.preset "
        f"FROM race r JOIN presets p ON list_contains(p.pdays, r.days) "
        f"WHERE r.date_and_time > TIMESTAMP {q(since)} AND {nameable.replace('place_id', 'r.place_id').replace('race_type', 'r.race_type').replace('turf_cond', 'r.turf_cond')}")
    parts = []
    for d in dims:
        src = (f"SELECT * REPLACE (CAST(dim_key AS {DUCK_TYPES[d.key_type]}) AS dim_key) "
               f"FROM ({all_courses_sql(since, [d])}) a WHERE {nameable}")
        header = "json_array(" + ", ".join(q(h) for h in table_header(d)) + ")"
        empty = f"""'{{"table_header":' || CAST({header} AS VARCHAR) || ',"data":[]}}'"""
        parts.append(
            f"SELECT {q(d.slug)} || '-' || {place} || '-' || {surface} || '-' || CAST(length AS VARCHAR) "
            f"|| '-' || {going} || '-' || {days} AS analysis_key, place_id, length, {q(d.memo)} AS memo, "
            f"turf_cond, race_type, {days} AS days, coalesce(p.data, {empty}) AS data "
            f"FROM ({grid}) g LEFT JOIN ({payload_json_sql(d, src, COURSE)}) p "
            f"USING (place_id, race_type, length, turf_cond, preset)")
    return "\nUNION ALL\n".join(parts)


# -- registry -----------------------------------------------------------------

def oracle_statements() -> dict[str, str]:
    out = {}
    for d in DIMENSIONS:
        out[d.query] = breakdown_sql(CHECK_COURSE, d)
    for name in ("seconds_3f_rank", "jockey", "leg_type"):
        d = dimension(name)
        out["graded_" + d.query] = breakdown_sql(CHECK_GRADED, d)
    out["course_races"] = with_binding() + f"SELECT * FROM race WHERE {race_pred(CHECK_COURSE)}"
    out["course_races_opt"] = with_binding() + f"SELECT * FROM race WHERE {race_pred(CHECK_COURSE_OPT)}"
    out["graded_races"] = with_binding() + f"SELECT * FROM race WHERE {race_pred(CHECK_GRADED)}"
    out["count_race"] = (with_binding() +
                         f"SELECT COUNT(*) AS target_race FROM race WHERE {race_pred(CHECK_COURSE)}")
    out["count_horse"] = (with_binding() + "SELECT COUNT(*) AS target_race FROM race JOIN result "
                          f"USING (race_id) WHERE {race_pred(CHECK_COURSE)}")
    out["arrival_counts"] = arrival_counts_sql(CHECK_COURSE, dimension("seconds_3f"))
    out["win_recovery"] = recovery_sql(CHECK_COURSE, dimension("leg_type"), "win")
    out["place_recovery"] = recovery_sql(CHECK_COURSE, dimension("horse_weight"), "plc")
    out["rate_ranks"] = over_breakdown(
        CHECK_COURSE, dimension("horse_weight"),
        "dim_key, win_rate_pct, rentai_rate_pct, fukusho_rate_pct, win_rate_ranking, "
        "rentai_rate_ranking, fukusho_rate_ranking")
    out["rank_3f_in_race"] = rank_3f_sql()
    out["course_all_dims"] = breakdown_all_sql(CHECK_COURSE)
    out["course_races_terms"] = with_binding() + f"SELECT * FROM race WHERE {race_pred(CHECK_COURSE_TERMS)}"
    out["course_summary_course"] = summary_sql(CHECK_COURSE)
    out["highlight_structs"] = highlight_sql(CHECK_COURSE, dimension("leg_type"))
    out["highlight_cells"] = over_breakdown(CHECK_COURSE, dimension("frame_no"), colours_select())
    out["display_popularity"] = over_breakdown(CHECK_COURSE, dimension("popularity_order"),
                                               display_select(dimension("popularity_order")))
    out["display_jockey"] = over_breakdown(CHECK_GRADED, dimension("jockey"),
                                           display_select(dimension("jockey")))
    out["analysis_payload"] = payload_json_sql(dimension("popularity_order"),
                                               breakdown_sql(CHECK_COURSE, dimension("popularity_order")))
    out["analysis_rows"] = analysis_rows_sql(CHECK_COURSE, [dimension(n) for n in INSERTED])
    out["grade_race_course"] = course_card_sql(CHECK_GRADED)
    out["course_summary"] = summary_sql(CHECK_GRADED)
    out["course_summary_no_race"] = summary_sql(CHECK_NO_RACE)
    out["all_courses_breakdown"] = all_courses_sql(CHECK_SINCE)
    out["all_courses_reports"] = all_courses_reports_sql(CHECK_SINCE, [dimension(n) for n in INSERTED])
    return out
