"""Small hand-made race tables for tests (the original program ships none)."""

from __future__ import annotations

import datetime as dt
import os
import random
from decimal import Decimal

from pyspark.sql import SparkSession

from paddock.schemas import TABLE_SCHEMAS
from paddock.sources.tables import PLACE_NAMES, RaceTables

DAY = dt.datetime(2015, 6, 1, 12, 0, 0)


def race_row(race_id, place_id=3, length=1200, race_type="芝", turf_cond="良", days=1,
             name="R", when=DAY, circling="右", terms="定量", race_rank="オープン"):
    return (race_id, place_id, length, race_type, turf_cond, days, name, when, circling, terms, race_rank)


def result_row(race_id, horse_no, arrival_order, seconds_3f=None, frame_no=None, seq=None,
               horse_id=None, jockey_id=None, popularity_order=None, horse_sex=None,
               horse_weight=None, horse_age=None, jokey_weight=None, corner4=None):
    seq = race_id * 100 + horse_no if seq is None else seq
    s3f = None if seconds_3f is None else Decimal(str(seconds_3f))
    jw = None if jokey_weight is None else Decimal(str(jokey_weight))
    return (seq, race_id, horse_no, horse_id, jockey_id, arrival_order, frame_no, popularity_order,
            horse_sex, horse_weight, horse_age, jw, corner4, s3f)


def make_tables(spark: SparkSession, races, results, refunds, horses=(), jockeys=()) -> RaceTables:
    def df(name, rows):
        return spark.createDataFrame(list(rows), TABLE_SCHEMAS[name])

    return RaceTables(
        race=df("race", races),
        result=df("result", results),
        refund=df("refund", refunds),
        horse=df("horse", [(h,) for h in horses]),
        jockey=df("jockey", jockeys),
        master_place=df("master_place", sorted(PLACE_NAMES.items())),
    )


def golden(spark: SparkSession) -> RaceTables:
    """FIXTURES.md section 3: two races, seven runners."""
    races = [race_row(1), race_row(2)]
    results = [
        result_row(1, 1, 1, 34.0, frame_no=1),
        result_row(1, 2, 2, 33.9, frame_no=1),
        result_row(1, 3, 3, 33.9, frame_no=2),
        result_row(1, 4, None, None, frame_no=2),
        result_row(2, 1, 4, 35.0, frame_no=1),
        result_row(2, 2, 1, 34.2, frame_no=2),
        result_row(2, 3, 2, 34.2, frame_no=3),
    ]
    refunds = [
        (1, 1, 1, 250), (1, 1, 2, 120), (1, 2, 2, 150), (1, 3, 2, 300),
        (2, 2, 1, 480), (2, 2, 2, 180), (2, 3, 2, 130),
    ]
    return make_tables(spark, races, results, refunds)


def random_tables(spark: SparkSession, seed: int, n_races: int = 40, hot_runners: int = 0) -> RaceTables:
    """Random races with the awkward cases: NULL / 0 finishes, NULL seq,
    tied and NULL times, duplicated payouts, ticket type 3, NULL payout
    amounts, missing horses and jockeys, namesake jockeys.  ``hot_runners``
    makes race 1 a hot key holding that many runners."""
    rnd = random.Random(seed)
    races, results, refunds = [], [], []
    times = [Decimal(x) / 10 for x in range(310, 372, 3)]
    for rid in range(1, n_races + 1):
        races.append(race_row(
            rid, place_id=rnd.choice([3, 5]), length=rnd.choice([1200, 1600]),
            race_type=rnd.choice(["芝", "ダ"]), turf_cond=rnd.choice(["良", "重"]),
            days=rnd.randint(1, 12), name=rnd.choice(["A", "B"]),
            when=DAY if (rid == 1 and hot_runners) else DAY + dt.timedelta(days=rnd.randint(-400, 400))))
        n = hot_runners if (rid == 1 and hot_runners) else rnd.choice([0, 3, 5, 8, 12])
        order = list(range(1, n + 1))
        rnd.shuffle(order)
        for h in range(1, n + 1):
            ao = order[h - 1]
            if rnd.random() < 0.1:
                ao = rnd.choice([None, 0])
            results.append(result_row(
                rid, h, ao,
                seconds_3f=None if rnd.random() < 0.1 else rnd.choice(times),
                frame_no=None if rnd.random() < 0.05 else 1 + (h - 1) // 2,
                seq=None if rnd.random() < 0.05 else rid * 100 + h,
                horse_id=rnd.randint(1, 60), jockey_id=rnd.randint(1, 12),
                popularity_order=rnd.randint(1, n), horse_sex=rnd.choice(["牡", "牝", "セ", None]),
                horse_weight=None if rnd.random() < 0.05 else rnd.randint(400, 540),
                horse_age=rnd.randint(2, 8), jokey_weight=rnd.choice([52, 54.5, 55, 57]),
                corner4=None if rnd.random() < 0.05 else rnd.randint(0, 16)))
            if ao == 1:
                refunds.append((rid, h, 1, rnd.randint(110, 5000)))
            if ao is not None and 1 <= ao <= 3:
                refunds.append((rid, h, 2, rnd.randint(100, 900)))
                if rnd.random() < 0.2:  # duplicated payout row
                    refunds.append((rid, h, 2, rnd.randint(100, 900)))
            if rnd.random() < 0.05:
                refunds.append((rid, h, 3, 1000))
            if rnd.random() < 0.03:
                refunds.append((rid, h, 1, None))
    # ids 5 and 6 appear twice in horse; jockey 3 has a second name, jockey 4
    # a repeated row and jockey 7 a NULL-name row: counted as inner joins would
    horses = [h for h in range(1, 61) if h % 13] + [5, 6]
    jockeys = [(j, f"J{min(j, 9)}") for j in range(1, 12)] + [(3, "J3b"), (4, "J4"), (7, None)]
    return make_tables(spark, races, results, refunds, horses, jockeys)


def write_tables(tables: RaceTables, root: str) -> None:
    for name in TABLE_SCHEMAS:
        getattr(tables, name).coalesce(1).write.parquet(os.path.join(root, name))


def duck_tables(root: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLE_SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}/*.parquet')")
    return con
