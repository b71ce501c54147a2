"""Ranks of rates: pieces equal the window, whatever the ties and the spread."""

import random

import pytest

from paddock.operators import rate_rank as R

RATES = {"first": ("a", "n"), "second": ("b", "n")}


def table(spark, seed, n=900):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        total = r.choice([0, 1, 2, 3, 20, 1025, 10**6 + i])
        rows.append((i % 3 or None, i, r.choice([0, 0, r.randint(0, total)]), r.randint(0, total), total))
    return spark.createDataFrame(rows, "grp int, name long, a long, b long, n long")


@pytest.mark.parametrize(("seed", "pieces"), [(1, 1024), (2, 1), (3, 7), (4, 100_000)])
def test_pieces_equal_the_window(spark, monkeypatch, seed, pieces):
    monkeypatch.setattr(R, "PIECES", pieces)
    df = table(spark, seed)
    by_window = R.window_ranks(df, ("grp",), RATES)
    by_piece = R.piece_ranks(df, ("grp",), "name", RATES)
    assert by_piece.dtypes == by_window.dtypes
    assert sorted(map(str, by_piece.collect())) == sorted(map(str, by_window.collect()))
    assert R.piece_ranks(df.limit(0), ("grp",), "name", RATES).collect() == []


def test_no_window_over_a_whole_group(spark):
    plan = R.piece_ranks(table(spark, 5), ("grp",), "name", RATES)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_piece" in line for line in windows)
