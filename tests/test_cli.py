"""The command-line run: summary, eleven tables, report append."""

from paddock.__main__ import main


def test_cli_run_and_insert(spark, sf_small, tmp_path, capsys):
    out = tmp_path / "analysis"
    code = main(["--driver-sf", sf_small, "--place", "3", "--turf", "--length", "1200",
                 "--going", "良", "--preset", "7", "--since", "1996-01-01 09:50:00",
                 "--insert", str(out)])
    assert code == 0
    text = capsys.readouterr().out
    assert "races:" in text and "runners:" in text
    assert text.count("-fukushima-turf-1200-good-") == 11
    assert spark.read.parquet(str(out)).count() == 7


def test_cli_prints_every_row(spark, tmp_path, capsys):
    """More than 200 jockeys: all are printed."""
    from fixture_tables import make_tables, race_row, result_row, write_tables

    races = [race_row(r) for r in range(1, 21)]
    results = [result_row(r, j, 1 + j % 5, jockey_id=j, horse_id=1) for r in range(1, 21) for j in range(1, 251)]
    root = str(tmp_path / "t")
    write_tables(make_tables(spark, races, results, [(r, 1, 1, 100) for r in range(1, 21)], horses=[1],
                             jockeys=[(j, f"jockey{j:03d}") for j in range(1, 251)]), root)
    assert main(["--tables", root, "--place", "3", "--turf", "--length", "1200", "--going", "良", "--preset", "7"]) == 0
    text = capsys.readouterr().out
    assert all(f"jockey{j:03d}" in text for j in range(1, 251))
