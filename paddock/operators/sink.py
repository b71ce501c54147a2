"""The analysis sink: report rows appended to a table or folder."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.schemas import ANALYSIS

log = logging.getLogger(__name__)


def analysis_frame(df: DataFrame) -> DataFrame:
    """Project to the eight columns of the analysis table, in order."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in ANALYSIS.fields])


def write_analysis(df: DataFrame, path: str | None = None, table: str | None = None,
                   fmt: str = "parquet", mode: str = "append") -> bool:
    """Append report rows; True on success, False when the write fails.

    The reports (a row per dimension) are computed first: an error in
    computing them is raised, only write errors give False.  All reports of a
    run go out in one write (one job, one commit), so a failed run leaves no
    partial set behind.  Task retries after a lost executor are handled by
    Spark's output committer.
    """
    if table is None and path is None:
        raise ValueError("write_analysis needs a path or a table")
    rows = analysis_frame(df).persist()
    try:
        rows.count()
        try:
            writer = rows.write.mode(mode).format(fmt)
            if table is not None:
                writer.saveAsTable(table)
            else:
                writer.save(path)
            return True
        except Exception as exc:  # write errors are reported, not raised
            log.error("analysis insert failed: %s", exc)
            return False
    finally:
        rows.unpersist()
