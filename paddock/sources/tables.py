"""The six input tables and their readers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, StructField, StructType

from paddock.operators.joins import dealt
from paddock.schemas import TABLE_SCHEMAS

# ---------------------------------------------------------------------------
# Racecourse ids and names (master_place), and the romaji
# names used inside analysis keys.
# ---------------------------------------------------------------------------
PLACE_NAMES = {1: "札幌", 2: "函館", 3: "福島", 4: "新潟", 5: "東京",
               6: "中山", 7: "中京", 8: "京都", 9: "阪神", 10: "小倉"}
PLACE_ROMAJI = {1: "sapporo", 2: "hakodate", 3: "fukushima", 4: "niigata", 5: "tokyo",
                6: "nakayama", 7: "chukyo", 8: "kyoto", 9: "hanshin", 10: "kokura"}
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class RaceTables:
    """Lazy DataFrames of the race schema (see ``paddock.schemas``).

    ``results_of`` optionally gives the result rows of a set of races (a
    DataFrame of ``race_id``) more cheaply than joining the whole table --
    when ``result`` is itself derived per race.  ``dealt_by_race`` optionally
    gives ``result`` dealt by race in a number of parts (``joins.dealt``) and the
    ``refund`` that goes with it more cheaply than dealing the whole table -- when
    both are derived from the same rows.
    """

    race: DataFrame
    result: DataFrame
    refund: DataFrame
    horse: DataFrame
    jockey: DataFrame
    master_place: DataFrame
    results_of: Callable[[DataFrame], DataFrame] | None = None
    dealt_by_race: Callable[[int], tuple[DataFrame, DataFrame]] | None = None

    def results_for(self, race_ids: DataFrame) -> DataFrame:
        """The result table, or only its rows of the races in ``race_ids``."""
        return self.result if self.results_of is None else self.results_of(race_ids)

    def dealt_results(self, parts: int) -> tuple[DataFrame, DataFrame]:
        """The result table dealt by race in ``parts``, and the refund table."""
        return (dealt(self.result, "race_id", parts), self.refund) if self.dealt_by_race is None else self.dealt_by_race(parts)


def master_place_df(spark: SparkSession) -> DataFrame:
    """The ten racecourses as a literal DataFrame."""
    rows = sorted(PLACE_NAMES.items())
    return spark.createDataFrame(rows, TABLE_SCHEMAS["master_place"])


def read_tables(spark: SparkSession, root: str, fmt: str = "parquet",
                options: dict | None = None) -> RaceTables:
    """Read ``{root}/{table}`` for each table with its fixed schema.

    ``master_place`` falls back to the built-in ten racecourses when the
    folder has none.  The fourth-corner column may be called ``corner4`` or,
    as the course statistics have it, ``4c``.
    """
    opts = options or {}

    def load(name: str, schema: StructType | None = None) -> DataFrame:
        return spark.read.schema(schema or TABLE_SCHEMAS[name]).format(fmt).options(**opts).load(f"{root}/{name}")

    try:
        master_place = load("master_place")
        master_place.columns
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        master_place = master_place_df(spark)
    # Files without column names are read by position.
    named = fmt != "csv" or str(opts.get("header", "false")).lower() == "true"
    have = spark.read.format(fmt).options(**opts).load(f"{root}/result").columns if named else ["corner4"]
    if "corner4" in have:
        result = load("result")
    elif "4c" in have:
        fields = [StructField("4c", f.dataType) if f.name == "corner4" else f for f in TABLE_SCHEMAS["result"].fields]
        result = load("result", StructType(fields)).withColumnRenamed("4c", "corner4")
    else:
        raise ValueError("the result table has neither corner4 nor 4c")
    return RaceTables(load("race"), result, load("refund"), load("horse"), load("jockey"), master_place)


def exact(column: str, kind: DataType) -> Column:
    """A column as ``kind``; a decimal that would lose digits raises."""
    as_kind = F.col(f"`{column}`").cast(kind)
    if isinstance(kind, DecimalType):
        lost = F.col(f"`{column}`").isNotNull() & ~F.col(f"`{column}`").eqNullSafe(as_kind)
        as_kind = F.when(lost, F.raise_error(F.concat(F.lit(f"{column} does not fit {kind.simpleString()}: "),
                                                      F.col(f"`{column}`").cast("string")))).otherwise(as_kind)
    return as_kind.alias(column)


def read_jdbc_tables(spark: SparkSession, url: str, properties: dict,
                     result_bounds: tuple[int, int] | None = None,
                     partitions: int = 64) -> RaceTables:
    """Read the tables from a relational database over JDBC.

    ``result`` and ``refund`` are read in ``partitions`` parallel ranges of
    ``race_id`` when ``result_bounds`` (min, max race_id) is given, so no
    single task pulls a whole table.
    """

    def load(name: str, ranged: bool = False) -> DataFrame:
        if ranged and result_bounds is not None:
            lo, hi = result_bounds
            df = spark.read.jdbc(url, name, column="race_id", lowerBound=lo, upperBound=hi,
                                 numPartitions=partitions, properties=properties)
        else:
            df = spark.read.jdbc(url, name, properties=properties)
        schema = TABLE_SCHEMAS[name]
        if name == "result" and "4c" in df.columns:
            df = df.withColumnRenamed("4c", "corner4")
        return df.select([exact(f.name, f.dataType) for f in schema.fields])

    return RaceTables(load("race"), load("result", True), load("refund", True), load("horse"),
                      load("jockey"), load("master_place"))


def write_tables(tables: RaceTables, root: str, mode: str = "errorifexists") -> None:
    """Write the six tables as parquet folders under ``root``."""
    for name in TABLE_SCHEMAS:
        getattr(tables, name).write.mode(mode).parquet(f"{root}/{name}")
