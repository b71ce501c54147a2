"""What the operators of this subpackage share: tables, the shared folder, splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the one named by ``spark.checkpoint.dir``.  Where that is unset, as
    in tests, a folder of this machine is made, for local masters only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="paddock-shared-")
        sc.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here,
    so a lost executor costs no earlier stage."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo ``of``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def unit_hash(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) that depends only on the columns and the seed."""
    return F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_totals(rows: DataFrame, totals: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined (inner) to ``totals``, which has one row a key and, in ``size``,
    how many of ``rows`` have it.

    Keys of more than 1/2000 of the rows, fewer than 2000, are broadcast: no task
    gets all rows of one.  The others are joined by shuffle."""
    total = totals.agg(F.sum(size)).first()[0] or 0
    frequent = F.col(size) > total // 2000
    hot = F.broadcast(totals.where(frequent).drop(size))
    rest = rows.join(F.broadcast(totals.where(frequent).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(totals.where(~frequent).drop(size), key))


# Rows of an Arrow batch that are handled at once: texts, their hashes and sets
# are held for so many rows only.
SLICE_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: Spark's default of 10 000 rows holds tens of
    MB in the JVM and in each worker.  A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= SLICE_ROWS:
        spark.conf.set(name, str(SLICE_ROWS))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def named(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def with_computed(df: DataFrame, keep: list[str], source: str, compute: Callable[[list], list], added: str) -> DataFrame:
    """``keep`` columns untouched (Arrow, so NULLs and types stay) and ``added``
    (a DDL string) as ``compute`` makes them from the values of ``source``.

    Columns travel under their number, so any names of theirs work."""
    spec = StructType.fromDDL(added)
    read = list(dict.fromkeys([*keep, source]))
    schema = StructType([StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keep)] + [StructField(f"a{i}", f.dataType) for i, f in enumerate(spec.fields)])
    types = [to_arrow_type(f.dataType) for f in spec.fields]
    kept, at = [read.index(k) for k in keep], read.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = compute(batch.column(at).to_pylist())
            made = [pa.array(v, type=t) for v, t in zip(values, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + made, names=schema.names)

    small_batches(df.sparkSession)
    numbered = df.select(*(named(c).alias(f"c{i}") for i, c in enumerate(read)))
    return numbered.mapInArrow(run, schema).toDF(*keep, *spec.names)


def kept_rows(df: DataFrame, source: str, good: Callable[[list], np.ndarray]) -> DataFrame:
    """The rows of ``df`` for which ``good`` of the values of ``source`` is true, all columns untouched."""
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(good(batch.column(at).to_pylist()), type=pa.bool_()))

    small_batches(df.sparkSession)
    numbered = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return numbered.mapInArrow(run, numbered.schema).toDF(*df.columns)
