"""SparkSession settings used by tests, the bench and local runs.

On a cluster the session comes from the platform; only the SQL settings
below matter and each can be set on an existing session with
``apply_sql_settings``.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Runtime SQL settings the plans are tuned for.  AQE coalesces the small
# post-aggregation shuffles, splits skewed join partitions and turns
# shuffle joins into broadcast joins once a side is measured small.
# requireAllClusterKeysForCoPartition=false lets the payout join on
# (race_id, horse_no) reuse the race join's race_id partitioning instead of
# shuffling the runners a second time (race_id has high cardinality, so
# partitioning on it alone does not concentrate rows).  That reuse would keep
# AQE from splitting the race join when one race is huge; forceOptimizeSkewedJoin
# lets it split the join and pay one more shuffle then.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.session.timeZone": "UTC",
}


def apply_sql_settings(spark: SparkSession) -> SparkSession:
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | None = None, shuffle_partitions: int = 8,
                  app: str = "paddock") -> SparkSession:
    """A local session for tests and the bench (Spark UI off)."""
    master = f"local[{cpus}]" if cpus else "local[*]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PADDOCK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
