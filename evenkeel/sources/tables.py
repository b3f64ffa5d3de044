"""Read the tables to compare. Only keys and compared columns are read: later projections
reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_files(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def from_jdbc(
    spark: SparkSession, url: str, table: str, split_on: str, lower: int, upper: int, parts: int, **options: str
) -> DataFrame:
    """Read a server table in parallel ranges of a numeric key. No server-side sort is asked
    for: the join sorts what it needs."""
    return spark.read.jdbc(
        url, table, column=split_on, lowerBound=lower, upperBound=upper, numPartitions=parts, properties=options
    )


def bucketed_copy(df: DataFrame, name: str, keys: list[str], buckets: int) -> None:
    """Save a table bucketed and sorted by its key. Two such copies with the same number of
    buckets are compared without moving a row."""
    df.write.mode("errorifexists").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)


def list_databases(databases: DataFrame, engine: str) -> DataFrame:
    """User databases by name, from landed catalog rows."""
    if engine == "SQL Server":
        rows = databases.filter("database_id > 4 and state = 0").select("pair_id", "side", "name")
    else:
        rows = databases.filter("not datistemplate").select("pair_id", "side", F.col("datname").alias("name"))
    return rows.orderBy("pair_id", "side", "name")
