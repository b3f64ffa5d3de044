"""A table kept in key buckets, of which a change feed rewrites only those that it names.

Rows lie under `data/<folder>/_bucket=<n>`, a folder for each version written. A manifest, one row per bucket that has rows,
says in which folder the bucket's rows of this version are; a version exists once its manifest does, so that a
job that was lost leaves the last version as it was. The feed of each version is kept beside it. Older versions
stay readable. Manifests have at most as many rows as there are buckets, and are read by the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.operators import rowdiff

_BUCKET = "_bucket"
_MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType()), T.StructField("buckets", T.IntegerType())])


def _place(keys: Sequence[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _store(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> dict[int, str]:
    """Write rows by bucket to a folder of their own, and say which buckets there are."""
    spark, folder = rows.sparkSession, uuid.uuid4().hex
    placed = rows.withColumn(_BUCKET, _place([F.col(f"`{k}`") for k in keys], buckets))
    # Rebalanced, not repartitioned: small buckets share a task, a bucket of a hot key is split over several.
    placed.hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/data/{folder}")
    schema = T.StructType([*rows.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
    held = spark.read.schema(schema).parquet(f"{path}/data/{folder}").select(_BUCKET).distinct().collect()
    return {r[0]: folder for r in held}


def _commit(spark: SparkSession, path: str, version: int, held: dict[int, str], buckets: int) -> None:
    rows = [(b, f, buckets) for b, f in sorted(held.items())] or [(None, None, buckets)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/versions/version={version}")


def _manifest(spark: SparkSession, path: str, version: int | None) -> tuple[int, dict[int, str], int]:
    rows = spark.read.schema(T.StructType([*_MANIFEST.fields, T.StructField("version", T.IntegerType())])).parquet(f"{path}/versions")
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    held = rows.where(F.col("version") == version).collect()
    if not held:
        raise ValueError(f"no version {version} in {path}")
    return version, {r.bucket: r.folder for r in held if r.bucket is not None}, held[0].buckets


def create(rows: DataFrame, path: str, keys: Sequence[str], buckets: int) -> None:
    """Version 0 of a table, in a new folder."""
    rows.limit(0).write.mode("errorifexists").parquet(f"{path}/shape")
    _commit(rows.sparkSession, path, 0, _store(rows, path, keys, buckets), buckets)


def read(spark: SparkSession, path: str, version: int | None = None, only: Sequence[int] | None = None) -> DataFrame:
    """The rows of a version, the last one by default; of some buckets, if they are given."""
    _, held, _ = _manifest(spark, path, version)
    schema = spark.read.parquet(f"{path}/shape").schema
    wanted = held if only is None else {b: held[b] for b in only if b in held}
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{folder}/{_BUCKET}={b}" for b, folder in sorted(wanted.items())])


def apply(path: str, feed: DataFrame, diff: rowdiff.RowDiff) -> int:
    """Apply the change feed of `diff` to the last version and return the number of the new one. Only the
    buckets of the feed's keys are read and written."""
    spark = feed.sparkSession
    version, held, buckets = _manifest(spark, path, None)
    schema = spark.read.parquet(f"{path}/shape").schema
    names = [diff.plan.target_name[k] for k in diff.keys]
    kept = f"{path}/feeds/{uuid.uuid4().hex}"
    feed.write.parquet(kept)
    feed = spark.read.schema(feed.schema).parquet(kept)
    place = _place([F.col(f"`{k}`").cast(schema[n].dataType) for k, n in zip(diff.keys, names)], buckets)
    touched = [r[0] for r in feed.select(place.alias("b")).distinct().collect()]
    if touched:
        changed = rowdiff.apply_feed(read(spark, path, version, touched), feed, diff)
        held = {b: f for b, f in held.items() if b not in set(touched)} | _store(changed, path, names, buckets)
    _commit(spark, path, version + 1, held, buckets)
    return version + 1
