"""Number the rows that share a key, also where one key holds a large share of all rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions.compare import comparable, has_map
from evenkeel.plans.lineage import cut, shared_folder

_FAN_OUT = 4096


def number_occurrences(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], occ: str = "occ") -> DataFrame:
    """Add `occ`: 1, 2, … within each key, in the order of `order_by`. `df` must hold only these columns.

    Equal rows are counted before the shuffle. The rest is dealt out by ranges of (key, values), so that a key
    of any size spreads over as many parts as it needs; each part is numbered apart, and the one key
    that a part may share with the part before it is shifted by a small table of totals. The
    ranges are written, as two uses of a range shuffle need not agree on its bounds: as a sorted table in buckets
    by part, a fraction of a checkpoint's size, unless a column has no type there.
    """
    keys = list(keys)
    maps = [c for c in order_by if has_map(df.schema[c].dataType)]
    form = {c: f"_form_{c}" for c in maps}
    df = df.withColumns({form[c]: comparable(F.col(f"`{c}`"), df.schema[c].dataType) for c in maps}) if maps else df
    order = [form.get(c, c) for c in order_by]
    # Equal rows are interchangeable: one row with a count stands for all of them.
    runs = df.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_run"), *[F.first(c).alias(c) for c in maps])
    ranged = runs.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    untyped = "void" in ranged.schema.simpleString()
    ranged = cut(ranged) if untyped else _by_part(ranged.sortWithinPartitions(*keys, *order))
    before = Window.partitionBy("_part").orderBy(*keys, *order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("_at", F.coalesce(F.sum("_run").over(before), F.lit(0)))
    placed = placed.withColumn("_first", F.col("_at") - F.first("_at").over(so_far))
    # A part goes on with at most one key of an earlier part: no more rows than parts.
    totals = ranged.groupBy("_part", *keys).agg(F.sum("_run").alias("_total"))
    across = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.withColumn("_offset", F.sum("_total").over(across)).where("_offset > 0")
    shift = shift.select("_part", F.struct(*keys).alias("_key"), "_offset")
    joined = placed.join(shift, "_part", "left")
    moved = F.when(F.struct(*keys).eqNullSafe(F.col("_key")), F.col("_offset")).otherwise(0)
    return _unfold(joined.withColumn("_first", F.col("_first") + moved), [*keys, *order_by], occ)


def _by_part(ranged: DataFrame) -> DataFrame:
    """The ranges as a table in buckets by `_part`, so that numbering within a part moves no row. A task holds one part
    and writes one file."""
    spark = ranged.sparkSession
    name = f"ranges_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged.write.bucketBy(buckets, "_part").format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _unfold(runs: DataFrame, kept: list[str], occ: str) -> DataFrame:
    """One row per occurrence again. Long runs are cut into chunks of a bounded size first."""
    columns = [F.col(f"`{c}`") for c in kept]
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("_run") - 1) / _FAN_OUT)))
    chunks = runs.select(*columns, "_run", "_first", part.alias("_chunk"))
    start = F.col("_first") + F.col("_chunk") * _FAN_OUT
    size = F.least(F.col("_run") - F.col("_chunk") * _FAN_OUT, F.lit(_FAN_OUT))
    places = F.sequence((start + 1).cast("long"), (start + size).cast("long"))
    return chunks.select(*columns, F.explode(places).alias(occ))
