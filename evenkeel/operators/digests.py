"""Row compare of tables that are mostly in step.

Each side is read once for order-free digests of its key buckets: rows are counted and their hashes added up
map-side, so that only a row per bucket and task is shuffled. Rows of buckets whose digests agree are equal; only
those of the other buckets enter the join, which compares values and not hashes. A bucket counts as
equal if its rows, the exclusive or of one 64-bit hash and the two half sums of another agree.

Rows with a null key equal none unless keys are null-safe, so their bucket always enters the join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.compare import comparable
from evenkeel.operators import rowdiff
from evenkeel.options import RowDiffOptions
from evenkeel.plans.lineage import cut

BUCKETS = 4096
_BUCKET = "_bucket"
# Hashes skip nulls inside nested values, texts don't. Times keep all their digits.
_EXACT = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


@dataclass(frozen=True)
class Narrowed:
    """The rows of the buckets that differ, how many buckets those are, and how many rows of the target are known to be equal."""

    source: DataFrame
    target: DataFrame
    suspects: int
    equal: int


def _bucket(keys: Sequence[Column], buckets: int, null_safe: bool) -> Column:
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    if null_safe:
        return place
    unkeyed = F.lit(False)
    for key in keys:
        unkeyed = unkeyed | key.isNull()
    return F.when(unkeyed, -1).otherwise(place)


def _hashed(rows: DataFrame, name: str, dtype: T.DataType) -> list[Column]:
    form = rowdiff._FORM + name
    if form in rows.columns:
        value = F.col(f"`{form}`")
    else:
        value = comparable(F.col(f"`{name}`"), dtype)
        if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
            value = F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v")), _EXACT))
    # A hash skips nulls too, so the mark tells (null, 1) from (1, null).
    return [value, value.isNull()]


def _digests(rows: DataFrame, plan: rowdiff.ColumnPlan, types: dict[str, T.DataType], buckets: int, null_safe: bool) -> DataFrame:
    parts = [part for c in plan.keys + plan.values for part in _hashed(rows, c, types[c])]
    place = _bucket([F.col(f"`{k}`") for k in plan.keys], buckets, null_safe)
    hashed = rows.select(place.alias(_BUCKET), F.xxhash64(*parts).alias("one"), F.xxhash64(F.lit("two"), *parts).alias("two"))
    return hashed.groupBy(_BUCKET).agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.bit_xor("one").alias("mixed"),
            F.sum(F.shiftright("two", 32)).alias("high"),
            F.sum(F.col("two").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        ).alias("digest")
    )


def narrowed(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    options: RowDiffOptions = RowDiffOptions(),
    computed: Iterable[str] = (),
    buckets: int = BUCKETS,
) -> Narrowed:
    """Both sides without the buckets that are equal. Runs the digests; at most `buckets` + 1 rows per side are kept of them."""
    plan = rowdiff._require(rowdiff.plan_columns(source.schema, target.schema, keys, computed))
    safe = options.null_safe_keys
    left, right, types = rowdiff._sides(source, target, plan, replace(options, pair_duplicates=False))
    a, b = (_digests(side, plan, types, buckets, safe) for side in (left, right))
    joined = a.alias("a").join(b.alias("b"), _BUCKET, "full_outer")
    differs = (F.col(_BUCKET) < 0) | ~F.col("a.digest").eqNullSafe(F.col("b.digest"))
    found = cut(joined.select(_BUCKET, differs.alias("differs"), F.col("b.digest.rows").alias("rows")))
    known = found.agg(F.count_if("differs").alias("suspects"), F.sum(F.when(~F.col("differs"), F.col("rows"))).alias("equal")).first()
    suspects = found.where("differs").select(_BUCKET)

    def within(rows: DataFrame, names: dict[str, str]) -> DataFrame:
        forms = [rowdiff._form(rows, names.get(k, k), types[k]) for k in plan.keys]
        placed = rows.withColumn(_BUCKET, _bucket(forms, buckets, safe))
        return placed.join(F.broadcast(suspects), _BUCKET, "left_semi").drop(_BUCKET)  # at most `buckets` + 1 numbers

    return Narrowed(within(source, {}), within(target, plan.target_name), known.suspects, known.equal or 0)


def summarize(pair: rowdiff.TablePair, options: RowDiffOptions = RowDiffOptions(), buckets: int = BUCKETS) -> DataFrame:
    """The counts of `rowdiff.summarize`. Tables in step are not joined at all."""
    rest = narrowed(pair.source, pair.target, pair.keys, options, pair.computed, buckets)
    if not rest.suspects:
        zero = [F.lit(0).cast("long").alias(c) for c in ("missing", "extra", "different")]
        equal = F.lit(rest.equal).cast("long").alias("equal")
        return pair.source.sparkSession.range(1).select(F.lit(pair.name).alias("table_name"), *zero, equal, F.lit(False).alias("has_changes"))
    counts = rowdiff.summarize(rowdiff.diff_rows(rest.source, rest.target, pair.keys, options, pair.computed), pair.name)
    return counts.withColumn("equal", F.col("equal") + F.lit(rest.equal).cast("long"))


def diff_tables(pairs: Sequence[rowdiff.TablePair], options: RowDiffOptions = RowDiffOptions(), buckets: int = BUCKETS) -> DataFrame:
    """The same rows as `rowdiff.diff_tables`, for tables of which most are in step."""
    out = None
    for pair in pairs:
        if rowdiff.plan_columns(pair.source.schema, pair.target.schema, pair.keys, pair.computed).error:
            part = rowdiff.diff_tables([pair], options)
        else:
            part = summarize(pair, options, buckets).withColumn("note", F.when(F.col("has_changes"), "").otherwise("in sync"))
        out = part if out is None else out.unionByName(part)
    return out
