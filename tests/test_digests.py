from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from evenkeel.operators import digests, rowdiff
from evenkeel.options import RowDiffOptions
from evenkeel.plans.lineage import shared_folder
from evenkeel.sources import versions


def counts(df):
    return tuple(df.first()[c] for c in ("missing", "extra", "different", "equal"))


def both(a, b, keys, options=RowDiffOptions(), buckets=64):
    """Counts by digests and by the whole join, which must agree."""
    pair = rowdiff.TablePair("t", a, b, keys)
    got = counts(digests.summarize(pair, options, buckets))
    assert got == counts(rowdiff.summarize(rowdiff.diff_rows(a, b, keys, options), "t"))
    return got


def test_only_the_bucket_of_a_changed_row_is_joined(spark):
    a = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 == 0, "x").alias("w"))
    same = digests.narrowed(a, a.repartition(5), ["k"])
    assert (same.suspects, same.equal) == (0, 20_000)
    summary = digests.summarize(rowdiff.TablePair("t", a, a.repartition(5), ["k"]))
    assert "Join" not in summary._jdf.queryExecution().toString() and counts(summary) == (0, 0, 0, 20_000)
    b = a.withColumn("v", F.when(F.col("k") == 77, -1).otherwise(F.col("v")))
    rest = digests.narrowed(a, b, ["k"])
    assert rest.suspects == 1 and 0 < rest.source.count() == rest.target.count() < 40 and rest.equal > 19_960
    assert both(a, b, ["k"]) == (0, 0, 1, 19_999)
    assert both(a.where("k <> 5"), a.where("k <> 9"), ["k"]) == (1, 1, 0, 19_998)


def test_nulls_and_nested_values_have_their_place(spark):
    cases = [
        ("k int, a int, b int", [(1, None, 1)], [(1, 1, None)]),
        ("k int, a array<int>", [(1, [None, 2])], [(1, [2, None])]),
        ("k int, a struct<x:int,y:int>", [(1, (None, 3))], [(1, (3, None))]),
        ("k int, a array<int>", [(1, None)], [(1, [])]),
        ("k int, a string", [(1, None)], [(1, "")]),
        ("k int, a map<string,int>", [(1, {"p": 1, "q": None})], [(1, {"p": None, "q": 1})]),
    ]
    for schema, a, b in cases:
        a, b = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
        assert both(a, b, ["k"]) == (0, 0, 1, 0) and both(a, a, ["k"]) == (0, 0, 0, 1)
    stamp = "named_struct('t', timestamp'2024-01-01 00:00:00.00000{}') as a"
    a, b = (spark.range(1).selectExpr("id as k", stamp.format(n)) for n in (1, 2))
    assert both(a, b, ["k"]) == (0, 0, 1, 0)
    a, b = (spark.range(1).selectExpr("id as k", f"map('x', {first}, 'y', 2) as a") for first in (1, 3))
    swapped = spark.range(1).selectExpr("id as k", "map('y', 2, 'x', 1) as a")
    assert both(a, swapped, ["k"]) == (0, 0, 0, 1) and both(a, b, ["k"]) == (0, 0, 1, 0)


def test_null_keys_repeated_rows_and_mixed_types(spark):
    rows = [(None, 1), (None, 1), (2, 2)]
    a = spark.createDataFrame(rows, "k int, v int")
    assert both(a, a, ["k"]) == (2, 2, 0, 1)
    once = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    assert both(once, once, ["k"], RowDiffOptions(null_safe_keys=True)) == (0, 0, 0, 2)
    b = spark.createDataFrame([("2", 2.0, "more")], "K string, V double, other string")
    assert both(a, b, ["k"]) == (2, 0, 0, 1)
    assert both(a.limit(0), a.limit(0), ["k"]) == (0, 0, 0, 0) and both(a, a.limit(0), ["k"]) == (3, 0, 0, 0)
    pick = random.Random(4)
    left, right = ([(pick.randrange(9), pick.randrange(3)) for _ in range(200)] for _ in "ab")
    left, right = (spark.createDataFrame(x, "k int, v int") for x in (left, right))
    both(left, right, ["k"], RowDiffOptions(pair_duplicates=True), 4)
    with pytest.raises(rowdiff.NotComparable):
        digests.narrowed(a, a, [])


# Versions ---------------------------------------------------------------------
def fresh(spark):
    return f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_small_feed_rewrites_a_small_part(spark):
    target = spark.range(50_000).select(F.col("id").cast("int").alias("K"), F.md5(F.col("id").cast("string")).alias("v"), F.lit(1).alias("own"))
    source = target.select(F.col("K").cast("long").alias("k"), F.when(F.col("K") == 3, "new").otherwise(F.col("v")).alias("v")).where("k <> 8")
    source = source.union(spark.sql("select 70000L, 'added'"))
    path = fresh(spark)
    versions.create(target, path, ["K"], 128)
    diff = rowdiff.diff_rows(source, target, ["k"])
    assert versions.apply(path, rowdiff.change_feed(diff), diff) == 1
    after, before = versions.read(spark, path), versions.read(spark, path, 0)
    assert rows_of(after) == rows_of(rowdiff.apply_changes(source, target, ["k"])) and after.dtypes == target.dtypes
    assert rows_of(before) == rows_of(target)
    written = set(after.inputFiles()) - set(before.inputFiles())
    assert 0 < len(written) <= 3 < 0.05 * len(before.inputFiles())
    # A feed without changes, and one that deletes all.
    again = rowdiff.diff_rows(source, after, ["k"])
    assert versions.apply(path, rowdiff.change_feed(again), again) == 2 and set(versions.read(spark, path).inputFiles()) == set(after.inputFiles())
    none = rowdiff.diff_rows(source.limit(0), after, ["k"])
    versions.apply(path, rowdiff.change_feed(none), none)
    assert rows_of(versions.read(spark, path)) == [] and versions.read(spark, path).dtypes == target.dtypes
    back = rowdiff.diff_rows(source, versions.read(spark, path), ["k"])
    versions.apply(path, rowdiff.change_feed(back), back)
    assert rows_of(versions.read(spark, path).select("K", "v")) == rows_of(source)
    with pytest.raises(ValueError):
        versions.read(spark, path, 9)


def test_null_and_repeated_keys_in_versions(spark):
    schema = "k int, v string, _b int"
    target = spark.createDataFrame([(None, "a", 1), (1, "b", 2), (1, "b", 3), (2, "c", 4)], schema)
    source = spark.createDataFrame([(None, "z", 1), (1, "b", 2), (1, "d", 3)], schema)
    options = RowDiffOptions(pair_duplicates=True)
    path = fresh(spark)
    versions.create(target, path, ["k"], 4)
    diff = rowdiff.diff_rows(source, target, ["k"], options)
    versions.apply(path, rowdiff.change_feed(diff), diff)
    assert rows_of(versions.read(spark, path)) == rows_of(source)
