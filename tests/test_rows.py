from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evenkeel.functions.dialect import POSTGRESQL, SQL_SERVER
from evenkeel.operators import dml, rowdiff
from evenkeel.operators.occurrences import number_occurrences
from evenkeel.options import RowDiffOptions
from evenkeel.sources.tables import bucketed_copy
from suite import rows as queries
from suite.base import load, table

SF = "/root/testdata/sf0.01"


def counts(diff):
    row = rowdiff.summarize(diff, "t").first()
    return {k: row[k] for k in ("missing", "extra", "different", "equal")}


# Expected counts of the drift recipes, found once by two engines.
EXPECTED = {
    "orders": dict(different=1536, equal=12581, extra=790, missing=883),
    "lineitem": dict(different=1959, equal=49426, extra=0, missing=8615),
    "conversations": dict(different=31, equal=458, extra=0, missing=47),
    "embeddings": dict(different=50, equal=450, extra=0, missing=0),
}


def test_recipe_counts(spark):
    assert counts(queries.orders_diff(spark, SF)) == EXPECTED["orders"]
    lineitem = table(spark, SF, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    dups = rowdiff.diff_rows(
        lineitem.drop("l_partkey"), lineitem.filter("l_partkey % 7 <> 0").drop("l_partkey"),
        ["l_orderkey", "l_linenumber"], RowDiffOptions(pair_duplicates=True),
    )
    assert counts(dups) == EXPECTED["lineitem"]
    talk = rowdiff.diff_rows(table(spark, SF, "conversations"), load(spark, SF, "conversations_t"), ["conv_id", "turn"])
    assert counts(talk) == EXPECTED["conversations"]
    vectors = table(spark, SF, "embeddings")
    turned = vectors.withColumn("embedding", F.expr("if(vec_id % 10 = 0, reverse(embedding), embedding)"))
    assert counts(rowdiff.diff_rows(vectors, turned, ["vec_id"])) == EXPECTED["embeddings"]


def test_conservation_and_symmetry(spark):
    source, target = queries.orders_pair(spark, SF)
    there = counts(rowdiff.diff_rows(source, target, ["o_orderkey"]))
    back = counts(rowdiff.diff_rows(target, source, ["o_orderkey"]))
    assert there["missing"] + there["different"] + there["equal"] == source.count()
    assert there["extra"] + there["different"] + there["equal"] == target.count()
    assert back == {**there, "missing": there["extra"], "extra": there["missing"]}


@pytest.fixture(scope="module")
def demo(spark):
    """Lighthouses as they are, and an outdated list of them that has a column of its own."""
    source = spark.createDataFrame(
        [(10, "Skerry", "white"), (20, "Holm", "red"), (30, "Ness", "green"), (40, "Voe", None)], "Light int, Place string, Colour string")
    target = spark.createDataFrame(
        [(10, "Skerry", "white", None), (20, "Holm", "amber", 9), (40, "Voe", None, 3), (50, "Stack", "red", None), (60, "Geo", "red", 1)],
        "Light int, PLACE string, Colour string, Keeper int")
    return source, target


def test_demo_script(spark, demo):
    source, target = demo
    diff = rowdiff.diff_rows(source, target, ["light"])
    assert counts(diff) == dict(missing=1, extra=2, different=1, equal=2)
    ref = dml.TableRef("sea", "Lights", identity={"Light": "IDENTITY(10,10)"})
    script = dml.table_script(diff, ref, SQL_SERVER).orderBy(*dml.script_order(diff))
    assert [r.statement for r in script.collect()] == [
        "-- ==== Data changes for sea.Lights ====",
        "DELETE FROM [sea].[Lights] WHERE [Light] = 50;",
        "DELETE FROM [sea].[Lights] WHERE [Light] = 60;",
        "UPDATE [sea].[Lights] SET [Colour] = N'red' WHERE [Light] = 20;",
        "SET IDENTITY_INSERT [sea].[Lights] ON;",
        "INSERT INTO [sea].[Lights] ([Light], [Place], [Colour]) VALUES (30, N'Ness', N'green');",
        "SET IDENTITY_INSERT [sea].[Lights] OFF;",
    ]
    synced = rowdiff.apply_changes(source, target, ["Light"])
    assert synced.columns == target.columns
    assert {(r.Light, r.Colour, r.Keeper) for r in synced.collect()} == {(10, "white", None), (20, "red", 9), (30, "green", None), (40, None, 3)}
    assert counts(rowdiff.diff_rows(source, synced, ["Light"])) == dict(missing=0, extra=0, different=0, equal=4)
    kept = rowdiff.apply_changes(source, target, ["Light"], RowDiffOptions(include_deletes=False))
    assert counts(rowdiff.diff_rows(source, kept, ["Light"])) == dict(missing=0, extra=2, different=0, equal=4)


def test_computed_columns_follow_the_source(spark):
    source = spark.createDataFrame([(1, 10, 20), (2, 5, 10)], "k int, a int, twice int")
    target = spark.createDataFrame([(1, 7, 14)], "k int, a int, twice int")
    assert {tuple(r) for r in rowdiff.apply_changes(source, target, ["k"], computed=["twice"]).collect()} == {(1, 10, 20), (2, 5, 10)}


def test_null_keys_in_statements(spark):
    source, target = (spark.createDataFrame(rows, "k int, v int") for rows in ([(None, 1)], [(None, 2)]))
    diff = rowdiff.diff_rows(source, target, ["k"], RowDiffOptions(null_safe_keys=True))
    rows = dml.statements(diff, dml.TableRef("sea", "T"), POSTGRESQL).collect()
    assert [r.statement for r in rows] == ['UPDATE "sea"."T" SET "v" = 1 WHERE "k" IS NULL;']
    synced = rowdiff.apply_changes(source, target, ["k"], RowDiffOptions(null_safe_keys=True))
    assert [tuple(r) for r in synced.collect()] == [(None, 1)]


def test_values_without_a_literal(spark):
    """SQL Server stores no NaN: the row is named in a warning. PostgreSQL does."""
    source = spark.sql("select 1 as k, double('NaN') as depth, 2D as width")
    target = spark.sql("select 2 as k, double('NaN') as depth, 2D as width")
    diff = rowdiff.diff_rows(source, target, ["k"], RowDiffOptions(include_deletes=False))
    text = lambda d: [r.statement for r in dml.statements(diff, dml.TableRef("sea", "T"), d).collect()]
    assert text(SQL_SERVER) == ["-- WARNING: sea.T: SQL Server has no value for depth of the row with [k] = 1"]
    assert text(POSTGRESQL) == ["INSERT INTO \"sea\".\"T\" (\"k\", \"depth\", \"width\") VALUES (1, 'NaN', 2);"]


def test_numbers_of_different_types(spark):
    source = spark.sql("select * from values (1, 9007199254740993L, 1.50BD, cast(7 as decimal(38,0))), (2, 4L, 0.1BD, cast(7 as decimal(38,0))) as t(k, n, d, w)")
    target = spark.sql("select * from values (1, 9007199254740992D, 1.5D, cast(7 as decimal(38,18))), (2, 4D, 0.1D, cast(7.5 as decimal(38,18))) as t(k, n, d, w)")
    got = {r.k: r.changed for r in rowdiff.diff_rows(source, target, ["k"]).df.collect()}
    assert got == {1: ["n"], 2: ["w"]}


def test_duplicates_with_maps(spark):
    rows = "select * from values (1, map('a', 1), 2), (1, map('a', 1), 2), (1, map('b', 2), 1) as t(k, m, v)"
    diff = rowdiff.diff_rows(spark.sql(rows), spark.sql(rows + " where v = 2"), ["k"], RowDiffOptions(pair_duplicates=True))
    assert counts(diff) == dict(missing=1, extra=0, different=0, equal=2)


def test_no_changes_no_script(spark, demo):
    source, _ = demo
    diff = rowdiff.diff_rows(source, source, ["Light"])
    assert dml.table_script(diff, dml.TableRef("sea", "Lights", identity={"Light": "x"}), POSTGRESQL).count() == 0


def test_values_and_types(spark):
    source = spark.sql(
        "select * from values (1, cast(19.9900 as decimal(18,4)), double('NaN'), map('a', 1, 'b', 2), array(map('x', null)), 'a '),"
        "(2, cast(1 as decimal(18,4)), 0D, map('a', 1), array(map('x', 1)), null) as t(k, d, f, m, am, s)")
    target = spark.sql(
        "select * from values (1L, cast(19.99 as decimal(10,2)), double('NaN'), map('b', 2, 'a', 1), array(map('x', null)), 'a'),"
        "(2L, cast(1 as decimal(10,2)), -0D, map('a', 2), array(map('x', 1)), null) as t(k, d, f, m, am, s)")
    diff = rowdiff.diff_rows(source, target, ["k"])
    got = {r.k: r.changed for r in diff.df.collect()}
    assert got == {1: ["s"], 2: ["m"]}


def test_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (1, 1)], "k int, v int")
    assert counts(rowdiff.diff_rows(rows, rows, ["k"], RowDiffOptions(null_safe_keys=True)))["equal"] == 2
    plain = counts(rowdiff.diff_rows(rows, rows, ["k"]))
    assert (plain["missing"], plain["extra"], plain["equal"]) == (1, 1, 1)


def test_many_tables_in_batches(spark, tmp_path):
    pairs = [rowdiff.TablePair(f"t{i}", spark.range(i + 3), spark.range(3), ["id"]) for i in range(7)]
    rowdiff.diff_tables_to(pairs, str(tmp_path / "out"), batch=3)
    got = {r.table_name: (r.missing, r.equal) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {f"t{i}": (i, 3) for i in range(7)}


def test_not_comparable(spark, demo):
    source, target = demo
    with pytest.raises(rowdiff.NotComparable):
        rowdiff.diff_rows(source, target, [])
    with pytest.raises(rowdiff.NotComparable):
        rowdiff.diff_rows(source, target.drop("Light"), ["Light"])


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_keys_against_brute_force(spark, seed):
    """Two hot keys, one of them mostly one repeated row; nulls among the values."""
    rng = random.Random(seed)
    data = [(0, rng.choice([None, *range(40)]), rng.randint(0, 5)) for _ in range(3000)]
    data += [(None, 3, 3)] * 1500 + [(None, rng.randint(0, 9), 1) for _ in range(300)]
    data += [(rng.randint(1, 200), rng.randint(0, 3), 0) for _ in range(800)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k int, a int, b int").repartition(7)
    got = number_occurrences(df, ["k"], ["a", "b"]).collect()
    groups = defaultdict(list)
    for k, a, b in data:
        groups[k].append((a, b))
    want = Counter()
    for k, values in groups.items():
        ordered = sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
        want.update((k, a, b, i + 1) for i, (a, b) in enumerate(ordered))
    assert Counter(tuple(r) for r in got) == want


def test_long_runs_unfold(spark, monkeypatch):
    from evenkeel.operators import occurrences

    monkeypatch.setattr(occurrences, "_FAN_OUT", 4)
    df = spark.range(1000).select(F.lit(1).alias("k"), F.lit(2).alias("v"))
    got = number_occurrences(df, ["k"], ["v"])
    assert sorted(r.occ for r in got.collect()) == list(range(1, 1001))


def test_duplicates_apply_round_trip(spark):
    source = spark.createDataFrame([(1, 5), (1, 7), (1, 9), (2, 1)], "k int, v int")
    target = spark.createDataFrame([(1, 5, "x"), (1, 8, "y"), (3, 1, "z")], "k int, v int, own string")
    options = RowDiffOptions(pair_duplicates=True)
    diff = rowdiff.diff_rows(source, target, ["k"], options)
    assert counts(diff) == dict(missing=2, extra=1, different=1, equal=1)
    synced = rowdiff.apply_changes(source, target, ["k"], options)
    assert counts(rowdiff.diff_rows(source, synced, ["k"], options)) == dict(missing=0, extra=0, different=0, equal=4)
    assert {(r.k, r.v, r.own) for r in synced.collect()} == {(1, 5, "x"), (1, 7, "y"), (1, 9, None), (2, 1, None)}


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    spark.sql("create database if not exists keel_test location '%s'" % tmp_path)
    try:
        source, target = queries.orders_pair(spark, "/root/testdata/sf0.001")
        bucketed_copy(source, "keel_test.s", ["o_orderkey"], 4)
        bucketed_copy(target, "keel_test.t", ["o_orderkey"], 4)
        threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        diff = rowdiff.diff_rows(spark.table("keel_test.s"), spark.table("keel_test.t"), ["o_orderkey"])
        plan = diff.df._jdf.queryExecution().executedPlan().toString()
        assert threshold and "SortMergeJoin" in plan and "Exchange" not in plan
        assert counts(diff) == counts(rowdiff.diff_rows(source, target, ["o_orderkey"]))
    finally:
        spark.sql("drop database keel_test cascade")


def test_scan_reads_needed_columns_only(spark):
    orders = table(spark, SF, "orders")
    narrow = orders.select("o_orderkey", "o_custkey")
    diff = rowdiff.diff_rows(orders, narrow, ["o_orderkey"])
    plan = diff.df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_rows_without_a_key_are_applied(spark):
    """Null keys, wholly or in part, repeated, and beside a key that both sides have."""
    schema = "a int, b string, v int"
    source = spark.createDataFrame([(1, "x", 1), (None, "x", 2), (None, None, 3), (None, None, 3), (2, None, 4)], schema)
    target = spark.createDataFrame([(1, "x", 9), (None, "x", 2), (None, None, 7), (None, None, 7), (3, None, 5), (4, "y", 6)], schema)
    synced = rowdiff.apply_changes(source, target, ["a", "b"])
    assert sorted(map(repr, synced.collect())) == sorted(map(repr, source.collect()))
    kept = rowdiff.apply_changes(source, target, ["a", "b"], rowdiff.RowDiffOptions(include_deletes=False))
    assert kept.count() == 10  # every row of the target stays, four of the source are new
    safe = rowdiff.apply_changes(source.distinct(), target.distinct(), ["a", "b"], rowdiff.RowDiffOptions(null_safe_keys=True))
    assert sorted(map(repr, safe.collect())) == sorted(map(repr, source.distinct().collect()))


def test_numbering_within_ranges_moves_no_row(spark):
    """The ranges lie in buckets by part: the plan has no exchange by it, and numbers are right over range borders."""
    from pyspark.sql import functions as F

    from evenkeel.operators.occurrences import number_occurrences

    rows = spark.range(4000).select(F.when(F.col("id") % 4 > 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 900).alias("v"))
    got = number_occurrences(rows, ["k"], ["v"])
    assert "hashpartitioning(_part" not in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    want, seen = [], {}
    for k, v in sorted((r.k, r.v) for r in rows.collect()):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, v, seen[k]))
    assert sorted(map(tuple, got.collect())) == want
