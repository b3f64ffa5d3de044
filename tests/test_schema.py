from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from evenkeel.functions.dialect import POSTGRESQL, SQL_SERVER
from evenkeel.operators.schemadiff import FINDING_ORDER, SchemaDiff
from evenkeel.options import CompareOptions, ScriptOptions
from evenkeel.plans import ordering
from evenkeel.plans.deploy import PLAN_ORDER, DeploymentPlan
from evenkeel.sources import sinks, snapshot
from suite.fleet import wide_catalog

SF = "/root/testdata/sf0.01"


def col(table, name, kind, nullable=True, default=None, identity=None, ordinal=1, schema="dbo", default_name=None):
    return (schema, table, name, ordinal, kind, nullable, default, default_name, identity, None, False, None)


def snap(spark, source, target, provider="SQL Server"):
    """A snapshot of one pair from dictionaries of row lists."""
    frames = {}
    for name, ddl in snapshot.SCHEMAS.items():
        rows = []
        for side, parts in (("source", source), ("target", target)):
            given = list(parts.get(name, []))
            if name == "databases":
                given = [(provider, side[0])]
            if name == "tables":
                given += sorted({(c[0], c[1]) for c in parts.get("columns", [])} - set(given))
            if name == "schemas" and not given:
                given = [("dbo",)]
            rows += [(1, side, *r) for r in given]
        frames[name] = spark.createDataFrame(rows, ddl)
    return snapshot.Snapshot(**frames)


def key(table, name, columns, primary=True, schema="dbo", clustered=True):
    return (schema, table, name, primary, clustered and primary, [(i, c, False) for i, c in enumerate(columns)])


def index(table, name, unique, columns, raw=None, schema="dbo"):
    return (schema, table, name, unique, False, [(i, c, False) for i, c in enumerate(columns)], [], None, raw)


def objects(s, **options):
    rows = SchemaDiff(s, CompareOptions(**options)).objects.orderBy("type_ord", F.upper("schema"), F.upper("name"))
    return [(r.type, f"{r.schema}.{r.name}", r.status, r.preview) for r in rows.collect()]


def script(s, dialect=SQL_SERVER, **options):
    rows = DeploymentPlan(s, dialect, script=ScriptOptions(**options)).rows
    return "\n".join(r.text for r in rows.orderBy(*PLAN_ORDER).collect())


@pytest.fixture(scope="module")
def weather(spark):
    """A network of weather stations: as it should be, and a copy on which people have worked by hand."""
    station = [col("Stations", "Code", "char(6)", False, ordinal=1)]
    taken = col("Readings", "TakenAt", "datetime2(3)", False, ordinal=2, schema="log")
    reads = [col("Readings", "Station", "char(6)", False, ordinal=1, schema="log"), taken, col("Readings", "Quality", "tinyint", False, ordinal=4, schema="log")]

    def link(action):
        return [("log", "Readings", "FK_Readings_Stations", [(1, "Station", "Code")], "dbo", "Stations", action, "NO ACTION")]

    source = {
        "schemas": [("dbo",), ("log",)],
        "columns": station + reads + [
            col("Stations", "Region", "nvarchar(40)", ordinal=2), col("Stations", "Height", "decimal(7,2)", False, "((0.5))", ordinal=3, default_name="DF_Height"),
            col("Readings", "Celsius", "real", ordinal=3, schema="log"),
            col("Sensors", "Serial", "bigint", False, identity="IDENTITY(100,5)", ordinal=1), col("Sensors", "Maker", "varchar(30)", default="('n/a')", ordinal=2, default_name="DF_Maker"),
        ],
        "keys": [key("Stations", "PK_Stations", ["Code"]), key("Readings", "PK_Readings", ["Station", "TakenAt"], schema="log"), key("Sensors", "PK_Sensors", ["Serial"])],
        "fks": link("NO ACTION"),
        "indexes": [index("Sensors", "IX_Maker", False, ["Maker"]), index("Readings", "IX_Quality", False, ["Quality", "TakenAt"], schema="log")],
        "code_objects": [
            ("function", "dbo", "Fahrenheit", "CREATE FUNCTION dbo.Fahrenheit (@c real) RETURNS real AS BEGIN RETURN @c * 1.8 + 32 END", None, 1),
            ("view", "log", "Warm", "CREATE VIEW log.Warm AS SELECT dbo.Fahrenheit(Celsius) AS f FROM log.Readings", None, 2),
            ("procedure", "log", "Purge", "CREATE PROCEDURE log.Purge AS DELETE FROM log.Readings WHERE Quality = 0", None, 3)],
    }
    target = {
        "schemas": source["schemas"],
        "columns": station + reads + [
            col("Stations", "Region", "nvarchar(40)", False, ordinal=2), col("Stations", "Height", "decimal(7,2)", False, ordinal=3),
            col("Readings", "Kelvin", "real", ordinal=3, schema="log"), col("Retired", "Code", "char(6)", False),
        ],
        "keys": [key("Stations", "PK_Stations", ["Code"]), key("Readings", "PK_Readings", ["TakenAt"], schema="log")],
        "fks": link("CASCADE"),
        "indexes": [index("Readings", "IX_Quality", False, ["Quality"], schema="log")],
        "checks": [("dbo", "Stations", "CK_Height", "([Height]<(9000))")],
        "code_objects": [
            ("function", "dbo", "Fahrenheit", "CREATE FUNCTION dbo.Fahrenheit (@c real) RETURNS real AS BEGIN RETURN @c * 2 + 30 END", None, 1),
            ("view", "log", "Warm", "create  view log.Warm as SELECT dbo.Fahrenheit(Celsius) AS f FROM log.Readings", None, 2),
            ("trigger", "log", "Stamp", "CREATE TRIGGER log.Stamp ON log.Readings AFTER INSERT AS SELECT 1", "log.Readings", 4)],
    }
    return snap(spark, source, target)


def test_weather_objects(weather):
    assert objects(weather) == [
        ("Table", "dbo.Retired", "TargetOnly", ""),
        ("Table", "dbo.Sensors", "SourceOnly", ""),
        ("Table", "dbo.Stations", "Different",
         "Column [Region]: NOT NULL → NULL; Column [Height]: default (none) → ((0.5)); Check constraint [CK_Height]: only in target"),
        ("Table", "log.Readings", "Different",
         "Column [Celsius]: missing in target (real); Column [Kelvin]: only in target (real); "
         "Primary key: (TakenAt) → (Station, TakenAt); Foreign key [FK_Readings_Stations]: definition differs … (+1)"),
        ("View", "log.Warm", "Different", "Definition differs"),
        ("Procedure", "log.Purge", "SourceOnly", ""),
        ("Function", "dbo.Fahrenheit", "Different", "Definition differs"),
        ("Trigger", "log.Stamp", "TargetOnly", ""),
    ]


def test_weather_script(weather, tmp_path):
    """What must go before what: links and keys before what they rest on, and back in the other order."""
    text = script(weather)

    def at(line):
        assert text.count(line) == 1, line
        return text.index(line)

    readings = "ALTER TABLE [log].[Readings] "
    unlink, relink = at(readings + "DROP CONSTRAINT [FK_Readings_Stations];"), at(readings + "ADD CONSTRAINT [FK_Readings_Stations] FOREIGN KEY ([Station]) REFERENCES [dbo].[Stations] ([Code]);")
    unkey, rekey = at(readings + "DROP CONSTRAINT [PK_Readings];"), at(readings + "ADD CONSTRAINT [PK_Readings] PRIMARY KEY CLUSTERED ([Station], [TakenAt]);")
    assert at("DROP TRIGGER IF EXISTS [log].[Stamp];") < unlink < unkey < at(readings + "ADD [Celsius] real NULL;") < rekey < relink
    assert at("DROP INDEX [IX_Quality] ON [log].[Readings];") < at("CREATE INDEX [IX_Quality] ON [log].[Readings] ([Quality], [TakenAt]);") < relink
    assert at("ALTER TABLE [dbo].[Stations] DROP CONSTRAINT [CK_Height];") < at("ALTER TABLE [dbo].[Stations] ALTER COLUMN [Region] nvarchar(40) NULL;")
    assert at("ALTER TABLE [dbo].[Stations] ADD CONSTRAINT [DF_Height] DEFAULT ((0.5)) FOR [Height];") < rekey
    for gone in ("DROP TABLE [dbo].[Retired];", readings + "DROP COLUMN [Kelvin];"):
        assert text[: at(gone)].rstrip("\n").split("\n")[-1].startswith("-- WARNING: ")
    made = "CREATE TABLE [dbo].[Sensors] (\n    [Serial] bigint IDENTITY(100,5) NOT NULL,\n    [Maker] varchar(30) NULL CONSTRAINT [DF_Maker] DEFAULT ('n/a'),\n"
    assert at(made + "    CONSTRAINT [PK_Sensors] PRIMARY KEY CLUSTERED ([Serial])\n);\n") < at("CREATE INDEX [IX_Maker] ON [dbo].[Sensors] ([Maker]);")
    assert relink < at("CREATE OR ALTER FUNCTION dbo.Fahrenheit") < at("GO\nCREATE OR ALTER VIEW log.Warm") < at("CREATE OR ALTER PROCEDURE log.Purge")
    assert at("BEGIN TRANSACTION;") < unlink and text.endswith("COMMIT TRANSACTION;\nGO")
    rows = DeploymentPlan(weather, SQL_SERVER).rows
    sinks.write_scripts_by_pair(rows, PLAN_ORDER, str(tmp_path / "out"))
    folder = tmp_path / "out" / "pair_id=1"
    saved = "".join((folder / f).read_text() for f in sorted(os.listdir(folder)) if f.endswith(".txt"))
    assert saved == text + "\n"


def test_nothing_without_drops(weather):
    text = script(weather, include_drops=False, use_transaction=False)
    assert "Retired" not in text and "Kelvin" not in text and "Stamp" not in text and "COMMIT" not in text


def test_selection(spark, weather):
    chosen = spark.createDataFrame([(1, "Table", "DBO", "sensors"), (1, "View", "LOG", "warm")], "pair_id int, type string, schema string, name string")
    rows = DeploymentPlan(weather, SQL_SERVER, selection=chosen).rows
    text = "\n".join(r.text for r in rows.orderBy(*PLAN_ORDER).collect())
    assert "[dbo].[Sensors]" in text and "VIEW log.Warm" in text
    assert not any(other in text for other in ("Stations", "[Readings]", "Purge", "Retired", "Stamp"))


def test_single_findings(spark):
    def details(source, target, **options):
        rows = SchemaDiff(snap(spark, source, target), CompareOptions(**options)).findings
        return [r.detail for r in rows.orderBy(*FINDING_ORDER).collect()]

    a, b = [col("T", "A", "int")], [col("T", "A", "int", default="0")]
    assert details({"columns": [col("T", "A", "int", default="((0))")]}, {"columns": b}) == []
    assert details({"columns": a, "indexes": [index("T", "IX", True, ["A"])]}, {"columns": a, "indexes": [index("T", "IX", False, ["A"])]}) == [
        "Index [IX]: definition differs"]
    two = [col("T", "A", "int"), col("T", "B", "int", ordinal=2)]
    assert details({"columns": two, "keys": [key("T", "PK", ["A", "B"])]}, {"columns": two, "keys": [key("T", "PK", ["A"])]}) == [
        "Primary key: (A) → (A, B)"]
    new = details({"columns": a + [col("T", "New", "int", ordinal=2)]}, {"columns": a + [col("T", "Old", "int", ordinal=2)]})
    assert new == ["Column [New]: missing in target (int)", "Column [Old]: only in target (int)"]


def test_case_and_whitespace_options(spark):
    upper = snap(spark, {"columns": [col("Orders", "Id", "int")]}, {"columns": [col("ORDERS", "Id", "int")]})
    assert [o[2] for o in objects(upper)] == ["Equal"]
    assert sorted(o[2] for o in objects(upper, ignore_case=False)) == ["SourceOnly", "TargetOnly"]
    views = [{"code_objects": [("view", "dbo", "V", d, None, 1)]} for d in ("CREATE VIEW dbo.V AS\r\nSELECT  1  AS x", "CREATE VIEW dbo.V AS SELECT 1 AS x")]
    assert objects(snap(spark, *views))[0][2] == "Equal"
    assert objects(snap(spark, *views), ignore_whitespace_in_modules=False)[0][2] == "Different"


def test_postgres_statements(spark):
    source = {
        "columns": [col("t", "price", "numeric(18,4)", False), col("t", "name", "text", False, ordinal=2)],
        "indexes": [index("t", "ix_t_a", True, ["a"], raw="CREATE UNIQUE INDEX ix_t_a ON dbo.t USING btree (a)")],
        "code_objects": [("view", "dbo", "v", 'CREATE OR REPLACE VIEW "dbo"."v" AS\nSELECT 2;', None, 1)],
    }
    target = {
        "columns": [col("t", "price", "numeric(10,2)", False), col("t", "name", "text", True, ordinal=2)],
        "code_objects": [("view", "dbo", "v", 'CREATE OR REPLACE VIEW "dbo"."v" AS\nSELECT 1;', None, 1),
                         ("function", "dbo", "fn(integer, text)", "CREATE FUNCTION ...", None, 2), ("trigger", "dbo", "trg", "CREATE TRIGGER trg ...", "dbo.orders", 3)],
    }
    text = script(snap(spark, source, target, "PostgreSQL"), POSTGRESQL)
    for line in [
        'ALTER TABLE "dbo"."t" ALTER COLUMN "price" TYPE numeric(18,4) USING "price"::numeric(18,4);', 'ALTER TABLE "dbo"."t" ALTER COLUMN "name" SET NOT NULL;',
        "CREATE UNIQUE INDEX ix_t_a ON dbo.t USING btree (a);", 'DROP FUNCTION IF EXISTS "dbo"."fn"(integer, text);', 'DROP TRIGGER IF EXISTS "trg" ON "dbo"."orders";',
    ]:
        assert line in text
    assert text.index('DROP VIEW IF EXISTS "dbo"."v";') < text.index('CREATE OR REPLACE VIEW "dbo"."v" AS\nSELECT 2;')
    assert text.index("BEGIN;") < text.index("DROP TRIGGER") < text.index("DROP VIEW") < text.index("DROP FUNCTION") < text.index("COMMIT;")


def order(spark, rows):
    df = spark.createDataFrame([(1, *r) for r in rows], "pair_id int, kind string, name string, definition string, input_ord int")
    return [r.name for r in ordering.creation_order(df).orderBy("kind_ord", "level", "input_ord").collect()]


def test_creation_order(spark):
    assert order(spark, [("view", "v_outer", "SELECT x FROM dbo.V_INNER", 1), ("view", "v_inner", "SELECT 1", 2)]) == ["v_inner", "v_outer"]
    mixed = [("trigger", "trg", "x", 1), ("view", "v", "SELECT dbo.fn()", 2), ("procedure", "p", "x", 3), ("function", "fn", "x", 4)]
    assert order(spark, mixed) == ["fn", "v", "p", "trg"]


def test_creation_order_of_cycles_and_chains(spark):
    cycle = [("view", "aa", "uses bb", 1), ("view", "bb", "uses aa", 2), ("view", "cc", "uses bb", 3), ("view", "dd", "alone", 4)]
    assert order(spark, cycle) == ["dd", "aa", "bb", "cc"]
    chain = [("view", f"n{i:02d}", f"uses n{i + 1:02d}" if i < 19 else "end", i) for i in range(20)]
    assert order(spark, chain) == [f"n{i:02d}" for i in reversed(range(20))]


def test_levels_of_a_pair_do_not_depend_on_the_fleet(spark):
    kind = "pair_id int, kind string, name string, definition string, input_ord int"
    ring = [(1, "view", f"ring{i}", f"uses ring{(i + 1) % 3}", i) for i in range(3)] + [(1, "view", "tail", "uses ring0", 3)]
    chain = [(2, "view", f"n{i:02d}", f"uses n{i + 1:02d}" if i < 9 else "end", i) for i in range(10)]
    levels = {}
    for name, rows in (("alone", ring), ("fleet", ring + chain)):
        found = ordering.creation_order(spark.createDataFrame(rows, kind)).filter("pair_id = 1").collect()
        levels[name] = {r.name: r.level for r in found}
    assert levels["alone"] == levels["fleet"] == {"ring0": 1, "ring1": 3, "ring2": 2, "tail": 2}


def test_mentions_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randint(0, 1), "view", "".join(rng.choice("ab_C") for _ in range(rng.randint(1, 6))), "".join(rng.choice("ab_Cc ") for _ in range(rng.randint(0, 60))), i) for i in range(60)]
    df = spark.createDataFrame(rows, "pair_id int, kind string, name string, definition string, input_ord int")
    got = {(r.input_ord, r.needs) for r in ordering.mentions(df).collect()}
    want = {(a[4], b[4]) for a in rows for b in rows if a[0] == b[0] and a[4] != b[4] and b[2].upper() in a[3].upper()}
    assert got == want


def test_wide_catalog_counts(spark):
    findings = SchemaDiff(wide_catalog(spark, SF)).column_findings
    got = {r.aspect: r.n for r in findings.groupBy("aspect").agg(F.count("*").alias("n")).collect()}
    assert got == {"missing": 87, "extra": 69, "type": 147, "nullability": 112, "default": 101}
    assert findings.filter("aspect not in ('missing', 'extra')").select("schema", "table", "item").distinct().count() == 337


def test_snapshot_of_real_tables(spark):
    left = spark.createDataFrame([], "id bigint, name string")
    right = spark.createDataFrame([], "id int, name string, extra date")
    rows = snapshot.columns_of(left, 1, "source", "s", "t").unionByName(snapshot.columns_of(right, 1, "target", "s", "t"))
    s = snapshot.build(spark, columns=rows, tables=rows.select("pair_id", "side", "schema", "table").distinct())
    assert [o[3] for o in objects(s)] == ["Column [id]: type int → bigint; Column [extra]: only in target (date)"]


def test_code_ordered_together_as_apart(spark):
    """Two sets of objects with equal keys take their rounds together, without a word between them."""
    from evenkeel.plans.ordering import creation_order, creation_orders

    schema = "pair_id long, kind string, name string, definition string, input_ord int"
    one = [(1, "view", "aaaa", "bbbb cccc", 1), (1, "view", "bbbb", "cccc", 2), (1, "view", "cccc", "", 3), (1, "trigger", "dddd", "aaaa", 4)]
    two = [(1, "view", "aaaa", "", 1), (1, "view", "bbbb", "aaaa", 2), (2, "function", "ring", "loop", 1), (2, "function", "loop", "ring", 2)]
    sets = [spark.createDataFrame(rows, schema) for rows in (one, two, [])]
    for alone, together in zip(map(creation_order, sets), creation_orders(sets)):
        assert together.columns == alone.columns
        assert sorted(together.collect()) == sorted(alone.collect())
    assert {r.level for r in creation_orders(sets)[0].collect()} == {0, 1, 2}
