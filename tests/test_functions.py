from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evenkeel.functions import text
from evenkeel.functions.dialect import POSTGRESQL, SQL_SERVER
from evenkeel.plans.batches import split_batches
from evenkeel.sources.mssql import format_type


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def slow_normal_form(s):
    s = " ".join(s.split()).lower()
    while len(s) >= 2 and s[0] == "(" and s[-1] == ")":
        depths = list(itertools.accumulate((c == "(") - (c == ")") for c in s))
        if 0 in depths[:-1]:
            break
        s = s[1:-1].strip()
    return s


@pytest.mark.parametrize(
    "given, expected",
    [
        ("(( ( Tide ) ))", "tide"),
        ("(moon_phase(day))", "moon_phase(day)"),
        ("(Ebb)*(Flow)", "(ebb)*(flow)"),
        ("\t depth\n<\t\t90 ", "depth < 90"),
        ("((depth", "((depth"),
        (")(", ")("),
        ("", ""),
        (None, ""),
    ],
)
def test_expressions(spark, given, expected):
    assert one(spark, given, text.normalize_expression) == expected


def test_parentheses_against_brute_force(spark):
    rng = random.Random(7)
    cases = ["".join(p) for n in range(7) for p in itertools.product("()a", repeat=n)]
    cases += ["".join(rng.choice("(()) a") for _ in range(rng.randint(5, 30))) for _ in range(1000)]
    cases.append("(" * 200 + "x" + ")" * 200)
    rows = spark.createDataFrame([(c, slow_normal_form(c)) for c in cases], "t string, want string")
    wrong = rows.filter(text.normalize_expression(F.col("t")) != F.col("want"))
    assert wrong.collect() == []


def test_modules(spark):
    lines = lambda c: text.normalize_module(c, collapse=False)
    unix, dos = "harbour\n  pier\tone\n\nlast", "harbour \r\n  pier\tone\t\r\n\r\nlast\r\n\r\n"
    assert one(spark, dos, lines) == one(spark, unix, lines) == unix
    assert one(spark, "\n\t\n    quay\n", lines) == "    quay"
    assert one(spark, "harbour\n\n\tpier     one\r\n", text.normalize_module) == "harbour pier one"
    assert [one(spark, empty, fn) for empty in (None, "", "\t\n") for fn in (lines, text.normalize_module)] == [""] * 6


def test_create_or_alter(spark):
    assert one(spark, "create  VIEW tide.Low as create procedure x", text.create_or_alter) == "CREATE OR ALTER VIEW tide.Low as create procedure x"
    for same in ("CREATE OR ALTER FUNCTION tide.High()", "CREATE SEQUENCE tide.Ids", "ALTER VIEW tide.Low"):
        assert one(spark, same, text.create_or_alter) == same


VALUES = [
    # SQL expression, SQL Server literal, PostgreSQL literal
    ("cast(null as time)", "NULL", "NULL"),
    ("\"dArc's\"", "N'dArc''s'", "'dArc''s'"),
    ("''", "N''", "''"),
    ("false", "0", "FALSE"),
    ("unhex('C0DE07')", "0xC0DE07", "'\\xC0DE07'"),
    ("cast(-7.5 as decimal(9,3))", "-7.500", "-7.500"),
    ("cast(12345678901234567890 as decimal(38,0))", "12345678901234567890", "12345678901234567890"),
    ("timestamp_ntz'1999-12-31 23:59:59'", "'1999-12-31T23:59:59'", "'1999-12-31 23:59:59.000000'"),
    ("timestamp_ntz'1999-12-31 23:59:59.012300'", "'1999-12-31T23:59:59.0123'", "'1999-12-31 23:59:59.012300'"),
    ("timestamp'2001-02-03 04:05:06.7+02:00'", "'2001-02-03 02:05:06.7000000 +00:00'", "'2001-02-03 02:05:06.700000+00'"),
    ("date'1582-10-15'", "'1582-10-15'", "'1582-10-15'"),
    ("interval '00:00:59.25' hour to second", "'00:00:59.2500000'", "'00:00:59.250000'"),
    ("time'23:05:00.000125'", "'23:05:00.0001250'", "'23:05:00.000125'"),
    ("time'00:00:00'", "'00:00:00.0000000'", "'00:00:00.000000'"),
    ("-3D", "-3", "-3"),
    ("6.25e15D", "6.25E+15", "6.25E+15"),
    ("-98765.4321D", "-98765.4321", "-98765.4321"),
    ("0.00025D", "0.00025", "0.00025"),
    ("2.5e-7D", "2.5E-07", "2.5E-07"),
    ("float('1.5e-10')", "1.5E-10", "1.5E-10"),
    ("double('NaN')", "NULL", "'NaN'"),
    ("double('Infinity')", "NULL", "'Infinity'"),
    ("float('-Infinity')", "NULL", "'-Infinity'"),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_literals(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        rows = spark.sql("select " + ", ".join(f"{v} as c{i}" for i, (v, _, _) in enumerate(VALUES)))
        for dialect, place in ((SQL_SERVER, 1), (POSTGRESQL, 2)):
            got = rows.select(*[dialect.literal(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema]).first()
            assert list(got) == [v[place] for v in VALUES]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
        spark.conf.unset("spark.sql.timeType.enabled")


def test_type_text(spark):
    """Lengths are in bytes, two for each national character; only some types show scale or precision."""
    cases = [
        ("nchar", 14, 0, 0, "nchar(7)"), ("nvarchar", -1, 0, 0, "nvarchar(MAX)"), ("varbinary", -1, 0, 0, "varbinary(MAX)"),
        ("char", 3, 0, 0, "char(3)"), ("numeric", 5, 7, 0, "numeric(7,0)"), ("time", 5, 16, 3, "time(3)"), ("bigint", 8, 19, 0, "bigint"),
    ]
    rows = spark.createDataFrame(cases, "n string, m int, p int, s int, want string")
    assert rows.filter(format_type(*map(F.col, "nmps")) != F.col("want")).count() == 0


def batches(spark, script, dialect=SQL_SERVER):
    rows = split_batches(spark.createDataFrame([(1, script)], "id int, script string"), dialect, ["id"])
    return [r.batch for r in rows.orderBy("batch_no").collect()]


def test_batches(spark):
    assert batches(spark, "raise anchor\r\n  Go  \r\nset sail\n\nGO\n\nGO -- and back\nmoor") == ["raise anchor", "set sail", "moor"]
    one_batch = "let GO = 1\nlet cargo = 2\nGO 5 knots\n'GO'"
    assert batches(spark, one_batch) == [one_batch]
    assert batches(spark, "GO\nmoor\nGO\nGO") == ["moor"]
    assert batches(spark, "moor;\nGO\nsail;", POSTGRESQL) == ["moor;\nGO\nsail;"]
    assert batches(spark, "\t\n\n", POSTGRESQL) == []


def test_name_search_drops_pieces_that_no_name_has(spark):
    """Names of one to five letters, in text of other words: only their pieces pass the table of bits, and all of them do."""
    from pyspark.sql import functions as F

    from evenkeel.plans import ordering

    names = ["a", "be", "Öl%", "x.y!", "obj_17", "obj_1", ""]
    rows = [(1, "view", n, f"{'filler words ' * 50}{names[(i + 1) % 6]}{names[(i + 3) % 6].upper()} ", i) for i, n in enumerate(names)]
    objects = spark.createDataFrame(rows, "pair_id long, kind string, name string, definition string, input_ord int")
    want = {(i, j) for _, _, _, text, i in rows for _, _, n, _, j in rows if n and i != j and n.upper() in text.upper()}
    assert {(r.input_ord, r.needs) for r in ordering.mentions(objects).collect()} == want
    pieces = spark.createDataFrame([(4, "OBJ_"), (4, "BJ_1"), (2, "BE")], "_size int, _gram string")
    sizes, test = ordering._filter(pieces)
    others = spark.range(1000).select((F.col("id") + 5000).cast("string").alias("_gram"))
    assert sizes == [2, 4] and pieces.where(test(F.col("_gram"))).count() == 3 and others.where(test(F.col("_gram"))).count() < 10
