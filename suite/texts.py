"""Queries over texts: normalisation, code objects, line compare, creation order, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import text
from evenkeel.functions.dialect import POSTGRESQL, SQL_SERVER
from evenkeel.operators import codediff, linediff
from evenkeel.options import CompareOptions
from evenkeel.plans import batches, ordering
from suite.base import load, oracle, recipe, table

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


# The white space both engines must agree on, as RE2 and as a character list.
_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WS_CHARS = " || ".join(f"chr({ord(c)})" for c in text.WHITESPACE)


def collapsed(col):
    return f"trim(regexp_replace({col}, '{_WS}+', ' ', 'g'))"


def lines_form(col):
    unix = f"regexp_replace({col}, '\\r\\n?', chr(10), 'g')"
    return (
        f"trim(array_to_string(list_transform(string_split({unix}, chr(10)), lambda x: rtrim(x, {_WS_CHARS})), chr(10)), chr(10))"
    )


# Inputs ----------------------------------------------------------------------
recipe("docs_s", "select doc_id, source as sch, lang || '_' || doc_id as name, text as def from {documents}")
recipe(
    "docs_t",
    """
select doc_id, sch, name,
       case when doc_id % 11 = 0 then def || ' -- changed'
            when doc_id % 7 = 0 then replace(def, ' ', '  ') else def end as def
from docs_s where doc_id % 23 <> 0
union all
select doc_id, sch, name || '_extra', def from docs_s where doc_id % 31 = 0
""",
)
# Line ends of all kinds and blanks around lines.
recipe(
    "docs_messy",
    """
select doc_id, case when doc_id % 3 = 0 then chr(10) || ' ' || chr(13) || chr(10) || replace(text, '.', '.  ' || chr(13) || chr(10)) || chr(10) || ' '
                    when doc_id % 3 = 1 then replace(text, ' ', chr(9) || ' ') || chr(13) || chr(13)
                    when doc_id % 5 = 0 then null else text end as text
from {documents}
""",
)
recipe(
    "doc_objects",
    """
select cast(1 as bigint) as pair_id, 'source' as side, 'view' as kind, sch as schema, name, def as definition from docs_s
union all
select cast(1 as bigint), 'target', 'view', sch, case when doc_id % 5 = 0 then upper(name) else name end, def from docs_t
""",
)
# Databases of 50 objects each; most definitions mention one or two earlier objects.
recipe(
    "code_docs",
    """
select cast(floor(doc_id / 50) as bigint) as pair_id,
       case doc_id % 4 when 0 then 'view' when 1 then 'function' when 2 then 'procedure' else 'trigger' end as kind,
       'obj_' || doc_id as name,
       text || case when doc_id % 50 >= 4 then ' join Obj_' || (doc_id - 4) else '' end
            || case when doc_id % 50 >= 20 and doc_id % 3 = 0 then ' and OBJ_' || (doc_id - 20) || '(x)' else '' end as definition,
       cast(doc_id as int) as input_ord
from {documents}
""",
)


# Normalisation -------------------------------------------------------------------
def _one(name, spark_expr, duck_expr, rel="docs_messy", key="doc_id", col="text"):
    def run(spark, sf):
        return load(spark, sf, rel).select(key, spark_expr(F.col(col)).alias("result"))

    QUERIES[name] = run
    ORACLES[name] = oracle(f"select {key}, {duck_expr} as result from {rel}")


_one("collapse_ws", text.collapse_whitespace, collapsed("text"))
_one("norm_module_ws", lambda c: text.normalize_module(c, True), f"coalesce({collapsed('text')}, '')")
_one("norm_module_lines", lambda c: text.normalize_module(c, False), f"coalesce({lines_form('text')}, '')")

recipe(
    "definitions",
    """
select doc_id, case doc_id % 5 when 0 then 'create  view ' when 1 then 'CREATE OR ALTER' || chr(10) || 'PROC ' when 2 then '-- CREATE it' || chr(10) || 'Create Function '
               when 3 then 'create table x; CREATE TRIGGER ' else 'created viewer ' end || text as text
from {documents}
""",
)
_one(
    "create_or_alter",
    text.create_or_alter,
    r"regexp_replace(text, '(?i)\bCREATE\s+(?:OR\s+ALTER\s+)?(VIEW|PROC(?:EDURE)?|FUNCTION|TRIGGER)\b', 'CREATE OR ALTER \1')",
    rel="definitions",
)
recipe(
    "type_texts",
    """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case l_linenumber % 4 when 0 then 'NVARCHAR (' || l_partkey || ')' when 1 then ' Decimal(' || l_suppkey || ',2)'
                             when 2 then 'int' else 'Character Varying(' || l_suppkey || ')' end as type_text
from {lineitem}
""",
)


@query("base_type")
def _(spark, sf):
    rows = load(spark, sf, "type_texts")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.base_type(F.col("type_text")).alias("base"))


ORACLES["base_type"] = oracle(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, lower(trim(split_part(type_text, '(', 1))) as base from type_texts"
)

recipe(
    "routine_names",
    """
select event_id, case when event_id % 3 = 0 then event_type else event_type || '(integer, ' || props || ')' end as name,
       case when event_id % 4 = 0 then null when event_id % 4 = 1 then event_type else event_type || '.a.' || user_id end as parent
from {events}
""",
)


@query("routine_ref")
def _(spark, sf):
    rows = load(spark, sf, "routine_names")
    parent_schema, parent_table = text.split_parent(F.col("parent"))
    return rows.select(
        "event_id",
        text.routine_name(F.col("name")).alias("bare"),
        text.routine_arguments(F.col("name")).alias("args"),
        parent_schema.alias("parent_schema"),
        parent_table.alias("parent_table"),
    )


ORACLES["routine_ref"] = oracle(
    """
select event_id, split_part(name, '(', 1) as bare,
       case when contains(name, '(') then regexp_extract(name, '(?s)\\(.*$') else '()' end as args,
       case when contains(parent, '.') then split_part(parent, '.', 1) end as parent_schema,
       case when contains(parent, '.') then parent[strpos(parent, '.') + 1:] else coalesce(parent, '') end as parent_table
from routine_names
"""
)


# Code objects ----------------------------------------------------------------------
def _code(spark, sf, **options):
    return codediff.compare_code(load(spark, sf, "doc_objects"), CompareOptions(**options)).drop("pair_id")


@query("code_objects_ws")
def _(spark, sf):
    return _code(spark, sf)


@query("code_objects_lines")
def _(spark, sf):
    return _code(spark, sf, ignore_whitespace_in_modules=False)


def _code_oracle(norm):
    return oracle(
        """
select 'View' as type, coalesce(s.schema, t.schema) as schema, coalesce(s.name, t.name) as name,
       case when t.k is null then 'SourceOnly' when s.k is null then 'TargetOnly' when s.d <> t.d then 'Different' else 'Equal' end as status
from s full outer join t on s.k = t.k
""",
        {
            side: f"select schema, name, upper(schema || '.' || name) as k, {norm('definition')} as d from doc_objects where side = '{full}'"
            for side, full in (("s", "source"), ("t", "target"))
        },
    )


ORACLES["code_objects_ws"] = _code_oracle(collapsed)
ORACLES["code_objects_lines"] = _code_oracle(lines_form)


# Lines -------------------------------------------------------------------------------
def _lines(spark, sf):
    return linediff.line_diff(load(spark, sf, "lines_s"), load(spark, sf, "lines_t"), ["doc_id"])


# Every fifth line changes; some texts exist on one side only.
recipe("lines_s", "select doc_id, text as definition from {documents} where doc_id % 41 <> 0")
recipe(
    "lines_t",
    """
select doc_id, case when doc_id % 2 = 0 then replace(replace(text, 'e.' || chr(10), 'e!' || chr(10)), 'a.', 'a.' || chr(10) || '-- new')
                    else text || chr(10) || text end as definition
from {documents} where doc_id % 37 <> 0
""",
)


@query("line_diff")
def _(spark, sf):
    return _lines(spark, sf)


@query("line_diff_summary")
def _(spark, sf):
    return linediff.line_diff_summary(load(spark, sf, "lines_s"), load(spark, sf, "lines_t"), ["doc_id"])


_LINE_STEPS = {
    side: f"""
select doc_id, line_no, line, row_number() over (partition by doc_id, line order by line_no) as occ from (
  select doc_id, unnest(range(len(l))) as line_no, unnest(l) as line from (
    select doc_id, string_split(definition, chr(10)) as l from lines_{side}))
"""
    for side in "st"
} | {
    "d": """
select coalesce(s.doc_id, t.doc_id) as doc_id, coalesce(s.line_no, t.line_no) as line_no, coalesce(s.line, t.line) as line,
       case when t.occ is null then 'deleted' when s.occ is null then 'inserted' else 'unchanged' end as status
from s full outer join t on s.doc_id = t.doc_id and s.line = t.line and s.occ = t.occ
"""
}
ORACLES["line_diff"] = oracle("select doc_id, cast(line_no as int) as line_no, line, status from d", _LINE_STEPS)
ORACLES["line_diff_summary"] = oracle(
    "select doc_id, count(*) filter (status = 'deleted') as deleted, count(*) filter (status = 'inserted') as inserted, "
    "count(*) filter (status = 'unchanged') as unchanged from d group by doc_id",
    _LINE_STEPS,
)


# In every third text of some lines the first line moves to the end.
recipe(
    "lines_moved",
    """
select doc_id, case when doc_id % 3 = 0 and instr(definition, chr(10)) > 0
                    then substr(definition, instr(definition, chr(10)) + 1) || chr(10) || substr(definition, 1, instr(definition, chr(10)) - 1)
                    else definition end as definition
from lines_t
""",
)


def _rebuilt(without):
    """Digest of the lines of one version, put together in the order of the listing."""
    lines = F.collect_list(F.when(F.col("status") != without, F.struct("position", "line")))
    return F.md5(F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n"))


@query("line_diff_ordered")
def _(spark, sf):
    listing = linediff.ordered_diff(load(spark, sf, "lines_s"), load(spark, sf, "lines_moved"), ["doc_id"])
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("deleted", "inserted", "unchanged")]
    return listing.groupBy("doc_id").agg(*counts, _rebuilt("inserted").alias("source_md5"), _rebuilt("deleted").alias("target_md5"))


# Row i of the table of longest common subsequences follows from row i - 1 alone.
ORACLES["line_diff_ordered"] = oracle(
    """
select doc_id, len(s) - r[-1] as deleted, len(t) - r[-1] as inserted, r[-1] as unchanged,
       md5(array_to_string(s, chr(10))) as source_md5, md5(array_to_string(t, chr(10))) as target_md5
from walk where i = len(s)
""",
    {
        "sides": """
select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(string_split(a.definition, chr(10)), []) as s, coalesce(string_split(b.definition, chr(10)), []) as t
from lines_s a full outer join lines_moved b on a.doc_id = b.doc_id
""",
        "walk": """
select doc_id, cast(0 as bigint) as i, s, t, list_transform(range(len(t) + 1), lambda j: cast(0 as bigint)) as r from sides
union all
select doc_id, i + 1, s, t, list_transform(range(len(t) + 1), lambda j: list_max(list_transform(range(j + 1),
         lambda k: case when k > 0 and t[k] = s[i + 1] then r[k] + 1 else r[k + 1] end)))
from walk where i < len(s)
""",
    },
    recursive=True,
)


# Creation order ------------------------------------------------------------------------
@query("code_edges")
def _(spark, sf):
    return ordering.mentions(load(spark, sf, "code_docs"))


_EDGES = """
select a.pair_id, a.kind, a.input_ord, b.input_ord as needs
from code_docs a join code_docs b on a.pair_id = b.pair_id and a.kind = b.kind and a.input_ord <> b.input_ord
where contains(upper(a.definition), upper(b.name))
"""
ORACLES["code_edges"] = oracle(_EDGES)


@query("code_order")
def _(spark, sf):
    ordered = ordering.creation_order(load(spark, sf, "code_docs"))
    return ordered.select("pair_id", "kind_ord", "level", "input_ord", "name")


ORACLES["code_order"] = oracle(
    """
select c.pair_id, case kind when 'function' then 0 when 'view' then 1 when 'procedure' then 2 else 3 end as kind_ord,
       coalesce(max(w.level), 0) as level, c.input_ord, c.name
from code_docs c left join walk w on w.pair_id = c.pair_id and w.input_ord = c.input_ord
group by c.pair_id, kind, c.input_ord, c.name
""",
    {
        "edges": _EDGES,
        "walk": """
select distinct pair_id, input_ord, 1 as level from edges
union
select e.pair_id, e.input_ord, w.level + 1 from walk w join edges e on e.pair_id = w.pair_id and e.needs = w.input_ord
""",
    },
    recursive=True,
)


# Two of three pairs have objects that need a later one, and so cycles.
recipe(
    "code_cycles",
    """
select pair_id, kind, name, definition || case when pair_id % 3 <> 0 and input_ord % 7 = 0 then ' uses obj_' || (input_ord + 4) else '' end as definition, input_ord
from code_docs
""",
)


@query("code_order_cycles")
def _(spark, sf):
    ordered = ordering.creation_order(load(spark, sf, "code_cycles"))
    return ordered.select("pair_id", "kind_ord", "level", "input_ord", "name")


# A group's state is the list of edges that are left of it.
ORACLES["code_order_cycles"] = oracle(
    """
select c.pair_id, case c.kind when 'function' then 0 when 'view' then 1 when 'procedure' then 2 else 3 end as kind_ord,
       coalesce(max(w.level), 0) as level, c.input_ord, c.name
from code_cycles c left join (select pair_id, kind, level, unnest(e).o as o from walk) w
  on w.pair_id = c.pair_id and w.kind = c.kind and w.o = c.input_ord
group by c.pair_id, c.kind, c.input_ord, c.name
""",
    {
        "edges": _EDGES.replace("code_docs", "code_cycles"),
        "walk": """
select pair_id, kind, 1 as level, list({'o': input_ord, 'n': needs}) as e from edges group by pair_id, kind
union all
select pair_id, kind, level + 1, case when len(alive) = len(e)
         then list_filter(e, lambda x: x.o <> list_min(list_transform(e, lambda y: y.o))) else alive end
from (select *, list_filter(e, lambda x: list_contains(list_transform(e, lambda y: y.o), x.n)) as alive from walk where len(e) > 0)
""",
    },
    recursive=True,
)


# Batches -------------------------------------------------------------------------------
recipe(
    "scripts",
    """
select doc_id, replace(replace(text, 'a. ', 'a.' || chr(13) || chr(10) || '  go -- next' || chr(10)), 'e. ', 'e.' || chr(10) || '-- GO GO' || chr(10) || 'GO' || chr(10) || 'GO' || chr(10) || '-- only a comment' || chr(10) || 'GO' || chr(9) || chr(10)) as script
from {documents}
""",
)


@query("split_batches")
def _(spark, sf):
    return batches.split_batches(load(spark, sf, "scripts"), SQL_SERVER, ["doc_id"])


@query("split_batches_pg")
def _(spark, sf):
    return batches.split_batches(load(spark, sf, "scripts"), POSTGRESQL, ["doc_id"])


ORACLES["split_batches"] = oracle(
    """
select doc_id, cast(unnest(range(len(b))) as int) as batch_no, unnest(b) as batch from kept
""",
    {
        "cut": f"""
select doc_id, list_transform(string_split_regex(replace(script, chr(13) || chr(10), chr(10)),
       '(?im)^[ \\t\\v\\f\\r]*GO[ \\t\\v\\f\\r]*(?:--.*)?$'), lambda x: trim(x, {_WS_CHARS})) as b from scripts
""",
        "kept": f"""
select doc_id, list_filter(b, lambda x: len(list_filter(string_split(x, chr(10)),
       lambda y: trim(y, {_WS_CHARS}) <> '' and not starts_with(trim(y, {_WS_CHARS}), '--'))) > 0) as b from cut
""",
    },
)
ORACLES["split_batches_pg"] = oracle("select doc_id, 0 as batch_no, script as batch from scripts")
