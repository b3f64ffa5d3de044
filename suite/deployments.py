"""Queries over deployment plans, phase by phase and whole, for both dialects."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from evenkeel.functions.dialect import POSTGRESQL, SQL_SERVER
from evenkeel.options import ScriptOptions
from evenkeel.plans.deploy import PLAN_ORDER, SECTIONS, DeploymentPlan, fleet_rows
from suite.base import oracle
from suite.fleet import fleet
from suite.schemas import BASE, steps

QUERIES = {}
ORACLES = {}

_PG_BASE = steps(columns="g_columns", indexes="g_indexes")


def plan(spark, sf, postgres=False, **script) -> DeploymentPlan:
    dialect = POSTGRESQL if postgres else SQL_SERVER
    return DeploymentPlan(fleet(spark, sf, postgres), dialect, script=ScriptOptions(**script))


# The DuckDB side ------------------------------------------------------------------
def _q(x, d):
    return f"'[' || replace({x}, ']', ']]') || ']'" if d == "mssql" else f"'\"' || replace({x}, '\"', '\"\"') || '\"'"


def _qq(s, t, d):
    return f"{_q(s, d)} || '.' || {_q(t, d)}"


def _row(phase, text, rel, *, line="0", n1="0", t1="''", t2="''", n2="0", n3="0", t3="''", where="true"):
    return (
        f"select pair_id, {phase} as phase, {n1} as n1, upper({t1}) as t1, upper({t2}) as t2, {n2} as n2, {n3} as n3, upper({t3}) as t3, "
        f"{line} as line, {text} as text from {rel} where ({where}) and ({text}) is not null"
    )


def _column_def(p, d):
    c = {x: f"{p}{x}" for x in "name data_type is_nullable default_expr default_constraint identity_clause computed_expr is_persisted coll".split()}
    if d == "mssql":
        return (
            f"case when {c['computed_expr']} is not null then {_q(c['name'], d)} || ' AS ' || {c['computed_expr']} || case when {c['is_persisted']} then ' PERSISTED' else '' end "
            f"else {_q(c['name'], d)} || ' ' || {c['data_type']} || coalesce(' COLLATE ' || {c['coll']}, '') || coalesce(' ' || {c['identity_clause']}, '') "
            f"|| case when {c['is_nullable']} then ' NULL' else ' NOT NULL' end "
            f"|| case when {c['default_expr']} is not null then coalesce(' CONSTRAINT ' || {_q(c['default_constraint'], d)}, '') || ' DEFAULT ' || {c['default_expr']} else '' end end"
        )
    # All computed expressions of the fleet are wrapped in one pair of parentheses or more.
    bare = f"trim(trim({c['computed_expr']})[2:-2])"
    return (
        f"case when {c['computed_expr']} is not null then {_q(c['name'], d)} || ' ' || {c['data_type']} || ' GENERATED ALWAYS AS (' || {bare} || ') STORED' "
        f"else {_q(c['name'], d)} || ' ' || {c['data_type']} || coalesce(' COLLATE ' || {_q(c['coll'], d)}, '') || coalesce(' ' || {c['identity_clause']}, '') "
        f"|| case when {c['is_nullable']} then '' else ' NOT NULL' end || coalesce(' DEFAULT ' || {c['default_expr']}, '') end"
    )


def _key_cols(d):
    if d == "pg":
        return f"{_q('c1', d)} || coalesce(', ' || {_q('c2', d)}, '')"
    return (
        f"{_q('c1', d)} || case when d1 then ' DESC' else '' end || coalesce(', ' || {_q('c2', d)} || case when d2 then ' DESC' else '' end, '')"
    )


def _key_clause(d):
    kind = (
        "case when is_primary then 'PRIMARY KEY' else 'UNIQUE' end"
        if d == "pg"
        else "case when is_primary then case when is_clustered then 'PRIMARY KEY CLUSTERED' else 'PRIMARY KEY NONCLUSTERED' end "
        "else case when is_clustered then 'UNIQUE CLUSTERED' else 'UNIQUE' end end"
    )
    return f"'CONSTRAINT ' || {_q('name', d)} || ' ' || {kind} || ' (' || {_key_cols(d)} || ')'"


def _index(d):
    cols = (
        f"{_q('c1', d)} || case when d1 then ' DESC' else '' end || coalesce(', ' || {_q('c2', d)} || case when d2 then ' DESC' else '' end, '')"
    )
    table = _qq("sch", "tbl", d)
    built = (
        f"'CREATE ' || case when is_unique then 'UNIQUE ' else '' end || case when is_clustered and '{d}' = 'mssql' then 'CLUSTERED ' else '' end || 'INDEX ' || {_q('name', d)} "
        f"|| ' ON ' || {table} || ' (' || {cols} || ')'"
    )
    if d == "mssql":
        built += f" || coalesce(' INCLUDE (' || {_q('i1', d)} || ', ' || {_q('i2', d)} || ')', '')"
    built += " || coalesce(' WHERE ' || filter_expr, '') || ';'"
    return f"case when raw_definition is not null then raw_definition || ';' else {built} end" if d == "pg" else built


def _fk(d):
    return (
        f"'ALTER TABLE ' || {_qq('sch', 'tbl', d)} || ' ADD CONSTRAINT ' || {_q('name', d)} || ' FOREIGN KEY (' || {_q('c1', d)} || ') REFERENCES ' || "
        f"{_qq('ref_sch', 'ref_tbl', d)} || ' (' || {_q('rc1', d)} || ')' || case when on_delete <> 'NO ACTION' then ' ON DELETE ' || on_delete else '' end "
        "|| case when on_update <> 'NO ACTION' then ' ON UPDATE ' || on_update else '' end || ';'"
    )


def _levels(name, rel):
    return {
        f"{name}_edges": f"""
select a.pair_id, a.kind, a.input_ord, b.input_ord as needs from {rel} a join {rel} b
  on a.pair_id = b.pair_id and a.kind = b.kind and a.input_ord <> b.input_ord where contains(upper(a.definition), upper(b.name))
""",
        f"{name}_walk": f"""
select distinct pair_id, input_ord, 1 as level from {name}_edges
union
select e.pair_id, e.input_ord, w.level + 1 from {name}_walk w join {name}_edges e on e.pair_id = w.pair_id and e.needs = w.input_ord
""",
        f"{name}_levels": f"""
select c.*, case kind when 'function' then 0 when 'view' then 1 when 'procedure' then 2 else 3 end as kind_ord,
       coalesce((select max(level) from {name}_walk w where w.pair_id = c.pair_id and w.input_ord = c.input_ord), 0) as level
from {rel} c
""",
    }


def _create_lines(d, side="source", only_new=True):
    cols = "g_columns" if d == "pg" else "f_columns"
    new = "(pair_id, upper(sch || '.' || tbl)) in (select (pair_id, tk) from tj where presence = 'SourceOnly')" if only_new else "true"
    where = f"side = '{side}' and {new}"
    return {
        "ct_parts": f"""
select pair_id, sch, tbl, 1 as part, ordinal as ord, name, '    ' || {_column_def('', d)} as text from {cols} where {where}
union all
select pair_id, sch, tbl, case when is_primary then 2 else 3 end, 0, name, '    ' || {_key_clause(d)} from f_keys where {where}
union all
select pair_id, sch, tbl, 4, 0, name, '    CONSTRAINT ' || {_q('name', d)} || ' CHECK ' || expression from f_checks where {where}
""",
        "ct_lines": f"""
select pair_id, sch, tbl, part, ord, name,
       text || case when row_number() over (partition by pair_id, sch, tbl order by part desc, ord desc, upper(name) desc) = 1 then '' else ',' end as text from ct_parts
union all
select pair_id, sch, tbl, 0, 0, '', 'CREATE TABLE ' || {_qq('sch', 'tbl', d)} || ' (' from f_tables where {where}
union all
select pair_id, sch, tbl, 9, 0, '', ');' from f_tables where {where}
""",
    }


def phases(d) -> tuple[dict[str, str], dict[str, str]]:
    """SQL of each phase and the extra steps they need."""
    table, target = _qq("sch", "tbl", d), _qq("tsch", "ttbl", d)
    if_exists = "IF EXISTS " if d == "pg" else ""
    where = {"t1": "sch", "t2": "tbl"}
    key = "upper(sch || '.' || tbl)"
    extra = (BASE if d == "mssql" else _PG_BASE) | _create_lines(d)
    ck = "upper(upper(kind[1]) || kind[2:] || ':' || sch || '.' || name)"
    gone_status = "('TargetOnly')" if d == "mssql" else "('TargetOnly', 'Different')"
    extra |= {
        "code_gone": f"select * from f_code where side = 'target' and (pair_id, {ck}) in (select (pair_id, ck) from code where status in {gone_status})",
        "code_new": f"select * from f_code where side = 'source' and (pair_id, {ck}) in (select (pair_id, ck) from code where status in ('SourceOnly', 'Different'))",
    }
    extra |= _levels("gone", "code_gone") | _levels("new", "code_new")
    extra["dropped"] = "select * from tj where presence = 'TargetOnly'"
    extra["added"] = "select * from tj where presence = 'SourceOnly'"
    in_added = f"(pair_id, {key}) in (select (pair_id, tk) from added)"
    # Models of changed children, by table key and name.
    def changed(rel, kind, side):
        name = "s_name" if side == "source" else "t_name"
        return (
            f"(select r.* exclude (sch, tbl), kd.sch, kd.tbl, kd.tsch, kd.ttbl from {rel} r join kd on kd.kind = '{kind}' and kd.pair_id = r.pair_id "
            f"and kd.tk = upper(r.sch || '.' || r.tbl) and kd.{name} = r.name and r.side = '{side}')"
        )

    out = {}
    if d == "mssql":
        escaped = "replace(sch, '''', '''''')"
        s = f"'IF SCHEMA_ID(N''' || {escaped} || ''') IS NULL EXEC(N''CREATE SCHEMA ' || {_q('sch', d)} || ''');'"
        missing = "(select pair_id, sch from f_schemas where side = 'source' and (pair_id, upper(sch)) not in (select (pair_id, upper(sch)) from f_schemas where side = 'target'))"
        out["schemas"] = [_row(0, s, missing, t1="sch"), _row(0, "'GO'", missing, line="1", t1="sch")]
    else:
        missing = "(select pair_id, sch from f_schemas where side = 'source' and (pair_id, upper(sch)) not in (select (pair_id, upper(sch)) from f_schemas where side = 'target'))"
        out["schemas"] = [_row(0, f"'CREATE SCHEMA IF NOT EXISTS ' || {_q('sch', d)} || ';'", missing, t1="sch")]
    if d == "mssql":
        drop = f"'DROP ' || upper(kind) || ' IF EXISTS ' || {_qq('sch', 'name', d)} || ';'"
    else:
        args = "case when contains(name, '(') then name[strpos(name, '('):] else '()' end"
        drop = (
            f"case kind when 'view' then 'DROP VIEW IF EXISTS ' || {_qq('sch', 'name', d)} || ';' "
            f"when 'trigger' then 'DROP TRIGGER IF EXISTS ' || {_q('name', d)} || ' ON ' || {_q(chr(39).join(['split_part(parent, ', '.', ', 1)']), d)} || '.' || {_q(chr(39).join(['split_part(parent, ', '.', ', 2)']), d)} || ';' "
            f"else 'DROP ' || upper(kind) || ' IF EXISTS ' || {_qq('sch', chr(39).join(['split_part(name, ', '(', ', 1)']), d)} || {args} || ';' end"
        )
    out["drop_code"] = [_row(1, drop, "gone_levels", n1="-kind_ord", n2="-level", n3="-input_ord")]
    fk_rel = f"""(
select distinct pair_id, k, sch, tbl, name from (
  select pair_id, tk || '/' || nk as k, tsch as sch, ttbl as tbl, t_name as name from kd where kind = 'fk' and t_name is not null
  union all
  select pair_id, {key} || '/' || upper(name), sch, tbl, name from f_fks where side = 'target'
    and ((pair_id, {key}) in (select (pair_id, tk) from dropped) or (pair_id, upper(ref_sch || '.' || ref_tbl)) in (select (pair_id, tk) from dropped))))"""
    out["drop_fks"] = [_row(2, f"'ALTER TABLE ' || {table} || ' DROP CONSTRAINT {if_exists}' || {_q('name', d)} || ';'", fk_rel, t3="name", **where)]
    drop_index = (
        f"'DROP INDEX ' || {_q('t_name', d)} || ' ON ' || {target} || ';'" if d == "mssql" else f"'DROP INDEX IF EXISTS ' || {_qq('tsch', 't_name', d)} || ';'"
    )
    drop_con = f"'ALTER TABLE ' || {target} || ' DROP CONSTRAINT {if_exists}' || {_q('t_name', d)} || ';'"
    out["drop_constraints"] = [
        _row(3, drop_index if kind == "index" else drop_con, "kd", n2=str(i), t3="t_name", where=f"kind = '{kind}' and t_name is not null", **where)
        for i, kind in enumerate(("index", "unique", "check", "pk"))
    ]
    out["drop_tables"] = [
        _row(4, "'-- WARNING: dropping table ' || sch || '.' || tbl || ' discards its data.'", "dropped", **where),
        _row(4, f"'DROP TABLE {if_exists}' || {table} || ';'", "dropped", line="1", **where),
    ]
    out["create_tables"] = [
        _row(5, "text", "ct_lines", n2="part", n3="ord", t3="name", **where),
        _row(5, "''", "ct_lines", line="1", n2="part", n3="ord", t3="name", where="part = 9", **where),
    ]
    # Alter columns
    show = (lambda x: f"'[' || {x} || ']'") if d == "mssql" else (lambda x: f"'\"' || {x} || '\"'")
    full = "sch || '.' || tbl"
    add = "ADD" if d == "mssql" else "ADD COLUMN"
    add_s = f"'ALTER TABLE ' || {table} || ' {add} ' || {_column_def('s_', d)} || ';'"
    alter_rows = [
        _row(
            6, f"'-- WARNING: adding NOT NULL column ' || {show('s_name')} || ' without a default fails if ' || {full} || ' has rows.'", "cp",
            n3="s_ordinal", t3="s_name",
            where="t_name is null and not s_is_nullable and s_default_expr is null and s_computed_expr is null and s_identity_clause is null", **where,
        ),
        _row(6, add_s, "cp", line="1", n3="s_ordinal", t3="s_name", where="t_name is null", **where),
    ]
    drop_col = f"'ALTER TABLE ' || {table} || ' DROP COLUMN ' || {_q('{}', d)} || ';'"
    both = "s_name is not null and t_name is not null"
    change = {"n2": "1", "n3": "s_ordinal", "t3": "s_name", **where}
    rebuilt = "d_comp" if d == "mssql" else "d_expr"
    word = "computed" if d == "mssql" else "generated"
    alter_rows += [
        _row(6, f"'-- Recreating {word} column ' || {show('s_name')} || ' on ' || {full} || '.'", "cp", line="0", where=f"{both} and {rebuilt}", **change),
        _row(6, drop_col.format("s_name"), "cp", line="1", where=f"{both} and {rebuilt}", **change),
        _row(6, add_s, "cp", line="2", where=f"{both} and {rebuilt}", **change),
    ]
    if d == "mssql":
        keep = f"{both} and not d_comp"
        shape = "(d_type or d_null)"
        drop_default = f"'ALTER TABLE ' || {table} || ' DROP CONSTRAINT ' || {_q('t_default_constraint', d)} || ';'"
        alter_rows += [
            _row(6, f"'-- WARNING: identity change on [' || s_name || '] (' || coalesce(t_identity_clause, 'none') || ' → ' || coalesce(s_identity_clause, 'none') || ') cannot be scripted in place; requires table rebuild.'", "cp", line="3", where=f"{keep} and d_id", **change),
            _row(6, "'-- WARNING: verify ' || t_data_type || ' → ' || s_data_type || ' does not truncate data in [' || s_name || '].'", "cp", line="4", where=f"{keep} and d_type", **change),
            _row(6, drop_default, "cp", line="5", where=f"{keep} and ({shape} or d_def) and t_default_constraint is not null", **change),
            _row(6, f"'ALTER TABLE ' || {table} || ' ALTER COLUMN ' || {_q('s_name', d)} || ' ' || s_data_type || coalesce(' COLLATE ' || s_coll, '') || case when s_is_nullable then ' NULL;' else ' NOT NULL;' end", "cp", line="6", where=f"{keep} and {shape}", **change),
            _row(6, f"'ALTER TABLE ' || {table} || ' ADD CONSTRAINT ' || {_q(chr(39).join(['coalesce(s_default_constraint, ', 'DF_', ' || s_name)']), d)} || ' DEFAULT ' || s_default_expr || ' FOR ' || {_q('s_name', d)} || ';'", "cp", line="7", where=f"{keep} and ({shape} or d_def) and s_default_expr is not null", **change),
        ]
    else:
        keep = f"{both} and not d_expr"
        alter = f"'ALTER TABLE ' || {table} || ' ALTER COLUMN ' || {_q('s_name', d)} || ' "
        alter_rows += [
            _row(6, "'-- WARNING: verify the cast ' || t_data_type || ' → ' || s_data_type || ' preserves the data in \"' || s_name || '\".'", "cp", line="3", where=f"{keep} and d_type", **change),
            _row(6, f"{alter}TYPE ' || s_data_type || ' USING ' || {_q('s_name', d)} || '::' || s_data_type || ';'", "cp", line="4", where=f"{keep} and d_type", **change),
            _row(6, f"{alter}' || case when s_is_nullable then 'DROP NOT NULL;' else 'SET NOT NULL;' end", "cp", line="5", where=f"{keep} and d_null", **change),
            _row(6, f"{alter}' || coalesce('SET DEFAULT ' || s_default_expr || ';', 'DROP DEFAULT;')", "cp", line="6", where=f"{keep} and d_def", **change),
            _row(6, f"{alter}' || case when s_identity_clause is null then 'DROP IDENTITY IF EXISTS;' when t_identity_clause is null then 'ADD ' || s_identity_clause || ';' when contains(s_identity_clause, 'ALWAYS') then 'SET GENERATED ALWAYS;' else 'SET GENERATED BY DEFAULT;' end", "cp", line="7", where=f"{keep} and d_id", **change),
        ]
    gone = {"n2": "2", "n3": "t_ordinal", "t3": "t_name", **where}
    alter_rows.append(_row(6, f"'-- WARNING: dropping column ' || {show('t_name')} || ' from ' || {full} || ' discards its data.'", "cp", where="s_name is null", **gone))
    if d == "mssql":
        alter_rows.append(_row(6, drop_default, "cp", line="1", where="s_name is null and t_default_constraint is not null", **gone))
    alter_rows.append(_row(6, drop_col.format("t_name"), "cp", line="2" if d == "mssql" else "1", where="s_name is null", **gone))
    out["alter_columns"] = alter_rows
    add_key = f"'ALTER TABLE ' || {table} || ' ADD ' || {_key_clause(d)} || ';'"
    add_check = f"'ALTER TABLE ' || {table} || ' ADD CONSTRAINT ' || {_q('name', d)} || ' CHECK ' || expression || ';'"
    out["add_constraints"] = [
        _row(7, add_key, changed("(select * from f_keys where is_primary)", "pk", "source"), n2="0", t3="name", **where),
        _row(7, add_key, changed("(select * from f_keys where not is_primary)", "unique", "source"), n2="1", t3="name", **where),
        _row(7, add_check, changed("f_checks", "check", "source"), n2="2", t3="name", **where),
    ]
    ix = "g_indexes" if d == "pg" else "f_indexes"
    new_rows = "(select * from {} where side = 'source' and " + in_added + ")"
    out["create_indexes"] = [
        _row(8, _index(d), changed(ix, "index", "source"), t3="name", **where),
        _row(8, _index(d), new_rows.format(ix), n1="1", t3="name", **where),
    ]
    out["create_fks"] = [
        _row(9, _fk(d), changed("f_fks", "fk", "source"), t3="name", **where),
        _row(9, _fk(d), new_rows.format("f_fks"), n1="1", t3="name", **where),
    ]
    order = {"n1": "kind_ord", "n2": "level", "n3": "input_ord"}
    if d == "mssql":
        body = "rtrim(regexp_replace(definition, '(?i)\\bCREATE\\s+(?:OR\\s+ALTER\\s+)?(VIEW|PROC(?:EDURE)?|FUNCTION|TRIGGER)\\b', 'CREATE OR ALTER \\1'))"
        out["create_code"] = [
            _row(10, "'GO'", "new_levels", **order), _row(10, body, "new_levels", line="1", **order), _row(10, "'GO'", "new_levels", line="2", **order),
        ]
    else:
        out["create_code"] = [_row(10, "rtrim(definition) || case when ends_with(rtrim(definition), ';') then '' else ';' end", "new_levels", **order)]
    return {k: "\nunion all\n".join(v) for k, v in out.items()}, extra


_PHASES = {"mssql": phases("mssql"), "pg": phases("pg")}


def _phase_query(name, attribute, d):
    QUERIES[name] = lambda spark, sf: getattr(plan(spark, sf, d == "pg"), attribute)
    bodies, extra = _PHASES[d]
    ORACLES[name] = oracle(bodies[attribute], extra, recursive=True)


for _name, _attribute, _d in [
    ("plan_schemas", "schemas", "mssql"),
    ("plan_drop_code", "drop_code", "pg"),
    ("plan_drop_fks", "drop_fks", "mssql"),
    ("plan_drop_constraints", "drop_constraints", "mssql"),
    ("plan_drop_tables", "drop_tables", "pg"),
    ("plan_create_tables", "create_tables", "mssql"),
    ("plan_alter_mssql", "alter_columns", "mssql"),
    ("plan_alter_pg", "alter_columns", "pg"),
    ("plan_add_constraints", "add_constraints", "mssql"),
    ("plan_create_indexes", "create_indexes", "mssql"),
    ("plan_create_indexes_pg", "create_indexes", "pg"),
    ("plan_create_fks", "create_fks", "mssql"),
    ("plan_code", "create_code", "mssql"),
]:
    _phase_query(_name, _attribute, _d)


def _whole(d):
    bodies, extra = _PHASES[d]
    dbs = "(select s.pair_id, s.database as s, t.database as t from {0} s join {0} t on s.pair_id = t.pair_id and s.side = 'source' and t.side = 'target')".format(
        "g_databases" if d == "pg" else "f_databases"
    )
    name = "SQL Server" if d == "mssql" else "PostgreSQL"
    start = ["", "SET XACT_ABORT ON;", "SET NOCOUNT ON;", "BEGIN TRANSACTION;", "GO"] if d == "mssql" else ["", "BEGIN;"]
    end = ["", "COMMIT TRANSACTION;", "GO"] if d == "mssql" else ["", "COMMIT;"]
    header = [f"'-- Deployment script ({name})'", "'-- Source: ' || s || '   Target: ' || t", "'-- Review carefully before executing against the target database.'"]
    rows = [_row(-1, text, dbs, line=str(i)) for i, text in enumerate(header + [f"'{x}'" for x in start])]
    rows += [_row(99, f"'{x}'", dbs, line=str(i)) for i, x in enumerate(end)]
    titles = "case phase " + " ".join(f"when {k} then '-- ==== {v} ===='" for k, v in SECTIONS.items()) + " end"
    extra = extra | {"body": "\nunion all\n".join(bodies.values())}
    seen = "(select distinct pair_id, phase from body)"
    rows += [
        f"select pair_id, phase, -1000, '', '', 0, 0, '', 0, '' from {seen}",
        f"select pair_id, phase, -1000, '', '', 0, 0, '', 1, {titles} from {seen}",
    ]
    text = "select * from body union all " + "\nunion all\n".join(rows)
    bad = "select pair_id from bad_pairs" if d == "mssql" else "select 1 where false"
    return oracle(f"select * from ({text}) where pair_id not in ({bad})", extra, recursive=True)


QUERIES["deployment_plan"] = lambda spark, sf: plan(spark, sf).rows.orderBy("pair_id", *PLAN_ORDER)
ORACLES["deployment_plan"] = _whole("mssql")
QUERIES["deployment_plan_pg"] = lambda spark, sf: plan(spark, sf, True).rows
ORACLES["deployment_plan_pg"] = _whole("pg")


_APART = 100_000


def _mixed(spark, sf):
    """One fleet of pairs of both engines, and of pairs whose sides run different ones."""
    ms, pg = fleet(spark, sf), fleet(spark, sf, True)
    frames = {}
    for f in dataclasses.fields(ms):
        moved = getattr(pg, f.name).withColumn("pair_id", F.col("pair_id") + _APART)
        frames[f.name] = getattr(ms, f.name).unionByName(moved)
    return fleet_rows(type(ms)(**frames), [SQL_SERVER, POSTGRESQL])


def _mixed_sql() -> str:
    """Both whole plans; the steps that they share have other names in the second."""
    error = _row(-1, "'-- ERROR: no script: the source runs SQL Server, the target runs PostgreSQL.'", "bad_pairs")
    moved = f"select * replace (pair_id + {_APART} as pair_id) from ({_whole('pg')})"
    failed = oracle(error, {"bad_pairs": BASE["bad_pairs"]})
    return "\nunion all\n".join(f"select * from ({part})" for part in (_whole("mssql"), moved, failed))


QUERIES["deployment_plan_mixed"] = _mixed
ORACLES["deployment_plan_mixed"] = _mixed_sql()


def _no_drops(spark, sf):
    rows = plan(spark, sf, include_drops=False, use_transaction=False)
    return rows.drop_fks.unionByName(rows.drop_tables).unionByName(rows.alter_columns).unionByName(rows.drop_code)


QUERIES["plan_without_drops"] = _no_drops
_FK_CHANGED = _row(
    2, f"'ALTER TABLE ' || {_qq('tsch', 'ttbl', 'mssql')} || ' DROP CONSTRAINT ' || {_q('t_name', 'mssql')} || ';'", "kd",
    t1="tsch", t2="ttbl", t3="t_name", where="kind = 'fk' and t_name is not null",
)
ORACLES["plan_without_drops"] = oracle(
    _FK_CHANGED + " union all select * from (" + _PHASES["mssql"][0]["alter_columns"] + ") where n2 < 2", _PHASES["mssql"][1], recursive=True
)


def _tables(d):
    def run(spark, sf):
        rows = plan(spark, sf, d == "pg").create_table_lines("source")
        return rows.select("pair_id", "schema", F.col("table").alias("tbl"), "part", "ord", "name", "text")

    QUERIES[f"create_table_{d}"] = run
    ORACLES[f"create_table_{d}"] = oracle(
        "select pair_id, sch as schema, tbl, part, ord, name, text from ct_lines", _create_lines(d, only_new=False)
    )


_tables("mssql")
_tables("pg")


def _render(spark, sf):
    rows = plan(spark, sf).render_lines("target")
    return rows.select("pair_id", "schema", F.col("table").alias("tbl"), "part", "ord", "name", "text")


QUERIES["render_ddl"] = _render
ORACLES["render_ddl"] = oracle(
    """
select pair_id, sch as schema, tbl, part, ord, name, text from ct_lines
union all
select pair_id, sch, tbl, 10, 0, name, '-- FK ' || name || ': (' || c1 || ') → ' || ref_sch || '.' || ref_tbl || ' (' || rc1 || ')' from f_fks where side = 'target'
union all
select pair_id, sch, tbl, 11, 0, name, '-- INDEX ' || name || case when is_unique then ' UNIQUE' else '' end || ': (' || c1 || case when d1 then ' DESC' else '' end
       || coalesce(', ' || c2 || case when d2 then ' DESC' else '' end, '') || ')' from f_indexes where side = 'target'
""",
    _create_lines("mssql", side="target", only_new=False),
)
