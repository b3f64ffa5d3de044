"""Queries over schema snapshots: compare, findings, roll-up, delta, signatures."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.functions import signatures, text
from evenkeel.operators.schemadiff import SchemaDiff
from evenkeel.options import CompareOptions
from suite.base import load, once, oracle, recipe
from suite.fleet import fleet, wide_catalog
from suite.texts import collapsed

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


# Steps of the DuckDB side ---------------------------------------------------------
def normal_form(sources: str) -> dict[str, str]:
    """nx(e, n): each expression with its comparable form, by stripping one pair at a time."""
    return {
        "ex": f"select distinct e from ({sources}) where e is not null",
        "strip": f"""
select e, lower({collapsed('e')}) as x from ex
union all
select e, trim(x[2:-2]) from strip
where len(x) >= 2 and x[1] = '(' and x[-1] = ')'
  and coalesce(list_min(list_transform(range(1, len(x)), lambda i: len(replace(x[1:i], ')', '')) - len(replace(x[1:i], '(', '')))), 1) >= 1
""",
        "nx": "select e, arg_min(x, len(x)) as n from strip group by e",
    }


def norm(col: str) -> str:
    return f"coalesce((select n from nx where nx.e = {col}), '')"


_COLS = "name ordinal data_type is_nullable default_expr default_constraint identity_clause computed_expr is_persisted coll".split()


def steps(columns="f_columns", indexes="f_indexes", fold="upper", collation=False) -> dict[str, str]:
    """The relational pieces most checks share, over flat recipe rows."""

    def key(expr):
        return f"{fold}({expr})" if fold else expr

    raw = "raw_definition" if indexes == "g_indexes" else "null"
    s_cols = ", ".join(f"s.{c} as s_{c}, t.{c} as t_{c}" for c in _COLS)
    exprs = " union all ".join(
        [f"select {c} as e from {columns}" for c in ("default_expr", "identity_clause", "computed_expr")]
        + ["select expression from f_checks"]
        + ([f"select raw_definition from {indexes}"] if raw != "null" else [])
    )
    out = normal_form(exprs)
    out["ft"] = f"select *, {key('sch || chr(46) || tbl')} as tk from f_tables"
    out["tj"] = """
select coalesce(s.pair_id, t.pair_id) as pair_id, coalesce(s.tk, t.tk) as tk, coalesce(s.sch, t.sch) as sch, coalesce(s.tbl, t.tbl) as tbl,
       t.sch as tsch, t.tbl as ttbl,
       case when t.tk is null then 'SourceOnly' when s.tk is null then 'TargetOnly' else 'Both' end as presence
from (select * from ft where side = 'source') s full outer join (select * from ft where side = 'target') t
  on s.pair_id = t.pair_id and s.tk = t.tk
"""
    out["tm"] = "select * from tj where presence = 'Both'"
    out["fc"] = (
        f"select *, {key('sch || chr(46) || tbl')} as tk, {key('name')} as ck, {norm('default_expr')} as nd, "
        f"{norm('identity_clause')} as ni, {norm('computed_expr')} as nc from {columns}"
    )
    out["cj"] = f"""
select tm.pair_id, tm.tk, tm.sch, tm.tbl, j.* exclude (jp, jt) from (
  select coalesce(s.pair_id, t.pair_id) as jp, coalesce(s.tk, t.tk) as jt, coalesce(s.ck, t.ck) as ck, {s_cols},
         upper(s.data_type) <> upper(t.data_type) as d_type, s.is_nullable <> t.is_nullable as d_null, s.nd <> t.nd as d_def, s.ni <> t.ni as d_id,
         s.nc <> t.nc as d_expr, s.nc <> t.nc or (s.computed_expr is not null and s.is_persisted <> t.is_persisted) as d_comp,
         s.name is not null and t.name is not null and upper(coalesce(s.coll, '')) <> upper(coalesce(t.coll, '')) as d_coll
  from (select * from fc where side = 'source') s full outer join (select * from fc where side = 'target') t
    on s.pair_id = t.pair_id and s.tk = t.tk and s.ck = t.ck) j
join tm on tm.pair_id = j.jp and tm.tk = j.jt
"""
    out["cp"] = f"select *, d_type or d_null or d_def or d_id or d_comp{' or d_coll' if collation else ''} as d_any from cj"

    def desc(c, d):
        return f"{c} || case when {d} then ' DESC' else '' end"

    key_cols = f"{desc('c1', 'd1')} || coalesce(',' || {desc('c2', 'd2')}, '')"
    ix_sig = (
        f"lower(case when is_unique then 'U' else '' end || case when is_clustered then 'C' else '' end || ':' || {key_cols} || '|inc:' || "
        "coalesce(least(i1, i2) || ',' || greatest(i1, i2), '') || '|f:' || coalesce(filter_expr, ''))"
    )
    if raw != "null":
        ix_sig = f"case when raw_definition is not null then {norm('raw_definition')} else {ix_sig} end"
    fk_sig = "lower(c1 || '->' || ref_sch || '.' || ref_tbl || '(' || rc1 || ') D:' || on_delete || ' U:' || on_update)"
    key_sig = (
        f"case when is_primary then 'PK' else 'UQ' end || case when is_clustered then ':C:' else ':N:' end || lower({key_cols})"
    )
    kids = [
        ("f_keys where is_primary", "'pk'", key_sig, f"replace({key_cols}, ',', ', ')"),
        ("f_keys where not is_primary", "'unique'", key_sig, "''"),
        ("f_fks", "'fk'", fk_sig, "''"),
        ("f_checks", "'check'", norm("expression"), "''"),
        (indexes, "'index'", ix_sig, "''"),
    ]
    out["kids"] = "\nunion all\n".join(
        f"select pair_id, side, {key('sch || chr(46) || tbl')} as tk, {kind} as kind, case when {kind} = 'pk' then '' else {key('name')} end as nk, name, {sig} as sig, "
        f"{shown} as shown from {rel}"
        for rel, kind, sig, shown in kids
    )
    out["kj"] = """
select tm.pair_id, tm.tk, tm.sch, tm.tbl, tm.tsch, tm.ttbl, j.* exclude (jp, jt) from (
  select coalesce(s.pair_id, t.pair_id) as jp, coalesce(s.tk, t.tk) as jt, coalesce(s.kind, t.kind) as kind, coalesce(s.nk, t.nk) as nk,
         s.name as s_name, t.name as t_name, s.sig as s_sig, t.sig as t_sig, s.shown as s_shown, t.shown as t_shown
  from (select * from kids where side = 'source') s full outer join (select * from kids where side = 'target') t
    on s.pair_id = t.pair_id and s.tk = t.tk and s.kind = t.kind and s.nk = t.nk) j
join tm on tm.pair_id = j.jp and tm.tk = j.jt
"""
    out["kd"] = "select * from kj where s_sig is distinct from t_sig"

    def show(c):
        return f"case when coalesce({c}, '') = '' then '(none)' else {c} end"

    def nul(c):
        return f"case when {c} then 'NULL' else 'NOT NULL' end"

    aspects = [
        (0, "type", "d_type", "'type ' || t_data_type || ' → ' || s_data_type"),
        (1, "nullability", "d_null", f"{nul('t_is_nullable')} || ' → ' || {nul('s_is_nullable')}"),
        (2, "default", "d_def", f"'default ' || {show('t_default_expr')} || ' → ' || {show('s_default_expr')}"),
        (3, "identity", "d_id", f"'identity ' || {show('t_identity_clause')} || ' → ' || {show('s_identity_clause')}"),
        (4, "computed", "d_comp", f"'computed ' || {show('t_computed_expr')} || ' → ' || {show('s_computed_expr')}"),
    ]
    if collation:
        aspects.append((5, "collation", "d_coll", f"'collation ' || {show('t_coll')} || ' → ' || {show('s_coll')}"))
    aspects += [
        (0, "missing", "t_name is null", "'missing in target (' || s_data_type || ')'"),
        (0, "extra", "s_name is null", "'only in target (' || t_data_type || ')'"),
    ]
    col_rows = [
        f"select pair_id, tk, sch, tbl, 'column' as kind, 0 as kind_ord, case when s_name is null then 1 else 0 end as only_target, "
        f"coalesce(s_ordinal, t_ordinal) as ord, ck as item_key, coalesce(s_name, t_name) as item, {n} as aspect_ord, '{a}' as aspect, "
        f"'Column [' || coalesce(s_name, t_name) || ']: ' || {d} as detail from cp where {cond}"
        for n, a, cond, d in aspects
    ]
    kid_row = """
select pair_id, tk, sch, tbl, kind, case kind when 'pk' then 1 when 'unique' then 2 when 'fk' then 3 when 'check' then 4 else 5 end,
       case when kind <> 'pk' and s_name is null then 1 else 0 end, 0, nk, coalesce(s_name, t_name), 0,
       case when t_name is null then 'missing' when s_name is null then 'extra' else 'definition' end,
       case when kind = 'pk' and s_name is not null and t_name is not null then 'Primary key: (' || t_shown || ') → (' || s_shown || ')'
            else case kind when 'pk' then 'Primary key' when 'unique' then 'Unique constraint' when 'fk' then 'Foreign key' when 'check' then 'Check constraint' else 'Index' end
                 || ' [' || coalesce(s_name, t_name) || ']: '
                 || case when t_name is null then 'missing in target' when s_name is null then 'only in target' else 'definition differs' end end
from kd
"""
    out["findings"] = "\nunion all\n".join(col_rows + [kid_row])
    out["code"] = f"""
select coalesce(s.pair_id, t.pair_id) as pair_id, coalesce(s.kind, t.kind) as kind, coalesce(s.sch, t.sch) as sch, coalesce(s.name, t.name) as name,
       coalesce(s.ck, t.ck) as ck,
       case when t.ck is null then 'SourceOnly' when s.ck is null then 'TargetOnly' when s.d <> t.d then 'Different' else 'Equal' end as status
from (select *, {key("upper(kind[1]) || kind[2:] || ':' || sch || '.' || name")} as ck, {collapsed('definition')} as d from f_code where side = 'source') s
full outer join (select *, {key("upper(kind[1]) || kind[2:] || ':' || sch || '.' || name")} as ck, {collapsed('definition')} as d from f_code where side = 'target') t
  on s.pair_id = t.pair_id and s.ck = t.ck
"""
    out["fx"] = """
select pair_id, tk, count(*) as n, list(detail order by kind_ord, only_target, ord, item_key, aspect_ord) as l from findings group by pair_id, tk
"""
    out["objects"] = """
select j.pair_id, 'Table' as type, j.sch as schema, j.tbl as name, case when presence <> 'Both' then presence when coalesce(n, 0) > 0 then 'Different' else 'Equal' end as status,
       coalesce(n, 0) as n_details,
       coalesce(array_to_string(l[1:4], '; ') || case when n > 4 then ' … (+' || (n - 4) || ')' else '' end, '') as preview, 0 as type_ord
from tj j left join fx on fx.pair_id = j.pair_id and fx.tk = j.tk
union all
select pair_id, upper(kind[1]) || kind[2:], sch, name, status, case when status = 'Different' then 1 else 0 end,
       case when status = 'Different' then 'Definition differs' else '' end,
       case kind when 'view' then 1 when 'procedure' then 2 when 'function' then 3 else 4 end
from code
"""
    out["bad_pairs"] = """
select s.pair_id from f_databases s join f_databases t on s.pair_id = t.pair_id and s.side = 'source' and t.side = 'target' and s.provider <> t.provider
"""
    return out


BASE = steps()
COLL = steps(collation=True)


def check(body: str, **kw) -> str:
    return oracle(body, steps(**kw) if kw else BASE, recursive=True)


def diff(spark, sf, postgres=False, **options) -> SchemaDiff:
    return once(
        spark, ("diff", sf, postgres, *sorted(options.items())),
        lambda: SchemaDiff(fleet(spark, sf, postgres), CompareOptions(**options)),
    )


# Columns of the wide catalog ----------------------------------------------------------
_WIDE = normal_form("select default_expr as e from d_columns") | {
    "d_tables": "select sch, tbl, count(distinct side) as sides, min(side) as side from d_columns group by sch, tbl",
    "dj": f"""
select coalesce(s.sch, t.sch) as schema, coalesce(s.tbl, t.tbl) as tbl, coalesce(s.name, t.name) as item, s.name as s_name, t.name as t_name,
       s.data_type as s_type, t.data_type as t_type, s.is_nullable as s_null, t.is_nullable as t_null, s.default_expr as s_def, t.default_expr as t_def,
       {norm('s.default_expr')} as s_nd, {norm('t.default_expr')} as t_nd
from (select * from d_columns where side = 'source') s full outer join (select * from d_columns where side = 'target') t
  on s.sch = t.sch and s.tbl = t.tbl and upper(s.name) = upper(t.name)
where (coalesce(s.sch, t.sch), coalesce(s.tbl, t.tbl)) in (select (sch, tbl) from d_tables where sides = 2)
""",
}


@query("schema_column_changes")
def _(spark, sf):
    rows = SchemaDiff(wide_catalog(spark, sf)).column_findings.filter("aspect not in ('missing', 'extra')")
    return rows.select("schema", F.col("table").alias("tbl"), "item", "aspect", "detail")


ORACLES["schema_column_changes"] = oracle(
    """
select schema, tbl, item, 'type' as aspect, 'Column [' || item || ']: type ' || t_type || ' → ' || s_type as detail from dj where upper(s_type) <> upper(t_type)
union all
select schema, tbl, item, 'nullability', 'Column [' || item || ']: ' || case when t_null then 'NULL' else 'NOT NULL' end || ' → ' || case when s_null then 'NULL' else 'NOT NULL' end
from dj where s_null <> t_null
union all
select schema, tbl, item, 'default', 'Column [' || item || ']: default ' || t_def || ' → ' || s_def from dj where s_name is not null and t_name is not null and s_nd <> t_nd
""",
    _WIDE,
    recursive=True,
)


@query("schema_column_presence")
def _(spark, sf):
    rows = SchemaDiff(wide_catalog(spark, sf)).column_findings.filter("aspect in ('missing', 'extra')")
    return rows.select("schema", F.col("table").alias("tbl"), "item", "aspect", "detail")


ORACLES["schema_column_presence"] = oracle(
    """
select schema, tbl, item, case when t_name is null then 'missing' else 'extra' end as aspect,
       'Column [' || item || ']: ' || case when t_name is null then 'missing in target (' || s_type else 'only in target (' || t_type end || ')' as detail
from dj where t_name is null or s_name is null
""",
    _WIDE,
    recursive=True,
)


@query("details_preview")
def _(spark, sf):
    rows = SchemaDiff(wide_catalog(spark, sf)).objects
    return rows.select("schema", "name", "status", "n_details", "preview")


ORACLES["details_preview"] = oracle(
    """
select s.sch as schema, s.tbl as name, case when sides = 1 then case side when 'source' then 'SourceOnly' else 'TargetOnly' end when coalesce(n, 0) > 0 then 'Different' else 'Equal' end as status,
       coalesce(n, 0) as n_details,
       coalesce(array_to_string(l[1:4], '; ') || case when n > 4 then ' … (+' || (n - 4) || ')' else '' end, '') as preview
from d_tables s left join (
  select schema, tbl, count(*) as n, list(detail order by only_target, ord, ck, a) as l from rows group by schema, tbl) f
on f.schema = s.sch and f.tbl = s.tbl
""",
    _WIDE
    | {
        "rows": """
select dj.schema, dj.tbl, case when s_name is null then 1 else 0 end as only_target, o.ordinal as ord, upper(item) as ck, a, detail from (
  select *, 0 as a, 'Column [' || item || ']: type ' || t_type || ' → ' || s_type as detail from dj where s_type <> t_type
  union all
  select *, 1, 'Column [' || item || ']: ' || case when t_null then 'NULL' else 'NOT NULL' end || ' → ' || case when s_null then 'NULL' else 'NOT NULL' end from dj where s_null <> t_null
  union all
  select *, 2, 'Column [' || item || ']: default ' || t_def || ' → ' || s_def from dj where s_name is not null and t_name is not null and s_nd <> t_nd
  union all
  select *, 0, 'Column [' || item || ']: missing in target (' || s_type || ')' from dj where t_name is null
  union all
  select *, 0, 'Column [' || item || ']: only in target (' || t_type || ')' from dj where s_name is null
) dj join d_columns o on o.side = case when s_name is null then 'target' else 'source' end and o.sch = dj.schema and o.tbl = dj.tbl and o.name = dj.item
"""
    },
    recursive=True,
)

recipe(
    "expressions",
    """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case l_linenumber % 5 when 0 then '((' || l_partkey || '))' when 1 then ' ( (A) + (b' || l_suppkey || ') ) '
            when 2 then '(a)+(B' || l_suppkey || ')' when 3 then '(((GETDATE( )))' else '  price  >   ' || l_suppkey || chr(9) end as e
from {lineitem}
""",
)


@query("norm_expr")
def _(spark, sf):
    rows = load(spark, sf, "expressions")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.normalize_expression(F.col("e")).alias("n"))


ORACLES["norm_expr"] = oracle(
    "select l_orderkey, l_linenumber, l_partkey, l_suppkey, nx.n from expressions x join nx on nx.e = x.e",
    normal_form("select e from expressions"),
    recursive=True,
)


# The fleet ---------------------------------------------------------------------------------
@query("schema_tables")
def _(spark, sf):
    return diff(spark, sf).tables.select("pair_id", "schema", F.col("table").alias("tbl"), "presence")


ORACLES["schema_tables"] = check("select pair_id, sch as schema, tbl, presence from tj")


def _plain(rows):
    return rows.select("pair_id", "schema", F.col("table").alias("tbl"), "kind", "item", "aspect", "detail")


_FINDING = "select pair_id, sch as schema, tbl, kind, item, aspect, detail from findings"


@query("schema_pk")
def _(spark, sf):
    return _plain(diff(spark, sf).pk_findings)


ORACLES["schema_pk"] = check(_FINDING + " where kind = 'pk'")


@query("schema_children")
def _(spark, sf):
    return _plain(diff(spark, sf).child_findings)


ORACLES["schema_children"] = check(_FINDING + " where kind not in ('pk', 'column')")


@query("schema_findings")
def _(spark, sf):
    """All findings, with collations compared as well."""
    rows = diff(spark, sf, ignore_collation=False).findings
    return rows.select(
        "pair_id", "schema", F.col("table").alias("tbl"), "kind_ord", "only_target", "ord", "item_key", "aspect_ord", "detail"
    )


ORACLES["schema_findings"] = oracle(
    "select pair_id, sch as schema, tbl, kind_ord, only_target, ord, item_key, aspect_ord, detail from findings", COLL, recursive=True
)


@query("schema_diff")
def _(spark, sf):
    rows = diff(spark, sf).objects
    return rows.orderBy("pair_id", "type_ord", F.upper("schema"), F.upper("name"))


ORACLES["schema_diff"] = check("select * from objects")


@query("schema_diff_selected")
def _(spark, sf):
    d = diff(spark, sf)
    selection = load(spark, sf, "selection").withColumnRenamed("sch", "schema")
    return d.selected(selection).select("pair_id", "type", "schema", "name", "status")


recipe(
    "selection",
    """
select pair_id, 'Table' as type, sch, lower(tbl) as name from f_tables where side = 'source' and length(tbl) < 4
union all
select pair_id, 'View', sch, name from f_code where kind = 'view' and side = 'source' and length(name) > 5
""",
)
ORACLES["schema_diff_selected"] = check(
    "select pair_id, type, schema, name, status from objects o where status <> 'Equal' and exists (select 1 from selection s "
    "where s.pair_id = o.pair_id and s.type = o.type and upper(s.sch || '.' || s.name) = upper(o.schema || '.' || o.name))"
)


@query("schema_summary")
def _(spark, sf):
    return diff(spark, sf).summary


ORACLES["schema_summary"] = check(
    """
select pair_id, type, status, count(*) as objects from objects where pair_id not in (select pair_id from bad_pairs) group by all
union all
select pair_id, '', 'Source and target must use the same database engine.', 0 from bad_pairs
"""
)


@query("schema_case_sensitive")
def _(spark, sf):
    rows = diff(spark, sf, ignore_case=False).objects
    return rows.select("pair_id", "type", "schema", "name", "status", "n_details")


ORACLES["schema_case_sensitive"] = check(
    "select pair_id, type, schema, name, status, n_details from objects", fold=""
)


@query("schema_dup_names")
def _(spark, sf):
    """The wide catalog with some columns listed again in capitals."""
    base = wide_catalog(spark, sf)
    again = base.columns.filter("side = 'source' and ordinal % 50 = 0").withColumn("name", F.upper("name"))
    from dataclasses import replace

    found = SchemaDiff(replace(base, columns=base.columns.unionByName(again))).duplicate_names
    return found.select("side", "kind", "key", "n")


ORACLES["schema_dup_names"] = oracle(
    """
select side, 'column' as kind, upper(sch || '.' || tbl || '.' || name) as key, count(*) as n from (
  select side, sch, tbl, name from d_columns union all
  select side, sch, tbl, upper(name) from d_columns where side = 'source' and ordinal % 50 = 0)
group by all having count(*) > 1
"""
)


@query("table_delta")
def _(spark, sf):
    return diff(spark, sf).delta.withColumnRenamed("table", "tbl")


ORACLES["table_delta"] = check(
    """
select pair_id, sch as schema, tbl, case when t_name is null then 'add' when s_name is null then 'drop' else 'change' end as action,
       'column' as item_kind, coalesce(s_name, t_name) as name
from cp where t_name is null or s_name is null or d_any
union all
select pair_id, sch, tbl, 'drop', kind, t_name from kd where t_name is not null
union all
select pair_id, sch, tbl, 'add', kind, s_name from kd where s_name is not null
"""
)


@query("diff_eligibility")
def _(spark, sf):
    return diff(spark, sf).eligibility.select("pair_id", "schema", F.col("table").alias("tbl"), "error")


_KEYS = {
    "kc": """
select pair_id, upper(sch || '.' || tbl) as tk, upper(c1) as ck, 1 as ord from f_keys where is_primary and side = 'source'
union all
select pair_id, upper(sch || '.' || tbl), upper(c2), 2 from f_keys where is_primary and side = 'source' and c2 is not null
""",
    "el": """
select tm.pair_id, tm.tk, tm.sch, tm.tbl,
       case when not exists (select 1 from kc where kc.pair_id = tm.pair_id and kc.tk = tm.tk) then 'No primary key — rows cannot be matched.'
            when exists (select 1 from kc where kc.pair_id = tm.pair_id and kc.tk = tm.tk and not exists (
                   select 1 from fc where fc.side = 'target' and fc.pair_id = kc.pair_id and fc.tk = kc.tk and fc.ck = kc.ck))
            then 'Primary key columns are missing in the target — sync the schema first.' end as error
from tm
""",
}
ORACLES["diff_eligibility"] = oracle("select pair_id, sch as schema, tbl, error from el", BASE | _KEYS, recursive=True)


@query("diff_columns")
def _(spark, sf):
    return diff(spark, sf).comparable_columns.withColumnRenamed("table", "tbl")


ORACLES["diff_columns"] = oracle(
    """
select cp.pair_id, cp.sch as schema, cp.tbl, case when kc.ord is not null then 'key' else 'value' end as role, coalesce(kc.ord, s_ordinal) as ord,
       s_name as source_name, t_name as target_name
from cp join el on el.pair_id = cp.pair_id and el.tk = cp.tk and el.error is null
left join kc on kc.pair_id = cp.pair_id and kc.tk = cp.tk and kc.ck = cp.ck
where s_name is not null and t_name is not null and (kc.ord is not null or s_computed_expr is null)
""",
    BASE | _KEYS,
    recursive=True,
)


@query("scope_schema")
def _(spark, sf):
    """Objects found when only one schema is looked at."""
    rows = SchemaDiff(fleet(spark, sf).scope("s1")).objects
    return rows.select("pair_id", "type", "schema", "name", "status", "n_details")


ORACLES["scope_schema"] = check("select pair_id, type, schema, name, status, n_details from objects where schema = 's1'")


# Signatures ---------------------------------------------------------------------------------
_ID = ["pair_id", "side", "schema", "table as tbl", "name"]


def _signed(rows, signature):
    return rows.withColumn("sig", signature).selectExpr(*_ID, "sig")


@query("sig_key")
def _(spark, sf):
    rows = fleet(spark, sf).keys
    return _signed(rows, signatures.key_signature(F.col("is_primary"), F.col("is_clustered"), F.col("columns")))


@query("sig_fk")
def _(spark, sf):
    rows = fleet(spark, sf).fks
    parts = map(F.col, ("columns", "ref_schema", "ref_table", "on_delete", "on_update"))
    return _signed(rows, signatures.fk_signature(*parts))


@query("sig_index")
def _(spark, sf):
    """Indexes with a full statement and without one."""
    out = []
    for postgres in (False, True):
        parts = map(F.col, ("is_unique", "is_clustered", "columns", "included", "filter_expr", "raw_definition"))
        rows = fleet(spark, sf, postgres).indexes
        out.append(_signed(rows, signatures.index_signature(*parts)).withColumn("pg", F.lit(postgres)))
    return out[0].unionByName(out[1])


@query("sig_check")
def _(spark, sf):
    return _signed(fleet(spark, sf).checks, signatures.check_signature(F.col("expression")))


def _kid_names(kinds):
    return f"""
select k.pair_id, k.side, t.sch as schema, t.tbl, k.name, k.sig from kids k
join (select distinct pair_id, side, sch, tbl, upper(sch || '.' || tbl) as tk from f_tables) t on t.pair_id = k.pair_id and t.side = k.side and t.tk = k.tk
where k.kind in ({kinds})
"""


ORACLES["sig_key"] = check(_kid_names("'pk', 'unique'"))
ORACLES["sig_fk"] = check(_kid_names("'fk'"))
ORACLES["sig_check"] = check(_kid_names("'check'"))
_PG = steps(columns="g_columns", indexes="g_indexes")
ORACLES["sig_index"] = oracle(
    "select false as pg, * from (" + _kid_names("'index'") + ") union all select true, * from (" + _kid_names("'index'").replace("kids k", "kids_pg k") + ")",
    BASE | {"ex": BASE["ex"].replace("where e is not null", " union all select raw_definition from g_indexes) where e is not null").replace("from (", "from (select * from (", 1),
            "kids_pg": _PG["kids"]},
    recursive=True,
)
