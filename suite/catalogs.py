"""Queries over landed catalogs. The landed tables are derived from the fleet, row by row."""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.sources import assemble, mssql, postgres, tables
from suite import fleet as _fleet  # noqa: F401  (defines the recipes used below)
from suite.base import load, once, oracle, recipe

QUERIES = {}
ORACLES = {}


def query(name):
    def add(fn):
        QUERIES[name] = fn
        return fn

    return add


# Landed SQL Server catalogs -----------------------------------------------------------
_OID = "cast(substr(tbl, 2) as bigint) * 10 + case when substr(tbl, 1, 1) = 'X' then 1 else 0 end"
_SID = "cast(substr(sch, 2) as int) + 5"
_CID = "cast(substr({0}, 2) as int) % 20 + 1"
recipe("m_schemas", f"""
select distinct pair_id, side, {_SID} as schema_id, sch as name from f_tables
union all select pair_id, side, 4, 'sys' from f_databases
union all select pair_id, side, 2, 'guest' from f_databases
union all select pair_id, side, 60, 'dbx_app' from f_databases
union all select pair_id, side, 61, 'db_app' from f_databases
union all select pair_id, side, 16385, 'late' from f_databases
""")
recipe("m_databases", """
select pair_id, side, 5 + pair_id as database_id, 0 as state, database as name, 'SQL_Latin1_General_CP1_CI_AS' as collation_name, true as is_current from f_databases
union all select pair_id, side, 1, 0, 'master', 'SQL_Latin1_General_CP1_CI_AS', false from f_databases
union all select pair_id, side, 900, 6, 'offline_' || pair_id, 'X', false from f_databases
""")
recipe("m_tables", f"select pair_id, side, {_OID} as object_id, {_SID} as schema_id, tbl as name, cast(substr(tbl, 2) as bigint) % 25 = 24 as is_ms_shipped from f_tables")
recipe("m_columns", f"""
select pair_id, side, {_OID} as object_id, ordinal as column_id, name,
       case when lower(data_type) like 'dec%' then 106 when lower(data_type) like 'nvar%' then 231 when lower(data_type) like 'datet%' then 42
            when data_type = 'bigint' then 127 else 56 end as user_type_id,
       case when lower(data_type) like 'nvar%' then case when ordinal % 3 = 2 then -1 else cast(replace(split_part(data_type, '(', 2), ')', '') as int) * 2 end else 8 end as max_length,
       case when lower(data_type) like 'dec%' then cast(split_part(split_part(data_type, '(', 2), ',', 1) as int) else 10 end as precision,
       case when lower(data_type) like 'dec%' then 2 when lower(data_type) like 'datet%' then 7 else 0 end as scale,
       is_nullable,
       case when lower(data_type) like 'nvar%' then coalesce(coll, case when ordinal % 2 = 0 then 'sql_latin1_general_cp1_ci_as' else 'SQL_Latin1_General_CP1_CI_AS' end) end as collation_name
from f_columns
""")
recipe("m_types", "\nunion all\n".join(f"select pair_id, side, {i} as user_type_id, '{n}' as name from f_databases" for i, n in ((106, "decimal"), (231, "nvarchar"), (42, "datetime2"), (127, "bigint"), (56, "int"))))
recipe("m_identity_columns", f"select pair_id, side, {_OID} as object_id, ordinal as column_id, pair_id * 10 + 1 as seed_value, cast(2 as bigint) as increment_value from f_columns where identity_clause is not null")
recipe("m_default_constraints", f"select pair_id, side, {_OID} as parent_object_id, ordinal as parent_column_id, coalesce(default_constraint, 'DF__' || name) as name, default_expr as definition from f_columns where default_expr is not null")
recipe("m_computed_columns", f"select pair_id, side, {_OID} as object_id, ordinal as column_id, computed_expr as definition, is_persisted from f_columns where computed_expr is not null")
recipe("m_key_constraints", f"select pair_id, side, {_OID} as parent_object_id, name, case when is_primary then 'PK' else 'UQ' end as type, case when is_primary then 1 when lower(name) like 'uq_old%' then 3 else 2 end as unique_index_id from f_keys")
recipe("m_indexes", f"""
select pair_id, side, {_OID} as object_id, case when is_primary then 1 when lower(name) like 'uq_old%' then 3 else 2 end as index_id, name, true as is_unique,
       case when is_clustered then 1 else 2 end as type, case when is_clustered then 'CLUSTERED' else 'NONCLUSTERED' end as type_desc,
       is_primary as is_primary_key, not is_primary as is_unique_constraint, false as is_hypothetical, cast(null as varchar(100)) as filter_definition from f_keys
union all
select pair_id, side, {_OID}, case when lower(name) like 'ix_old%' then 5 else 4 end, name, is_unique, case when is_clustered then 1 else 2 end,
       case when is_clustered then 'CLUSTERED' else 'NONCLUSTERED' end, false, false, false, filter_expr from f_indexes
union all
select pair_id, side, {_OID}, 0, null, false, 0, 'HEAP', false, false, false, null from f_tables
union all
select pair_id, side, {_OID}, 9, 'hyp_' || tbl, false, 2, 'NONCLUSTERED', false, false, true, null from f_tables
""")
_IC = "select pair_id, side, {oid} as object_id, {id} as index_id, {cid} as column_id, {ord} as key_ordinal, {d} as is_descending_key, {inc} as is_included_column, {pos} as index_column_id from {rel} where {c} is not null"


def _members():
    out = []
    key_id = "case when is_primary then 1 when lower(name) like 'uq_old%' then 3 else 2 end"
    ix_id = "case when lower(name) like 'ix_old%' then 5 else 4 end"
    for rel, ident in (("f_keys", key_id), ("f_indexes", ix_id)):
        for n in (1, 2):
            out.append(_IC.format(oid=_OID, id=ident, cid=_CID.format(f"c{n}"), ord=n, d=f"d{n}", inc="false", pos=n, rel=rel, c=f"c{n}"))
    for n in (1, 2):
        out.append(_IC.format(oid=_OID, id=ix_id, cid=_CID.format(f"i{n}"), ord=0, d="false", inc="true", pos=n + 2, rel="f_indexes", c=f"i{n}"))
    out.append(f"select pair_id, side, {_OID}, 9, 1, 1, false, false, 1 from f_tables")
    return "\nunion all\n".join(out)


recipe("m_index_columns", _members())
_FK_ID = "cast(substr(tbl, 2) as bigint) * 100 + case when lower(name) like 'fk_x%' then 51 when lower(name) like 'fk_own%' then 52 else 50 end"
_REF_OID = "cast(substr(ref_tbl, 2) as bigint) * 10 + case when substr(ref_tbl, 1, 1) = 'X' then 1 else 0 end"
recipe("m_foreign_keys", f"select pair_id, side, {_FK_ID} as object_id, name, {_OID} as parent_object_id, {_REF_OID} as referenced_object_id, replace(on_delete, ' ', '_') as delete_referential_action_desc, replace(on_update, ' ', '_') as update_referential_action_desc from f_fks")
recipe("m_foreign_key_columns", f"""
select pair_id, side, {_FK_ID} as constraint_object_id, 2 as constraint_column_id, {_OID} as parent_object_id, {_CID.format('c1')} as parent_column_id,
       {_REF_OID} as referenced_object_id, {_CID.format('rc1')} as referenced_column_id from f_fks
union all
select pair_id, side, {_FK_ID}, 1, {_OID}, {_CID.format('c1')} + 4, {_REF_OID}, {_CID.format('rc1')} + 5 from f_fks where on_delete = 'CASCADE'
""")
recipe("m_check_constraints", f"select pair_id, side, {_OID} as parent_object_id, name, expression as definition from f_checks")
recipe("m_objects", """
select pair_id, side, cast(input_ord as bigint) as object_id, cast(substr(sch, 2) as int) + 5 as schema_id, name,
       case kind when 'view' then 'V ' when 'procedure' then 'P ' when 'trigger' then 'TR' else case input_ord % 3 when 0 then 'FN' when 1 then 'IF' else 'TF' end end as type,
       input_ord % 90 = 4 as is_ms_shipped,
       case when parent is not null and input_ord % 7 <> 3 then cast(floor(input_ord / 4) as bigint) * 10 else cast(0 as bigint) end as parent_object_id
from f_code
union all
select pair_id, side, 100000000 + object_id, schema_id, name, 'U ', false, cast(0 as bigint) from m_tables
""")
recipe("m_sql_modules", """
select pair_id, side, cast(input_ord as bigint) as object_id, case when input_ord % 40 = 8 then null else definition end as definition from f_code
union all select pair_id, side, 100000000 + object_id, 'not a module' from m_tables
""")

_M_NAMES = "schemas databases tables columns types identity_columns default_constraints computed_columns key_constraints indexes index_columns foreign_keys foreign_key_columns check_constraints objects sql_modules".split()


class _Landed(dict):
    """Landed tables by name, made when asked for."""

    def __init__(self, make):
        super().__init__()
        self._make = make

    def __missing__(self, name):
        self[name] = self._make(name)
        return self[name]


def landed(spark, sf):
    return once(spark, ("landed", sf), lambda: _Landed(lambda name: load(spark, sf, "m_" + name)))


_TBL = "side, tbl"
_UT = {"ut": "select t.pair_id, t.side, t.object_id, s.name as schema, t.name as tbl from m_tables t join m_schemas s using (pair_id, side, schema_id) where not t.is_ms_shipped"}


def _tbl(df):
    return df.withColumnRenamed("table", "tbl")


def _shown(df):
    """Column lists as text, for comparison."""
    cols = F.transform("columns", lambda c: F.concat(c["name"], F.when(c["is_desc"], " DESC").otherwise("")))
    return df.withColumn("columns", F.array_join(cols, ","))


@query("cat_columns_mssql")
def _(spark, sf):
    return _tbl(mssql.columns(landed(spark, sf)))


ORACLES["cat_columns_mssql"] = oracle("""
select c.pair_id, c.side, ut.schema, ut.tbl, c.name, c.column_id as ordinal,
       case when tp.name = 'nvarchar' then tp.name || case when max_length = -1 then '(MAX)' else '(' || (max_length // 2) || ')' end
            when tp.name = 'decimal' then tp.name || '(' || precision || ',' || scale || ')' when tp.name = 'datetime2' then tp.name || '(' || scale || ')' else tp.name end as data_type,
       c.is_nullable, dc.definition as default_expr, dc.name as default_constraint,
       case when ic.seed_value is not null then 'IDENTITY(' || ic.seed_value || ',' || ic.increment_value || ')' end as identity_clause,
       cc.definition as computed_expr, coalesce(cc.is_persisted, false) as is_persisted,
       case when lower(c.collation_name) <> lower(d.collation_name) then c.collation_name end as collation
from m_columns c join ut using (pair_id, side, object_id) join m_types tp using (pair_id, side, user_type_id)
left join m_identity_columns ic on ic.pair_id = c.pair_id and ic.side = c.side and ic.object_id = c.object_id and ic.column_id = c.column_id
left join m_default_constraints dc on dc.pair_id = c.pair_id and dc.side = c.side and dc.parent_object_id = c.object_id and dc.parent_column_id = c.column_id
left join m_computed_columns cc on cc.pair_id = c.pair_id and cc.side = c.side and cc.object_id = c.object_id and cc.column_id = c.column_id
left join m_databases d on d.pair_id = c.pair_id and d.side = c.side and d.is_current
""", _UT)

_MEMBER = "m_index_columns ic join m_columns col using (pair_id, side, object_id, column_id)"


@query("cat_keys_mssql")
def _(spark, sf):
    return _tbl(_shown(mssql.keys(landed(spark, sf))))


ORACLES["cat_keys_mssql"] = oracle(f"""
select pair_id, side, schema, tbl, kc.name, kc.type = 'PK' as is_primary, i.type_desc = 'CLUSTERED' as is_clustered,
       string_agg(m.name || case when m.is_descending_key then ' DESC' else '' end, ',' order by m.key_ordinal) as columns
from (select *, parent_object_id as object_id, unique_index_id as index_id from m_key_constraints) kc join ut using (pair_id, side, object_id)
join m_indexes i using (pair_id, side, object_id, index_id)
join (select pair_id, side, object_id, index_id, key_ordinal, is_descending_key, col.name from {_MEMBER} where not is_included_column) m using (pair_id, side, object_id, index_id)
group by all
""", _UT)


@query("cat_indexes_mssql")
def _(spark, sf):
    rows = _shown(mssql.indexes(landed(spark, sf))).drop("raw_definition")
    return _tbl(rows.withColumn("included", F.array_join("included", ",")))


ORACLES["cat_indexes_mssql"] = oracle(f"""
select pair_id, side, schema, tbl, i.name, i.is_unique, i.type_desc = 'CLUSTERED' as is_clustered, i.filter_definition as filter_expr,
       coalesce(string_agg(m.name || case when m.is_descending_key then ' DESC' else '' end, ',' order by m.key_ordinal) filter (not m.is_included_column), '') as columns,
       coalesce(string_agg(m.name, ',' order by m.index_column_id) filter (m.is_included_column), '') as included
from m_indexes i join ut using (pair_id, side, object_id)
join (select pair_id, side, object_id, index_id, key_ordinal, index_column_id, is_descending_key, is_included_column, col.name from {_MEMBER}) m using (pair_id, side, object_id, index_id)
where not is_primary_key and not is_unique_constraint and type > 0 and not is_hypothetical
group by all
""", _UT)


@query("cat_fks_mssql")
def _(spark, sf):
    rows = mssql.foreign_keys(landed(spark, sf))
    pairs = F.transform("columns", lambda c: F.concat(c["name"], F.lit(">"), c["ref_name"]))
    return _tbl(rows.withColumn("columns", F.array_join(pairs, ",")))


ORACLES["cat_fks_mssql"] = oracle("""
select fk.pair_id, fk.side, ut.schema, ut.tbl, fk.name, rs.name as ref_schema, rt.name as ref_table,
       replace(delete_referential_action_desc, '_', ' ') as on_delete, replace(update_referential_action_desc, '_', ' ') as on_update,
       string_agg(pc.name || '>' || rc.name, ',' order by k.constraint_column_id) as columns
from m_foreign_keys fk join ut on ut.pair_id = fk.pair_id and ut.side = fk.side and ut.object_id = fk.parent_object_id
join m_foreign_key_columns k on k.pair_id = fk.pair_id and k.side = fk.side and k.constraint_object_id = fk.object_id
join m_columns pc on pc.pair_id = fk.pair_id and pc.side = fk.side and pc.object_id = k.parent_object_id and pc.column_id = k.parent_column_id
join m_columns rc on rc.pair_id = fk.pair_id and rc.side = fk.side and rc.object_id = k.referenced_object_id and rc.column_id = k.referenced_column_id
join m_tables rt on rt.pair_id = fk.pair_id and rt.side = fk.side and rt.object_id = fk.referenced_object_id
join m_schemas rs on rs.pair_id = fk.pair_id and rs.side = fk.side and rs.schema_id = rt.schema_id
group by all
""", _UT)


@query("cat_checks_mssql")
def _(spark, sf):
    return _tbl(mssql.checks(landed(spark, sf)))


ORACLES["cat_checks_mssql"] = oracle(
    "select pair_id, side, schema, tbl, c.name, c.definition as expression from (select *, parent_object_id as object_id from m_check_constraints) c join ut using (pair_id, side, object_id)", _UT
)


@query("cat_code_mssql")
def _(spark, sf):
    return mssql.code_objects(landed(spark, sf))


ORACLES["cat_code_mssql"] = oracle("""
select o.pair_id, o.side, case trim(o.type) when 'V' then 'view' when 'P' then 'procedure' when 'TR' then 'trigger' else 'function' end as kind, s.name as schema, o.name,
       m.definition, ps.name || '.' || pt.name as parent_table, o.object_id as input_ord
from m_sql_modules m join m_objects o using (pair_id, side, object_id)
join m_schemas s on s.pair_id = o.pair_id and s.side = o.side and s.schema_id = o.schema_id
left join m_tables pt on pt.pair_id = o.pair_id and pt.side = o.side and pt.object_id = o.parent_object_id
left join m_schemas ps on ps.pair_id = pt.pair_id and ps.side = pt.side and ps.schema_id = pt.schema_id
where not o.is_ms_shipped and trim(o.type) in ('V', 'P', 'FN', 'IF', 'TF', 'TR') and m.definition is not null and (trim(o.type) <> 'TR' or pt.object_id is not null)
""")


@query("list_schemas")
def _(spark, sf):
    return mssql.list_schemas(load(spark, sf, "m_schemas")).orderBy("pair_id", "side", "schema")


ORACLES["list_schemas"] = oracle(
    "select pair_id, side, name as schema from m_schemas where schema_id < 16384 and name not in ('sys', 'INFORMATION_SCHEMA', 'guest') and not starts_with(name, 'db_')"
)


@query("list_databases")
def _(spark, sf):
    return tables.list_databases(load(spark, sf, "m_databases"), "SQL Server")


ORACLES["list_databases"] = oracle("select pair_id, side, name from m_databases where database_id > 4 and state = 0")

recipe("type_parts", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case l_linenumber % 7 when 0 then 'nvarchar' when 1 then 'nchar' when 2 then 'varchar' when 3 then 'decimal' when 4 then 'datetime2' when 5 then 'int' else 'varbinary' end as name,
       case when l_partkey % 5 = 0 then -1 else cast(l_suppkey as int) end as max_length, cast(l_partkey % 38 + 1 as int) as precision, cast(l_suppkey % 8 as int) as scale
from {lineitem}
""")


@query("format_type")
def _(spark, sf):
    rows = load(spark, sf, "type_parts")
    text = mssql.format_type(*map(F.col, ("name", "max_length", "precision", "scale")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("type_text"))


ORACLES["format_type"] = oracle("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
       case when name in ('nvarchar', 'nchar') then name || case when max_length = -1 then '(MAX)' else '(' || (max_length // 2) || ')' end
            when name in ('varchar', 'varbinary') then name || case when max_length = -1 then '(MAX)' else '(' || max_length || ')' end
            when name = 'decimal' then name || '(' || precision || ',' || scale || ')' when name = 'datetime2' then name || '(' || scale || ')' else name end as type_text
from type_parts
""")

# Landed PostgreSQL catalogs ---------------------------------------------------------------
recipe("p_pg_namespace", """
select distinct pair_id, side, cast(substr(sch, 2) as bigint) + 5 as oid, sch as nspname from f_tables
union all select pair_id, side, 1, 'pg_catalog' from f_databases
union all select pair_id, side, 2, 'pg_temp_1' from f_databases
union all select pair_id, side, 3, 'information_schema' from f_databases
union all select pair_id, side, 4, 'pgx' from f_databases
""")
_IX_OID = f"({_OID}) * 100 + 70 + case when lower(name) like 'ix_old%' then 1 when lower(name) like 'pk%' then 2 when lower(name) like 'uq_old%' then 3 when lower(name) like 'uq%' then 4 else 0 end"
recipe("p_pg_class", f"""
select pair_id, side, {_OID} as oid, tbl as relname, cast(substr(sch, 2) as bigint) + 5 as relnamespace, 'r' as relkind, cast(null as varchar(10)) as viewdef from f_tables
union all
select pair_id, side, {_IX_OID}, name, cast(substr(sch, 2) as bigint) + 5, 'i', null from f_indexes
union all
select pair_id, side, {_IX_OID}, name, cast(substr(sch, 2) as bigint) + 5, 'i', null from f_keys
union all
select pair_id, side, 900000000 + input_ord, name, cast(substr(sch, 2) as bigint) + 5, 'v', ' SELECT ' || input_ord || case when input_ord % 8 = 0 then ';;' || chr(10) else ';' end from f_code where kind = 'view'
union all
select pair_id, side, 8, 'pg_class', 1, 'r', null from f_databases
""")
recipe("p_pg_attribute", f"""
select pair_id, side, {_OID} as attrelid, name as attname, ordinal as attnum, case when data_type like 'char%' then 25 else 23 end as atttypid, data_type, not is_nullable as attnotnull,
       case when identity_clause like '%ALWAYS%' then 'a' when identity_clause is not null then 'd' else '' end as attidentity,
       case when computed_expr is not null then 's' else '' end as attgenerated,
       case when data_type like 'char%' then case when coll is not null then 950 else 100 end else 0 end as attcollation, ordinal = 18 and side = 'target' as attisdropped
from g_columns
union all
select pair_id, side, {_OID}, 'ctid', -1, 23, 'tid', true, '', '', 0, false from f_tables
""")
recipe("p_pg_type", "select pair_id, side, 25 as oid, 100 as typcollation from f_databases union all select pair_id, side, 23, 0 from f_databases")
recipe("p_pg_attrdef", f"select pair_id, side, {_OID} as adrelid, ordinal as adnum, coalesce(computed_expr, default_expr) as expr from g_columns where computed_expr is not null or default_expr is not null")
recipe("p_pg_collation", "select pair_id, side, 950 as oid, 'C' as collname from f_databases union all select pair_id, side, 100, 'default' from f_databases")
recipe("p_flat_constraint", f"""
select pair_id, side, {_IX_OID} as oid, name as conname, case when is_primary then 'p' else 'u' end as contype, {_OID} as conrelid,
       case when c2 is null then {_CID.format('c1')} else {_CID.format('c2')} end as k1, case when c2 is not null then {_CID.format('c1')} end as k2,
       cast(0 as bigint) as confrelid, cast(null as int) as r1, cast(null as int) as r2, ' ' as confdeltype, ' ' as confupdtype, {_IX_OID} as conindid, 'KEY' as condef
from f_keys
union all
select pair_id, side, {_FK_ID} + 500000000, name, 'f', {_OID}, {_CID.format('c1')}, {_CID.format('c1')} + 4, {_REF_OID}, {_CID.format('rc1')}, {_CID.format('rc1')} + 5,
       case on_delete when 'CASCADE' then 'c' when 'SET NULL' then 'n' else case when pair_id % 2 = 0 then 'a' else 'r' end end, case on_update when 'SET NULL' then 'd' else 'a' end, 0, 'FOREIGN KEY'
from f_fks
union all
select pair_id, side, ({_OID}) + 700000000, name, 'c', {_OID}, null, null, 0, null, null, ' ', ' ', 0, case when pair_id % 2 = 0 then 'CHECK ' else 'check  ' end || expression || ' ' from f_checks
union all
select pair_id, side, ({_OID}) + 800000000, 'x_' || name, 'x', {_OID}, 1, null, 0, null, null, ' ', ' ', 0, 'EXCLUDE' from f_checks
""")
recipe("p_pg_index", f"""
select pair_id, side, {_IX_OID} as indexrelid, {_OID} as indrelid, is_unique as indisunique, false as indisprimary, 'CREATE INDEX ' || name || ' (' || c1 || ')' as indexdef from f_indexes
union all
select pair_id, side, {_IX_OID}, {_OID}, true, is_primary, 'KEY' from f_keys
""")
recipe("p_pg_proc", """
select pair_id, side, cast(input_ord as bigint) as oid, split_part(name, '(', 1) as proname, cast(substr(sch, 2) as bigint) + 5 as pronamespace,
       case when input_ord % 50 = 9 then 'a' when kind = 'procedure' then 'p' else 'f' end as prokind,
       case when kind = 'function' then 'integer, text' end as identity_args, definition as def
from f_code where kind in ('function', 'procedure')
""")
recipe("p_pg_depend", "select pair_id, side, oid as objid, case when oid % 3 = 0 then 'e' else 'n' end as deptype from p_pg_proc where oid % 7 < 4")
recipe("p_pg_trigger", """
select pair_id, side, 800000000 + input_ord as oid, name as tgname, cast(floor(input_ord / 4) as bigint) * 10 as tgrelid, input_ord % 5 = 0 as tgisinternal, definition as def from f_code where kind = 'trigger'
""")


def landed_pg(spark, sf):
    def make(name):
        if name != "pg_constraint":
            return load(spark, sf, "p_" + name)
        flat = load(spark, sf, "p_flat_constraint")
        return flat.withColumn("conkey", F.array_compact(F.array("k1", "k2"))).withColumn("confkey", F.array_compact(F.array("r1", "r2")))

    return once(spark, ("landed_pg", sf), lambda: _Landed(make))


_NS = {
    "ns": "select pair_id, side, oid as nsp_oid, nspname as schema from p_pg_namespace where nspname not in ('pg_catalog', 'information_schema') and not starts_with(nspname, 'pg_')",
    "rel": "select c.pair_id, c.side, c.oid as rel_oid, relname as tbl, relkind, viewdef, ns.schema from p_pg_class c join ns on ns.pair_id = c.pair_id and ns.side = c.side and ns.nsp_oid = c.relnamespace",
}


@query("cat_columns_pg")
def _(spark, sf):
    return _tbl(postgres.columns(landed_pg(spark, sf))).drop("default_constraint")


ORACLES["cat_columns_pg"] = oracle("""
select a.pair_id, a.side, rel.schema, rel.tbl, a.attname as name, a.attnum as ordinal, a.data_type, not a.attnotnull as is_nullable,
       case when a.attgenerated <> 's' then ad.expr end as default_expr,
       case a.attidentity when 'a' then 'GENERATED ALWAYS AS IDENTITY' when 'd' then 'GENERATED BY DEFAULT AS IDENTITY' end as identity_clause,
       case when a.attgenerated = 's' then ad.expr end as computed_expr, a.attgenerated = 's' as is_persisted,
       case when a.attcollation <> 0 and a.attcollation <> t.typcollation then col.collname end as collation
from p_pg_attribute a join rel on rel.pair_id = a.pair_id and rel.side = a.side and rel.rel_oid = a.attrelid and rel.relkind = 'r'
join p_pg_type t on t.pair_id = a.pair_id and t.side = a.side and t.oid = a.atttypid
left join p_pg_attrdef ad on ad.pair_id = a.pair_id and ad.side = a.side and ad.adrelid = a.attrelid and ad.adnum = a.attnum
left join p_pg_collation col on col.pair_id = a.pair_id and col.side = a.side and col.oid = a.attcollation
where a.attnum > 0 and not a.attisdropped
""", _NS)


@query("cat_constraints_pg")
def _(spark, sf):
    rows = postgres.constraints(landed_pg(spark, sf))

    def names(c):
        return F.array_join(F.transform(c, lambda x: x["name"]), ",").alias(c)

    return rows.select(
        "pair_id", "side", "schema", F.col("table").alias("tbl"), "name", "contype", names("own_columns"), names("ref_columns"),
        "ref_schema", "ref_table", "on_delete", "on_update", "expression",
    )


def _att(rel, *keys):
    parts = ", ".join(
        f"(select attname from p_pg_attribute a where a.pair_id = con.pair_id and a.side = con.side and a.attrelid = con.{rel} and a.attnum = con.{k})" for k in keys
    )
    return f"nullif(concat_ws(',', {parts}), '')"


def _act(c):
    return f"case {c} when 'c' then 'CASCADE' when 'n' then 'SET NULL' when 'd' then 'SET DEFAULT' when 'r' then 'RESTRICT' else 'NO ACTION' end"


ORACLES["cat_constraints_pg"] = oracle(f"""
select con.pair_id, con.side, rel.schema, rel.tbl, con.conname as name, con.contype, {_att('conrelid', 'k1', 'k2')} as own_columns, {_att('confrelid', 'r1', 'r2')} as ref_columns,
       rn.nspname as ref_schema, rc.relname as ref_table, {_act('confdeltype')} as on_delete, {_act('confupdtype')} as on_update,
       case when starts_with(upper(condef), 'CHECK ') then trim(condef[7:]) else condef end as expression
from p_flat_constraint con join rel on rel.pair_id = con.pair_id and rel.side = con.side and rel.rel_oid = con.conrelid
left join p_pg_class rc on rc.pair_id = con.pair_id and rc.side = con.side and rc.oid = con.confrelid
left join p_pg_namespace rn on rn.pair_id = rc.pair_id and rn.side = rc.side and rn.oid = rc.relnamespace
where con.contype in ('p', 'u', 'f', 'c')
""", _NS)


@query("cat_indexes_pg")
def _(spark, sf):
    return _tbl(postgres.indexes(landed_pg(spark, sf))).select("pair_id", "side", "schema", "tbl", "name", "is_unique", "raw_definition")


ORACLES["cat_indexes_pg"] = oracle("""
select i.pair_id, i.side, rel.schema, rel.tbl, ic.relname as name, i.indisunique as is_unique, i.indexdef as raw_definition
from p_pg_index i join p_pg_class ic on ic.pair_id = i.pair_id and ic.side = i.side and ic.oid = i.indexrelid
join rel on rel.pair_id = i.pair_id and rel.side = i.side and rel.rel_oid = i.indrelid and rel.relkind = 'r'
where not i.indisprimary and not exists (select 1 from p_flat_constraint c where c.pair_id = i.pair_id and c.side = i.side and c.conindid = i.indexrelid)
""", _NS)


@query("cat_views_pg")
def _(spark, sf):
    return postgres.views(landed_pg(spark, sf)).drop("parent_table")


ORACLES["cat_views_pg"] = oracle("""
select pair_id, side, 'view' as kind, schema, tbl as name,
       'CREATE OR REPLACE VIEW "' || schema || '"."' || tbl || '" AS' || chr(10) || rtrim(rtrim(viewdef, chr(10) || ' '), ';') || ';' as definition
from rel where relkind = 'v'
""", _NS)


@query("cat_routines_pg")
def _(spark, sf):
    return postgres.routines(landed_pg(spark, sf)).drop("parent_table")


ORACLES["cat_routines_pg"] = oracle("""
select p.pair_id, p.side, case when prokind = 'p' then 'procedure' else 'function' end as kind, ns.schema, proname || '(' || coalesce(identity_args, '') || ')' as name, def as definition
from p_pg_proc p join ns on ns.pair_id = p.pair_id and ns.side = p.side and ns.nsp_oid = p.pronamespace
where prokind in ('f', 'p') and not exists (select 1 from p_pg_depend d where d.pair_id = p.pair_id and d.side = p.side and d.objid = p.oid and d.deptype = 'e')
""", _NS)


@query("cat_triggers_pg")
def _(spark, sf):
    return postgres.triggers(landed_pg(spark, sf))


ORACLES["cat_triggers_pg"] = oracle("""
select t.pair_id, t.side, 'trigger' as kind, rel.schema, t.tgname as name, t.def as definition, rel.schema || '.' || rel.tbl as parent_table
from p_pg_trigger t join rel on rel.pair_id = t.pair_id and rel.side = t.side and rel.rel_oid = t.tgrelid where not tgisinternal
""", _NS)


@query("list_schemas_pg")
def _(spark, sf):
    both = postgres.list_schemas(landed_pg(spark, sf)).withColumn("scope", F.lit(""))
    one = postgres.list_schemas(landed_pg(spark, sf), scope="s2").withColumn("scope", F.lit("s2"))
    return both.unionByName(one).drop("nsp_oid")


ORACLES["list_schemas_pg"] = oracle(
    "select pair_id, side, schema, '' as scope from ns union all select pair_id, side, nspname, 's2' from p_pg_namespace where nspname = 's2'", _NS
)


# Whole snapshots from landed catalogs -----------------------------------------------------
_SAID = {
    "databases": ["database"],
    "schemas": ["schema"],
    "tables": ["schema", "tbl"],
    "columns": "schema tbl name ordinal data_type is_nullable default_expr default_constraint identity_clause computed_expr is_persisted collation".split(),
    "keys": "schema tbl name is_primary is_clustered columns".split(),
    "fks": "schema tbl name columns ref_schema ref_table on_delete on_update".split(),
    "indexes": "schema tbl name is_unique is_clustered columns included filter_expr raw_definition".split(),
    "checks": "schema tbl name expression".split(),
    "code_objects": "kind schema name definition parent_table input_ord".split(),
}


def _listed(snapshot):
    """Every row of a snapshot as (part, pair_id, side, said), `said` being all of its values, a dot for null."""
    out = None
    for part, names in _SAID.items():
        rows = _tbl(getattr(snapshot, part)) if "tbl" in names else getattr(snapshot, part)
        if part in ("keys", "indexes"):
            rows = _shown(rows)
        if part == "indexes":
            rows = rows.withColumn("included", F.array_join("included", ","))
        if part == "fks":
            rows = rows.withColumn("columns", F.array_join(F.transform("columns", lambda c: F.concat(c["name"], F.lit(">"), c["ref_name"])), ","))
        said = F.concat_ws("|", *[F.coalesce(F.col(n).cast("string"), F.lit(".")) for n in names])
        rows = rows.select(F.lit(part).alias("part"), "pair_id", "side", said.alias("said"))
        out = rows if out is None else out.union(rows)
    return out


def _listed_sql(parts):
    rows = []
    for part, names in _SAID.items():
        said = ", ".join(f'''coalesce(cast("{n}" as varchar), '.')''' for n in names)
        rows.append(f"select '{part}' as part, pair_id, side, concat_ws('|', {said}) as said from (\n{parts[part]}\n) x")
    return "\nunion all\n".join(rows)


def _ranked_sql(code):
    return f"select *, row_number() over (partition by pair_id, side order by object_id, kind, schema, name) as input_ord from ({code}) c"


@query("snapshot_mssql")
def _(spark, sf):
    return _listed(assemble.from_mssql(landed(spark, sf)))


ORACLES["snapshot_mssql"] = _listed_sql({
    "databases": oracle("select pair_id, side, name as database from m_databases where is_current"),
    "schemas": ORACLES["list_schemas"],
    "tables": oracle("select pair_id, side, schema, tbl from ut", _UT),
    "columns": ORACLES["cat_columns_mssql"],
    "keys": ORACLES["cat_keys_mssql"],
    "fks": ORACLES["cat_fks_mssql"],
    "indexes": f"select *, null as raw_definition from ({ORACLES['cat_indexes_mssql']}) i",
    "checks": ORACLES["cat_checks_mssql"],
    "code_objects": _ranked_sql(f"select * exclude (input_ord), input_ord as object_id from ({ORACLES['cat_code_mssql']}) m"),
})

_PG_CODE = """
select v.*, null as parent_table, c.oid as object_id from ({views}) v
join (select pair_id, side, schema, tbl as name, rel_oid as oid from ({rel}) r where relkind = 'v') c using (pair_id, side, schema, name)
union all by name
select p.pair_id, p.side, case when prokind = 'p' then 'procedure' else 'function' end as kind, ns.schema, proname || '(' || coalesce(identity_args, '') || ')' as name, def as definition,
       null as parent_table, p.oid as object_id
from ({proc}) p join ({ns}) ns on ns.pair_id = p.pair_id and ns.side = p.side and ns.nsp_oid = p.pronamespace
union all by name
select t.pair_id, t.side, 'trigger' as kind, rel.schema, t.tgname as name, t.def as definition, rel.schema || '.' || rel.tbl as parent_table, t.oid as object_id
from ({trg}) t join ({rel}) rel on rel.pair_id = t.pair_id and rel.side = t.side and rel.rel_oid = t.tgrelid
"""
_PROC = "select * from p_pg_proc p where prokind in ('f', 'p') and not exists (select 1 from p_pg_depend d where d.pair_id = p.pair_id and d.side = p.side and d.objid = p.oid and d.deptype = 'e')"


def _pg_parts():
    # No constraint or trigger is on an index; the derived ids of the two can meet.
    con, ix = ORACLES["cat_constraints_pg"].replace("rel.rel_oid = con.conrelid", "rel.rel_oid = con.conrelid and rel.relkind <> 'i'"), ORACLES["cat_indexes_pg"]
    code = _PG_CODE.format(
        views=ORACLES["cat_views_pg"], rel=oracle("select * from rel where relkind <> 'i'", _NS), ns=oracle("select * from ns", _NS), proc=oracle(_PROC),
        trg=oracle("select * from p_pg_trigger where not tgisinternal"),
    )
    pairs = "array_to_string(list_transform(list_zip(string_split(own_columns, ','), string_split(ref_columns, ',')), lambda p: p[1] || '>' || p[2]), ',')"
    return {
        "databases": oracle("select pair_id, side, database from f_databases"),
        "schemas": oracle("select pair_id, side, schema from ns", _NS),
        "tables": oracle("select pair_id, side, schema, tbl from rel where relkind = 'r'", _NS),
        "columns": f"select *, null as default_constraint from ({ORACLES['cat_columns_pg']}) c",
        "keys": f'''select *, contype = 'p' as is_primary, false as is_clustered, own_columns as "columns" from ({con}) c where contype in ('p', 'u')''',
        "fks": f"""select *, {pairs} as "columns" from ({con}) c where contype = 'f'""",
        "indexes": f'''select *, false as is_clustered, '' as "columns", '' as included, null as filter_expr from ({ix}) i''',
        "checks": f"select * from ({con}) c where contype = 'c'",
        "code_objects": code,
    }


def _pg_snapshot(spark, sf, scope=None):
    return assemble.from_postgres(landed_pg(spark, sf), load(spark, sf, "f_databases").select("pair_id", "side", "database"), scope)


@query("snapshot_pg")
def _(spark, sf):
    return _listed(_pg_snapshot(spark, sf))


_PG = _pg_parts()
ORACLES["snapshot_pg"] = _listed_sql(_PG | {"code_objects": _ranked_sql(_PG["code_objects"])})


@query("snapshot_pg_scope")
def _(spark, sf):
    return _listed(_pg_snapshot(spark, sf, "s2"))


# A scope ranks what it holds.
_SCOPED = {part: sql if part == "databases" else f"select * from ({sql}) s where schema = 's2'" for part, sql in _PG.items()}
ORACLES["snapshot_pg_scope"] = _listed_sql(_SCOPED | {"code_objects": _ranked_sql(_SCOPED["code_objects"])})
