"""Catalogs of a fleet of databases, derived from `part`: 20 columns make a table, ten tables
a database pair, so more data means more pairs. The target side has drifted.

Names are `sch` and `tbl` here because `table` is a reserved word in one of the engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evenkeel.plans.lineage import landed
from evenkeel.sources import snapshot
from suite.base import load, once, recipe

recipe(
    "f_base",
    """
select cast(floor(p_partkey / 200) as bigint) as pair_id, cast(floor(p_partkey / 20) as bigint) as tno,
       cast(floor(p_partkey / 20) as bigint) * 20 as k0
from {part} group by 1, 2, 3
""",
)
recipe(
    "f_databases",
    """
select pair_id, 'source' as side, 'SQL Server' as provider, 'src_' || pair_id as database from f_base group by pair_id
union all
select pair_id, 'target', case when pair_id % 9 = 8 then 'PostgreSQL' else 'SQL Server' end, 'tgt_' || pair_id
from f_base group by pair_id
""",
)
recipe(
    "f_tables",
    """
select pair_id, 'source' as side, 's' || (tno % 3) as sch, 'T' || tno as tbl from f_base
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno from f_base where tno % 11 <> 3
union all
select pair_id, 'target', 's' || (tno % 3), 'X' || tno from f_base where tno % 13 = 5
""",
)
recipe(
    "f_schemas",
    """
select distinct pair_id, side, sch from f_tables
union all
select distinct pair_id, 'source', 'o''new' || pair_id from f_base where pair_id % 2 = 0
""",
)
recipe(
    "f_cols_s",
    """
select cast(floor(p_partkey / 200) as bigint) as pair_id, cast(floor(p_partkey / 20) as bigint) as tno, p_partkey as k,
       'c' || p_partkey as name, cast(p_partkey % 20 + 1 as int) as ordinal,
       case when p_partkey % 20 = 0 then 'int'
            when p_partkey % 4 = 0 then 'decimal(' || (p_size + 1) || ',2)'
            when p_partkey % 4 = 1 then 'nvarchar(' || (p_size * 2) || ')'
            when p_partkey % 4 = 2 then 'int' else 'datetime2(7)' end as data_type,
       p_partkey % 2 = 1 as is_nullable,
       case when p_partkey % 4 = 0 and p_partkey % 20 <> 0 then '((' || p_size || '))' end as default_expr,
       case when p_partkey % 8 = 0 and p_partkey % 20 <> 0 then 'DF_' || p_partkey end as default_constraint,
       case when p_partkey % 20 = 0 then 'IDENTITY(1,1)' end as identity_clause,
       case when p_partkey % 20 = 19 then '([c' || (p_partkey - 1) || ']*(2))' end as computed_expr,
       p_partkey % 40 = 19 as is_persisted,
       case when p_partkey % 12 = 1 then 'Latin1_General_CI_AS' end as coll
from {part}
""",
)
_COL_TAIL = "name, ordinal, data_type, is_nullable, default_expr, default_constraint, identity_clause, computed_expr, is_persisted, coll"
recipe(
    "f_columns",
    f"""
select pair_id, 'source' as side, 's' || (tno % 3) as sch, 'T' || tno as tbl, {_COL_TAIL} from f_cols_s
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno,
       case when k % 3 = 0 then upper(name) else name end, ordinal,
       case when k % 13 = 0 then 'bigint' when k % 7 = 0 then upper(data_type) else data_type end,
       case when k % 17 = 0 then not is_nullable else is_nullable end,
       case when k % 19 = 0 then '(getdate())' when k % 5 = 0 then replace(replace(default_expr, '((', ''), '))', '') else default_expr end,
       default_constraint,
       case when tno % 7 = 0 then null else identity_clause end,
       case when k % 60 = 19 then '([c1] + (1))' when k % 80 = 39 then computed_expr || ' ' else computed_expr end,
       case when k % 100 = 59 then not is_persisted else is_persisted end,
       case when k % 24 = 1 then null else coll end
from f_cols_s where k % 23 <> 0 and tno % 11 <> 3
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno, 'x' || k, ordinal + 100,
       data_type, is_nullable, default_expr, default_constraint, null, null, false, coll
from f_cols_s where k % 29 = 0 and tno % 11 <> 3
union all
select pair_id, 'target', 's' || (tno % 3), 'X' || tno, {_COL_TAIL} from f_cols_s where tno % 13 = 5
""",
)
# Keys with one or two columns; a NULL second name stands for one column.
recipe(
    "f_keys",
    """
select pair_id, 'source' as side, 's' || (tno % 3) as sch, 'T' || tno as tbl, 'PK_T' || tno as name, true as is_primary,
       true as is_clustered, 'c' || k0 as c1, false as d1, case when tno % 4 = 1 then 'c' || (k0 + 1) end as c2, tno % 8 = 1 as d2
from f_base where tno % 9 <> 8
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno,
       case when tno % 3 = 0 then 'pk_t' else 'PK_T' end || tno, true, tno % 10 <> 6, 'C' || k0, false,
       case when tno % 4 = 1 and tno % 5 <> 1 then 'c' || (k0 + 1) end, tno % 8 = 1
from f_base where tno % 11 <> 3 and tno % 17 <> 2 and (tno % 9 <> 8 or tno % 2 = 0)
union all
select pair_id, 'source', 's' || (tno % 3), 'T' || tno, 'UQ_T' || tno, false, false, 'c' || (k0 + 2), false, null, false
from f_base where tno % 2 = 0
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno, 'uq_T' || tno, false, false,
       case when tno % 10 = 4 then 'c' || (k0 + 3) else 'c' || (k0 + 2) end, false, null, false
from f_base where tno % 2 = 0 and tno % 6 <> 0 and tno % 11 <> 3
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno, 'UQ_old_' || tno, false, false,
       'c' || (k0 + 5), true, 'c' || (k0 + 6), false
from f_base where tno % 7 = 1 and tno % 11 <> 3
""",
)
recipe(
    "f_fks",
    """
select pair_id, 'source' as side, 's' || (tno % 3) as sch, 'T' || tno as tbl, 'FK_T' || tno as name, 'c' || (k0 + 1) as c1,
       's' || ((tno - 1) % 3) as ref_sch, 'T' || (tno - 1) as ref_tbl, 'c' || (k0 - 20) as rc1,
       case when tno % 3 = 0 then 'CASCADE' else 'NO ACTION' end as on_delete,
       case when tno % 5 = 0 then 'SET NULL' else 'NO ACTION' end as on_update
from f_base where tno % 10 <> 0
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno, 'FK_T' || tno, 'C' || (k0 + 1),
       's' || ((tno - 1) % 3), 'T' || (tno - 1), 'c' || (k0 - 20),
       case when tno % 6 = 2 then 'SET NULL' when tno % 3 = 0 then 'CASCADE' else 'NO ACTION' end,
       case when tno % 5 = 0 then 'SET NULL' else 'NO ACTION' end
from f_base where tno % 10 <> 0 and tno % 8 <> 3 and tno % 11 <> 3
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno, 'FK_x_' || tno, 'c' || (k0 + 2),
       's' || (tno % 3), 'X' || tno, 'c' || k0, 'NO ACTION', 'NO ACTION'
from f_base where tno % 13 = 5 and tno % 11 <> 3
union all
select pair_id, 'target', 's' || (tno % 3), 'X' || tno, 'FK_own_' || tno, 'c' || (k0 + 2),
       's' || (tno % 3), 'T' || tno, 'c' || k0, 'NO ACTION', 'NO ACTION'
from f_base where tno % 13 = 5
""",
)
recipe(
    "f_indexes",
    """
select pair_id, 'source' as side, 's' || (tno % 3) as sch, 'T' || tno as tbl, 'IX_T' || tno as name, tno % 4 = 0 as is_unique,
       false as is_clustered, 'c' || (k0 + 4) as c1, false as d1, 'c' || (k0 + 5) as c2, true as d2,
       'c' || (k0 + 6) as i1, 'c' || (k0 + 7) as i2,
       case when tno % 5 = 0 then '([c' || (k0 + 4) || '] IS NOT NULL)' end as filter_expr
from f_base
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno, 'ix_T' || tno,
       case when tno % 7 = 3 then not tno % 4 = 0 else tno % 4 = 0 end, false, 'c' || (k0 + 4), false, 'c' || (k0 + 5), true,
       'c' || (k0 + 7), 'c' || (k0 + 6), case when tno % 5 = 0 then '([C' || (k0 + 4) || '] is not null)' end
from f_base where tno % 5 <> 2 and tno % 11 <> 3
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno, 'IX_old_' || tno, false, true,
       'c' || (k0 + 9), false, null, false, null, null, null
from f_base where tno % 9 = 4 and tno % 11 <> 3
""",
)
recipe(
    "f_checks",
    """
select pair_id, 'source' as side, 's' || (tno % 3) as sch, 'T' || tno as tbl, 'CK_T' || tno as name,
       '([c' || (k0 + 8) || ']>(0))' as expression from f_base
union all
select pair_id, 'target', 's' || (tno % 3), case when tno % 4 = 2 then 't' else 'T' end || tno, 'CK_T' || tno,
       case when tno % 6 = 1 then '([c' || (k0 + 8) || ']>(1))' else '[C' || (k0 + 8) || ']>(0)' end
from f_base where tno % 6 <> 5 and tno % 11 <> 3
""",
)
recipe(
    "f_code",
    """
select pair_id, 'source' as side, 'view' as kind, 's' || (tno % 3) as sch, 'vw_T' || tno as name,
       'CREATE VIEW s' || (tno % 3) || '.vw_T' || tno || ' AS' || chr(10) || '  SELECT * FROM T' || tno
         || case when tno % 10 <> 0 then ' JOIN s' || ((tno - 1) % 3) || '.VW_T' || (tno - 1) else '' end || ';  ' as definition,
       cast(null as varchar(10)) as parent, cast(tno * 4 as int) as input_ord from f_base
union all
select pair_id, 'source', 'function', 's' || (tno % 3), 'fn_T' || tno || '(integer, text)',
       'CREATE FUNCTION fn_T' || tno || '(a integer, b text) AS x', null, cast(tno * 4 + 1 as int) from f_base where tno % 2 = 0
union all
select pair_id, 'source', 'procedure', 's' || (tno % 3), 'p_T' || tno,
       'CREATE PROC p_T' || tno || ' AS' || chr(10) || 'SELECT 1', null, cast(tno * 4 + 2 as int) from f_base where tno % 3 = 0
union all
select pair_id, 'source', 'trigger', 's' || (tno % 3), 'trg_T' || tno,
       'CREATE TRIGGER trg_T' || tno || ' ON T' || tno || ' AS x', 's' || (tno % 3) || '.T' || tno, cast(tno * 4 + 3 as int) from f_base where tno % 4 = 0
union all
select pair_id, 'target', 'view', 's' || (tno % 3), case when tno % 4 = 0 then 'VW_T' else 'vw_T' end || tno,
       'CREATE VIEW s' || (tno % 3) || '.vw_T' || tno || ' AS SELECT ' || case when tno % 5 = 1 then 'a, ' else '' end || '* FROM T' || tno
         || case when tno % 10 <> 0 then ' JOIN s' || ((tno - 1) % 3) || '.VW_T' || (tno - 1) else '' end || ';',
       null, cast(tno * 4 as int) from f_base where tno % 7 <> 2
union all
select pair_id, 'target', 'function', 's' || (tno % 3), 'fn_T' || tno || '(integer, text)',
       'CREATE FUNCTION fn_T' || tno || '(a integer, b text) AS y', null, cast(tno * 4 + 1 as int) from f_base where tno % 6 = 0
union all
select pair_id, 'target', 'procedure', 's' || (tno % 3), 'p_old_T' || tno, 'CREATE PROC p_old_T' || tno || ' AS x', null,
       cast(tno * 4 + 2 as int) from f_base where tno % 13 = 5
union all
select pair_id, 'target', 'trigger', 's' || (tno % 3), 'trg_T' || tno, 'CREATE TRIGGER trg_T' || tno || ' ON T' || tno || ' AS y',
       's' || (tno % 3) || '.T' || tno, cast(tno * 4 + 3 as int) from f_base where tno % 8 = 0
""",
)
# The same fleet as PostgreSQL would report it.
recipe(
    "g_databases",
    "select pair_id, side, 'PostgreSQL' as provider, database from f_databases",
)
recipe(
    "g_columns",
    """
select pair_id, side, sch, tbl, name, ordinal,
       replace(replace(replace(replace(data_type, 'decimal', 'numeric'), 'nvarchar', 'character varying'), 'datetime2(7)', 'timestamp without time zone'), 'int', 'integer') as data_type,
       is_nullable, default_expr, cast(null as varchar(10)) as default_constraint,
       case when identity_clause is not null then case when ordinal = 1 and side = 'source' and is_persisted = false and length(tbl) % 2 = 0
            then 'GENERATED ALWAYS AS IDENTITY' else 'GENERATED BY DEFAULT AS IDENTITY' end end as identity_clause,
       computed_expr, computed_expr is not null as is_persisted, coll
from f_columns
""",
)
recipe(
    "g_indexes",
    """
select pair_id, side, sch, tbl, name, is_unique, false as is_clustered, c1, d1, c2, d2, i1, i2, cast(null as varchar(10)) as filter_expr,
       case when is_clustered then null else 'CREATE ' || case when is_unique then 'UNIQUE ' else '' end || 'INDEX ' || lower(name) || ' ON ' || sch || '.' || upper(tbl)
         || ' USING btree (' || c1 || ')' end as raw_definition
from f_indexes
""",
)


def _pair(first, second):
    def element(position, name, desc):
        return F.when(
            F.col(name).isNotNull(),
            F.struct(F.lit(position).alias("ord"), F.col(name).alias("name"), F.col(desc).alias("is_desc")),
        )

    return F.array_compact(F.array(element(1, *first), element(2, *second))).alias("columns")


def fleet(spark, sf, postgres: bool = False) -> snapshot.Snapshot:
    return once(spark, ("fleet", sf, postgres), lambda: _fleet(spark, sf, postgres))


def _fleet(spark, sf, postgres: bool) -> snapshot.Snapshot:
    """The snapshot is landed once: a plan reads each of its frames several times, and a
    user's snapshot lies in files too."""

    def get(name):
        rows = once(spark, ("landed frame", sf, name), lambda: landed(load(spark, sf, name), name))
        return rows.withColumnRenamed("sch", "schema").withColumnRenamed("tbl", "table").withColumnRenamed("coll", "collation")

    # Lists come in reverse here: their order must come from `ord`.
    keys = get("f_keys").withColumn("columns", F.reverse(_pair(("c1", "d1"), ("c2", "d2"))))
    fks = get("f_fks").withColumn(
        "columns", F.array(F.struct(F.lit(1).alias("ord"), F.col("c1").alias("name"), F.col("rc1").alias("ref_name")))
    )
    fks = fks.withColumnRenamed("ref_sch", "ref_schema").withColumnRenamed("ref_tbl", "ref_table")
    indexes = get("g_indexes" if postgres else "f_indexes").withColumn("columns", _pair(("c1", "d1"), ("c2", "d2")))
    indexes = indexes.withColumn("included", F.array_compact(F.array("i1", "i2")))
    if not postgres:
        indexes = indexes.withColumn("raw_definition", F.lit(None).cast("string"))
    code = get("f_code").withColumnRenamed("parent", "parent_table")
    return snapshot.build(
        spark,
        databases=get("g_databases" if postgres else "f_databases"),
        schemas=get("f_schemas"),
        tables=get("f_tables"),
        columns=get("g_columns" if postgres else "f_columns"),
        keys=keys,
        fks=fks,
        indexes=indexes,
        checks=get("f_checks"),
        code_objects=code,
    )


# A catalog whose tables are the brands and types of `part`: few tables, very many columns.
recipe(
    "d_cols_s",
    """
select p_partkey as k, p_brand as sch, p_type as tbl, 'c' || p_partkey as name, cast(p_partkey as int) as ordinal,
       'decimal(' || (p_size + 1) || ',2)' as data_type, p_partkey % 2 = 0 as is_nullable, '((' || p_size || '))' as default_expr
from {part}
""",
)
recipe(
    "d_columns",
    """
select 'source' as side, sch, tbl, name, ordinal, data_type, is_nullable, default_expr from d_cols_s
union all
select 'target', sch, tbl, case when k % 3 = 0 then upper(name) else name end, ordinal,
       case when k % 13 = 0 then replace(data_type, ',2)', ',4)') else data_type end,
       case when k % 17 = 0 then not is_nullable else is_nullable end,
       case when k % 19 = 0 then '(getdate())' when k % 5 = 0 then replace(replace(default_expr, '(', ''), ')', '') else default_expr end
from d_cols_s where k % 23 <> 0
union all
select 'target', sch, tbl, 'x' || k, ordinal, data_type, is_nullable, default_expr from d_cols_s where k % 29 = 0
""",
)


def wide_catalog(spark, sf) -> snapshot.Snapshot:
    return once(spark, ("wide", sf), lambda: _wide_catalog(spark, sf))


def _wide_catalog(spark, sf) -> snapshot.Snapshot:
    rows = load(spark, sf, "d_columns").withColumnRenamed("sch", "schema").withColumnRenamed("tbl", "table")
    empty = F.lit(None).cast("string")
    columns = rows.select(
        F.lit(1).alias("pair_id"), "*", empty.alias("default_constraint"), empty.alias("identity_clause"),
        empty.alias("computed_expr"), F.lit(False).alias("is_persisted"), empty.alias("collation"),
    )
    tables = columns.select("pair_id", "side", "schema", "table").distinct()
    return snapshot.build(spark, columns=columns, tables=tables)
