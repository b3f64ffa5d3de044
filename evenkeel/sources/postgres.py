"""Snapshot rows from landed PostgreSQL catalog tables.

A landed table has the columns of the catalog plus pair_id and side. What only server
functions can say is landed as text next to the row it belongs to: data_type of an
attribute, expr of a default, condef of a constraint, indexdef of an index, viewdef of a
class, identity_args and def of a routine, def of a trigger.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.dialect import POSTGRESQL, fill
from evenkeel.functions.text import WHITESPACE

DB = ["pair_id", "side"]

# The words for referential action codes.
_ACTIONS = {"c": "CASCADE", "n": "SET NULL", "d": "SET DEFAULT", "r": "RESTRICT"}
_SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")


def list_schemas(landed: Mapping[str, DataFrame], scope: str | None = None) -> DataFrame:
    """One schema if a scope is given, else all user schemas: pair_id, side, nsp_oid, schema."""
    name = F.col("nspname")
    wanted = name == scope if scope else ~name.isin(*_SYSTEM_SCHEMAS) & ~name.startswith("pg_")
    return landed["pg_namespace"].filter(wanted).select(*DB, F.col("oid").alias("nsp_oid"), name.alias("schema"))


def relations(landed: Mapping[str, DataFrame], scope: str | None = None) -> DataFrame:
    """Tables, views and the like with their schema's name: what every other reader refers to by object id."""
    rows = landed["pg_class"].filter("relkind not in ('i', 'I')")
    rows = rows.select(*DB, F.col("oid").alias("rel_oid"), "relkind", F.col("relname").alias("table"), F.col("relnamespace").alias("nsp_oid"), "viewdef")
    return rows.join(list_schemas(landed, scope), DB + ["nsp_oid"]).drop("nsp_oid")


def _relations(landed: Mapping[str, DataFrame], kind: str | None, scope: str | None) -> DataFrame:
    if "relations" in landed:  # landed once, in scope already
        known = landed["relations"]
        return (known if kind is None else known.filter(F.col("relkind") == kind)).select(*DB, "rel_oid", "table", "schema")
    rows = landed["pg_class"] if kind is None else landed["pg_class"].filter(F.col("relkind") == kind)
    rows = rows.select(*DB, F.col("oid").alias("rel_oid"), F.col("relname").alias("table"), F.col("relnamespace").alias("nsp_oid"))
    return rows.join(list_schemas(landed, scope), DB + ["nsp_oid"]).drop("nsp_oid")


def columns(landed: Mapping[str, DataFrame], scope: str | None = None) -> DataFrame:
    """Column rows. A stored generated column has its default as computed expression."""
    attributes = landed["pg_attribute"].filter("attnum > 0 and not attisdropped").withColumnRenamed("attrelid", "rel_oid")
    types = landed["pg_type"].select(*DB, F.col("oid").alias("atttypid"), "typcollation")
    defaults = landed["pg_attrdef"].select(*DB, F.col("adrelid").alias("rel_oid"), F.col("adnum").alias("attnum"), "expr")
    collations = landed["pg_collation"].select(*DB, F.col("oid").alias("attcollation"), "collname")
    rows = (
        attributes.join(_relations(landed, "r", scope), DB + ["rel_oid"])
        .join(types, DB + ["atttypid"])
        .join(defaults, DB + ["rel_oid", "attnum"], "left")
        .join(collations, DB + ["attcollation"], "left")
    )
    generated = F.coalesce(F.col("attgenerated") == "s", F.lit(False))
    own = (F.col("attcollation") != 0) & (F.col("attcollation") != F.col("typcollation"))
    return rows.select(
        *DB, "schema", "table", F.col("attname").alias("name"), F.col("attnum").cast("int").alias("ordinal"), "data_type",
        (~F.col("attnotnull")).alias("is_nullable"), F.when(~generated, F.col("expr")).alias("default_expr"),
        F.lit(None).cast("string").alias("default_constraint"),
        F.when(F.col("attidentity") == "a", "GENERATED ALWAYS AS IDENTITY")
        .when(F.col("attidentity") == "d", "GENERATED BY DEFAULT AS IDENTITY")
        .alias("identity_clause"),
        F.when(generated, F.col("expr")).alias("computed_expr"), generated.alias("is_persisted"),
        F.when(own, F.col("collname")).alias("collation"),
    )


def constraints(landed: Mapping[str, DataFrame], scope: str | None = None) -> DataFrame:
    """Primary, unique, foreign key and check constraints in one shape, with `contype` as given."""
    con = landed["pg_constraint"].filter(F.col("contype").isin("p", "u", "f", "c"))
    ident = DB + ["con_oid"]
    con = con.withColumnRenamed("oid", "con_oid")

    def names(key: str, rel: str, out: str) -> DataFrame:
        """Column names of a list of attribute numbers, in list order."""
        flat = con.select(*ident, F.col(rel).alias("attrelid"), F.posexplode(key).alias("ord", "attnum"))
        attributes = landed["pg_attribute"].select(*DB, "attrelid", "attnum", "attname")
        found = flat.join(attributes, DB + ["attrelid", "attnum"])
        # The engine allows 32 columns per key.
        return found.groupBy(*ident).agg(F.array_sort(F.collect_list(F.struct((F.col("ord") + 1).alias("ord"), F.col("attname").alias("name")))).alias(out))

    own = names("conkey", "conrelid", "own_columns")
    other = names("confkey", "confrelid", "ref_columns")
    ref = landed["pg_class"].select(*DB, F.col("oid").alias("confrelid"), F.col("relname").alias("ref_table"), F.col("relnamespace").alias("ref_nsp"))
    ref_nsp = landed["pg_namespace"].select(*DB, F.col("oid").alias("ref_nsp"), F.col("nspname").alias("ref_schema"))
    rows = (
        con.withColumnRenamed("conrelid", "rel_oid")
        .join(_relations(landed, None, scope), DB + ["rel_oid"])
        .join(own, ident, "left")
        .join(other, ident, "left")
        .join(ref, DB + ["confrelid"], "left")
        .join(ref_nsp, DB + ["ref_nsp"], "left")
    )

    def action(code: str) -> Column:
        word = F.lit("NO ACTION")
        for letter, text in _ACTIONS.items():
            word = F.when(F.col(code) == letter, text).otherwise(word)
        return word

    stripped = F.trim(F.substring(F.col("condef"), F.lit(7), F.length("condef")), F.lit(WHITESPACE))
    return rows.select(
        *DB, "schema", "table", F.col("conname").alias("name"), "contype", "own_columns", "ref_columns", "ref_schema", "ref_table",
        action("confdeltype").alias("on_delete"), action("confupdtype").alias("on_update"),
        F.when(F.upper(F.substring("condef", 1, 6)) == "CHECK ", stripped).otherwise(F.col("condef")).alias("expression"),
    )


def keys(found: DataFrame) -> DataFrame:
    """Key rows of the result of `constraints`."""
    columns_ = F.transform("own_columns", lambda c: F.struct(c["ord"].alias("ord"), c["name"].alias("name"), F.lit(False).alias("is_desc")))
    return found.filter("contype in ('p', 'u')").select(
        *DB, "schema", "table", "name", (F.col("contype") == "p").alias("is_primary"), F.lit(False).alias("is_clustered"), columns_.alias("columns")
    )


def foreign_keys(found: DataFrame) -> DataFrame:
    pairs = F.zip_with(
        "own_columns", "ref_columns", lambda a, b: F.struct(a["ord"].alias("ord"), a["name"].alias("name"), b["name"].alias("ref_name"))
    )
    return found.filter("contype = 'f'").select(
        *DB, "schema", "table", "name", pairs.alias("columns"), "ref_schema", "ref_table", "on_delete", "on_update"
    )


def checks(found: DataFrame) -> DataFrame:
    return found.filter("contype = 'c'").select(*DB, "schema", "table", "name", "expression")


def indexes(landed: Mapping[str, DataFrame], scope: str | None = None) -> DataFrame:
    """Indexes that neither are a primary key nor belong to a constraint."""
    own = landed["pg_index"].filter("not indisprimary").withColumnRenamed("indrelid", "rel_oid")
    owned = landed["pg_constraint"].select(*DB, F.col("conindid").alias("indexrelid"))
    names = landed["pg_class"].select(*DB, F.col("oid").alias("indexrelid"), F.col("relname").alias("name"))
    rows = own.join(owned, DB + ["indexrelid"], "left_anti").join(names, DB + ["indexrelid"])
    rows = rows.join(_relations(landed, "r", scope), DB + ["rel_oid"])
    return rows.select(
        *DB, "schema", "table", "name", F.col("indisunique").alias("is_unique"), F.lit(False).alias("is_clustered"),
        F.array().cast("array<struct<ord:int,name:string,is_desc:boolean>>").alias("columns"),
        F.array().cast("array<string>").alias("included"), F.lit(None).cast("string").alias("filter_expr"),
        F.col("indexdef").alias("raw_definition"),
    )


def views(landed: Mapping[str, DataFrame], scope: str | None = None) -> DataFrame:
    """Views with the full statement around the body the catalog gives."""
    if "relations" in landed:
        rows = landed["relations"].filter("relkind = 'v'")
    else:
        bodies = landed["pg_class"].filter("relkind = 'v'").select(*DB, F.col("oid").alias("rel_oid"), "viewdef")
        rows = _relations(landed, "v", scope).join(bodies, DB + ["rel_oid"])
    body = F.rtrim(F.rtrim("viewdef", F.lit(WHITESPACE)), F.lit(";"))
    text = fill("CREATE OR REPLACE VIEW {n} AS\n{b};", n=POSTGRESQL.qualify(F.col("schema"), F.col("table")), b=body)
    return rows.select(*DB, F.lit("view").alias("kind"), "schema", F.col("table").alias("name"), text.alias("definition"), F.lit(None).cast("string").alias("parent_table"))


def routines(landed: Mapping[str, DataFrame], scope: str | None = None, keep_id: bool = False) -> DataFrame:
    """Functions and procedures no extension owns; overloads differ by their arguments. `keep_id` adds `object_id`."""
    owned = landed["pg_depend"].filter("deptype = 'e'").select(*DB, F.col("objid").alias("oid"))
    rows = landed["pg_proc"].filter("prokind in ('f', 'p')").join(owned, DB + ["oid"], "left_anti")
    rows = rows.withColumnRenamed("pronamespace", "nsp_oid").join(list_schemas(landed, scope), DB + ["nsp_oid"])
    name = F.concat("proname", F.lit("("), F.coalesce("identity_args", F.lit("")), F.lit(")"))
    return rows.select(
        *DB, F.when(F.col("prokind") == "p", "procedure").otherwise("function").alias("kind"), "schema", name.alias("name"),
        F.col("def").alias("definition"), F.lit(None).cast("string").alias("parent_table"),
        *[F.col("oid").alias("object_id")] * keep_id,
    )


def triggers(landed: Mapping[str, DataFrame], scope: str | None = None, keep_id: bool = False) -> DataFrame:
    rows = landed["pg_trigger"].filter("not tgisinternal").withColumnRenamed("tgrelid", "rel_oid")
    rows = rows.join(_relations(landed, None, scope), DB + ["rel_oid"])
    return rows.select(
        *DB, F.lit("trigger").alias("kind"), "schema", F.col("tgname").alias("name"), F.col("def").alias("definition"),
        F.concat("schema", F.lit("."), "table").alias("parent_table"), *[F.col("oid").alias("object_id")] * keep_id,
    )
