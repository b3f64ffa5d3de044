"""Snapshot rows from landed SQL Server catalog tables.

A landed table has the columns of the catalog view of that name plus pair_id and side, so
one job assembles the snapshots of a whole fleet. Lists of key columns are gathered per
constraint; the engine allows 32 of them, and 1,023 included columns per index.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DB = ["pair_id", "side"]

# Names that are never user schemas.
_SYSTEM_SCHEMAS = ("sys", "INFORMATION_SCHEMA", "guest")


def list_schemas(schemas: DataFrame) -> DataFrame:
    user = (F.col("schema_id") < 16384) & ~F.col("name").isin(*_SYSTEM_SCHEMAS) & ~F.col("name").startswith("db_")
    return schemas.filter(user).select(*DB, F.col("name").alias("schema"))


def format_type(name: Column, max_length: Column, precision: Column, scale: Column) -> Column:
    """Type text with its length or precision; double-byte types count characters."""

    def sized(length: Column) -> Column:
        return F.concat(name, F.when(max_length == -1, "(MAX)").otherwise(F.concat(F.lit("("), length.cast("string"), F.lit(")"))))

    half = F.floor(max_length / 2)
    return (
        F.when(name.isin("nvarchar", "nchar"), sized(half))
        .when(name.isin("varchar", "char", "varbinary", "binary"), sized(max_length))
        .when(
            name.isin("decimal", "numeric"),
            F.concat(name, F.lit("("), precision.cast("string"), F.lit(","), scale.cast("string"), F.lit(")")),
        )
        .when(name.isin("datetime2", "datetimeoffset", "time"), F.concat(name, F.lit("("), scale.cast("string"), F.lit(")")))
        .otherwise(name)
    )


def user_tables(landed: Mapping[str, DataFrame]) -> DataFrame:
    """pair_id, side, object_id, schema, table of tables that do not ship with the server."""
    if "user_tables" in landed:  # landed once
        return landed["user_tables"]
    tables = landed["tables"].filter("not is_ms_shipped").select(*DB, "object_id", "schema_id", F.col("name").alias("table"))
    schemas = landed["schemas"].select(*DB, "schema_id", F.col("name").alias("schema"))
    return tables.join(schemas, DB + ["schema_id"]).drop("schema_id")


def _column_names(landed: Mapping[str, DataFrame], name: str) -> DataFrame:
    return landed["columns"].select(*DB, "object_id", "column_id", F.col("name").alias(name))


def columns(landed: Mapping[str, DataFrame]) -> DataFrame:
    """Column rows. A collation is kept only where it is not that of the database."""
    place = DB + ["object_id", "column_id"]
    types = landed["types"].select(*DB, "user_type_id", F.col("name").alias("type_name"))
    identity = landed["identity_columns"].select(*place, "seed_value", "increment_value")
    defaults = landed["default_constraints"].select(
        *DB,
        F.col("parent_object_id").alias("object_id"),
        F.col("parent_column_id").alias("column_id"),
        F.col("name").alias("default_constraint"),
        F.col("definition").alias("default_expr"),
    )
    computed = landed["computed_columns"].select(*place, F.col("definition").alias("computed_expr"), "is_persisted")
    usual = landed["databases"].select(*DB, F.col("collation_name").alias("db_collation"), F.col("is_current")).filter("is_current")
    rows = (
        landed["columns"]
        .join(user_tables(landed), DB + ["object_id"])
        .join(types, DB + ["user_type_id"])
        .join(identity, place, "left")
        .join(defaults, place, "left")
        .join(computed, place, "left")
        .join(usual, DB, "left")
    )
    own = F.upper("collation_name") != F.upper(F.coalesce("db_collation", F.lit("")))
    clause = F.concat(
        F.lit("IDENTITY("), F.col("seed_value").cast("string"), F.lit(","), F.col("increment_value").cast("string"), F.lit(")")
    )
    return rows.select(
        *DB, "schema", "table", "name", F.col("column_id").alias("ordinal"),
        format_type(*map(F.col, ("type_name", "max_length", "precision", "scale"))).alias("data_type"),
        "is_nullable", "default_expr", "default_constraint",
        F.when(F.col("seed_value").isNotNull(), clause).alias("identity_clause"),
        "computed_expr", F.coalesce("is_persisted", F.lit(False)).alias("is_persisted"),
        F.when(own, F.col("collation_name")).alias("collation"),
    )


def _index_members(landed: Mapping[str, DataFrame]) -> DataFrame:
    members = landed["index_columns"].select(
        *DB, "object_id", "index_id", "column_id", "key_ordinal", "is_descending_key", "is_included_column", "index_column_id"
    )
    return members.join(_column_names(landed, "column_name"), DB + ["object_id", "column_id"])


def _ordered(ord_: str, present: Column | None = None) -> Column:
    item = F.struct(
        F.col(ord_).cast("int").alias("ord"), F.col("column_name").alias("name"), F.col("is_descending_key").alias("is_desc")
    )
    return F.array_sort(F.collect_list(item if present is None else F.when(present, item)))


def keys(landed: Mapping[str, DataFrame]) -> DataFrame:
    """Primary keys and unique constraints with their columns in key order."""
    constraints = landed["key_constraints"].select(
        *DB, F.col("parent_object_id").alias("object_id"), F.col("unique_index_id").alias("index_id"), "name", F.trim("type").alias("type")
    )
    indexes = landed["indexes"].select(*DB, "object_id", "index_id", "type_desc")
    members = _index_members(landed).filter("not is_included_column")
    rows = constraints.join(user_tables(landed), DB + ["object_id"]).join(indexes, DB + ["object_id", "index_id"])
    rows = rows.join(members, DB + ["object_id", "index_id"])
    grouped = rows.groupBy(*DB, "schema", "table", "name", "type", "type_desc").agg(_ordered("key_ordinal").alias("columns"))
    return grouped.select(
        *DB, "schema", "table", "name", (F.col("type") == "PK").alias("is_primary"),
        (F.col("type_desc") == "CLUSTERED").alias("is_clustered"), "columns",
    )


def indexes(landed: Mapping[str, DataFrame]) -> DataFrame:
    """Indexes that no constraint owns, with key columns and included columns apart."""
    own = landed["indexes"].filter(
        "not is_primary_key and not is_unique_constraint and type > 0 and not is_hypothetical"
    ).select(*DB, "object_id", "index_id", "name", "is_unique", "type_desc", F.col("filter_definition").alias("filter_expr"))
    rows = own.join(user_tables(landed), DB + ["object_id"]).join(_index_members(landed), DB + ["object_id", "index_id"])
    included = F.col("is_included_column")
    grouped = rows.groupBy(*DB, "schema", "table", "name", "is_unique", "type_desc", "filter_expr").agg(
        _ordered("key_ordinal", ~included).alias("columns"),
        F.transform(_ordered("index_column_id", included), lambda c: c["name"]).alias("included"),
    )
    return grouped.select(
        *DB, "schema", "table", "name", "is_unique", (F.col("type_desc") == "CLUSTERED").alias("is_clustered"),
        "columns", "included", "filter_expr", F.lit(None).cast("string").alias("raw_definition"),
    )


def foreign_keys(landed: Mapping[str, DataFrame]) -> DataFrame:
    """Foreign keys with their column pairs in order."""
    fks = landed["foreign_keys"].select(
        *DB, F.col("object_id").alias("fk_id"), "name", F.col("parent_object_id").alias("object_id"), "referenced_object_id",
        F.translate("delete_referential_action_desc", "_", " ").alias("on_delete"),
        F.translate("update_referential_action_desc", "_", " ").alias("on_update"),
    )
    pairs = landed["foreign_key_columns"].select(
        *DB, F.col("constraint_object_id").alias("fk_id"), "constraint_column_id", "parent_column_id", "referenced_column_id"
    )
    own = _column_names(landed, "column_name").withColumnRenamed("column_id", "parent_column_id")
    other = landed["columns"].select(
        *DB, F.col("object_id").alias("referenced_object_id"), F.col("column_id").alias("referenced_column_id"), F.col("name").alias("ref_name")
    )
    # The referenced table may be one the server ships.
    ref = landed["tables"].select(*DB, F.col("object_id").alias("referenced_object_id"), F.col("name").alias("ref_table"), F.col("schema_id").alias("ref_schema_id"))
    ref_schema = landed["schemas"].select(*DB, F.col("schema_id").alias("ref_schema_id"), F.col("name").alias("ref_schema"))
    rows = (
        fks.join(user_tables(landed), DB + ["object_id"])
        .join(pairs, DB + ["fk_id"])
        .join(own, DB + ["object_id", "parent_column_id"])
        .join(other, DB + ["referenced_object_id", "referenced_column_id"])
        .join(ref, DB + ["referenced_object_id"])
        .join(ref_schema, DB + ["ref_schema_id"])
    )
    item = F.struct(F.col("constraint_column_id").cast("int").alias("ord"), F.col("column_name").alias("name"), "ref_name")
    named = ["schema", "table", "name", "ref_schema", "ref_table", "on_delete", "on_update"]
    return rows.groupBy(*DB, *named).agg(F.array_sort(F.collect_list(item)).alias("columns"))


def checks(landed: Mapping[str, DataFrame]) -> DataFrame:
    rows = landed["check_constraints"].select(
        *DB, F.col("parent_object_id").alias("object_id"), "name", F.col("definition").alias("expression")
    )
    return rows.join(user_tables(landed), DB + ["object_id"]).select(*DB, "schema", "table", "name", "expression")


def code_objects(landed: Mapping[str, DataFrame]) -> DataFrame:
    """Views, procedures, functions of all kinds and table triggers that have a text."""
    kinds = F.trim("type")
    objects = landed["objects"].filter("not is_ms_shipped").select(
        *DB, "object_id", "schema_id", "name", kinds.alias("type"), "parent_object_id"
    ).filter(F.col("type").isin("V", "P", "FN", "IF", "TF", "TR"))
    modules = landed["sql_modules"].filter("definition is not null").select(*DB, "object_id", "definition")
    schemas = landed["schemas"].select(*DB, "schema_id", F.col("name").alias("schema"))
    parents = landed["tables"].select(*DB, F.col("object_id").alias("parent_object_id"), F.col("name").alias("pt"), F.col("schema_id").alias("ps_id"))
    parent_schemas = landed["schemas"].select(*DB, F.col("schema_id").alias("ps_id"), F.col("name").alias("ps"))
    rows = (
        modules.join(objects, DB + ["object_id"])
        .join(schemas, DB + ["schema_id"])
        .join(parents, DB + ["parent_object_id"], "left")
        .join(parent_schemas, DB + ["ps_id"], "left")
        .filter("type <> 'TR' or pt is not null")
    )
    kind = F.when(F.col("type") == "V", "view").when(F.col("type") == "P", "procedure").when(F.col("type") == "TR", "trigger").otherwise("function")
    return rows.select(
        *DB, kind.alias("kind"), "schema", "name", "definition", F.concat("ps", F.lit("."), "pt").alias("parent_table"),
        F.col("object_id").alias("input_ord"),
    )
