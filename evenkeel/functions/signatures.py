"""Structural identity of keys, foreign keys, indexes and checks; names do not count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evenkeel.functions.text import normalize_expression


def column_list(columns: Column, separator: str = ",") -> Column:
    """Column names in order, with DESC where a column is descending."""
    named = F.transform(
        F.array_sort(columns), lambda c: F.concat(c["name"], F.when(c["is_desc"], " DESC").otherwise(""))
    )
    return F.array_join(named, separator)


def key_signature(is_primary: Column, is_clustered: Column, columns: Column) -> Column:
    kind = F.when(is_primary, "PK").otherwise("UQ")
    return F.concat(kind, F.when(is_clustered, ":C:").otherwise(":N:"), F.lower(column_list(columns)))


def fk_signature(columns: Column, ref_schema: Column, ref_table: Column, on_delete: Column, on_update: Column) -> Column:
    pairs = F.array_sort(columns)
    return F.lower(
        F.concat(
            F.array_join(F.transform(pairs, lambda c: c["name"]), ","),
            F.lit("->"), ref_schema, F.lit("."), ref_table, F.lit("("),
            F.array_join(F.transform(pairs, lambda c: c["ref_name"]), ","),
            F.lit(") D:"), on_delete, F.lit(" U:"), on_update,
        )
    )


def index_signature(
    is_unique: Column, is_clustered: Column, columns: Column, included: Column, filter_expr: Column, raw_definition: Column
) -> Column:
    """The full statement where the engine gives one, else the parts of the index."""
    by_name = F.transform(
        F.array_sort(F.transform(included, lambda c: F.struct(F.upper(c).alias("k"), c.alias("name")))),
        lambda c: c["name"],
    )
    parts = F.lower(
        F.concat(
            F.when(is_unique, "U").otherwise(""), F.when(is_clustered, "C").otherwise(""), F.lit(":"),
            column_list(columns), F.lit("|inc:"), F.array_join(by_name, ","),
            F.lit("|f:"), F.coalesce(filter_expr, F.lit("")),
        )
    )
    return F.when(raw_definition.isNotNull(), normalize_expression(raw_definition)).otherwise(parts)


def check_signature(expression: Column) -> Column:
    return normalize_expression(expression)
