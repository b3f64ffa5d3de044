"""Compare views, routines and triggers by name and normalised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.text import normalize_module
from evenkeel.options import CompareOptions

# The order of object types in a result.
TYPE_ORDER = {"Table": 0, "View": 1, "Procedure": 2, "Function": 3, "Trigger": 4}


def type_order(kind: Column) -> Column:
    out = F.lit(len(TYPE_ORDER))
    for name, position in TYPE_ORDER.items():
        out = F.when(kind == name, position).otherwise(out)
    return out


def code_key(kind: Column, schema: Column, name: Column, options: CompareOptions) -> Column:
    """Kind, schema and name; the parent table of a trigger is not part of it."""
    return options.fold(F.concat(kind, F.lit(":"), schema, F.lit("."), name))


def compare_code(objects: DataFrame, options: CompareOptions = CompareOptions()) -> DataFrame:
    """One row per object: pair_id, type, schema, name, status. `objects` holds both sides."""
    keyed = objects.select(
        "pair_id",
        "side",
        code_key(F.col("kind"), F.col("schema"), F.col("name"), options).alias("_key"),
        F.initcap("kind").alias("type"),
        "schema",
        "name",
        normalize_module(F.col("definition"), options.ignore_whitespace_in_modules).alias("_text"),
    )
    source = keyed.filter("side = 'source'").drop("side").alias("l")
    target = keyed.filter("side = 'target'").drop("side").alias("r")
    joined = source.join(target, ["pair_id", "_key"], "full_outer")
    status = (
        F.when(F.col("r._text").isNull(), "SourceOnly")
        .when(F.col("l._text").isNull(), "TargetOnly")
        .when(F.col("l._text") != F.col("r._text"), "Different")
        .otherwise("Equal")
    )
    both = [F.coalesce(F.col(f"l.{c}"), F.col(f"r.{c}")).alias(c) for c in ("type", "schema", "name")]
    return joined.select("pair_id", *both, status.alias("status"))
