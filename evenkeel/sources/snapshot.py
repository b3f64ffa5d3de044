"""Schema snapshots as DataFrames: many pairs of databases, both sides, in one set.

Every row carries `pair_id` and `side` ('source' or 'target').
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WHERE = "pair_id bigint, side string, "
_OF_TABLE = _WHERE + "schema string, table string, "

SCHEMAS = {
    "databases": _WHERE + "provider string, database string",
    "schemas": _WHERE + "schema string",
    "tables": _WHERE + "schema string, table string",
    "columns": _OF_TABLE
    + "name string, ordinal int, data_type string, is_nullable boolean, default_expr string, "
    + "default_constraint string, identity_clause string, computed_expr string, is_persisted boolean, collation string",
    "keys": _OF_TABLE
    + "name string, is_primary boolean, is_clustered boolean, columns array<struct<ord:int,name:string,is_desc:boolean>>",
    "fks": _OF_TABLE
    + "name string, columns array<struct<ord:int,name:string,ref_name:string>>, ref_schema string, ref_table string, "
    + "on_delete string, on_update string",
    "indexes": _OF_TABLE
    + "name string, is_unique boolean, is_clustered boolean, columns array<struct<ord:int,name:string,is_desc:boolean>>, "
    + "included array<string>, filter_expr string, raw_definition string",
    "checks": _OF_TABLE + "name string, expression string",
    "code_objects": _WHERE
    + "kind string, schema string, name string, definition string, parent_table string, input_ord int",
}


@dataclass(frozen=True)
class Snapshot:
    databases: DataFrame
    schemas: DataFrame
    tables: DataFrame
    columns: DataFrame
    keys: DataFrame
    fks: DataFrame
    indexes: DataFrame
    checks: DataFrame
    code_objects: DataFrame

    def scope(self, schema: str) -> "Snapshot":
        """Only the objects of one schema. Databases are kept."""
        narrowed = {
            f.name: getattr(self, f.name).filter(F.col("schema") == schema)
            for f in fields(self)
            if f.name != "databases"
        }
        return replace(self, **narrowed)


def build(spark: SparkSession, **frames: DataFrame) -> Snapshot:
    """A snapshot from the frames given; the others are empty. Columns are put in order."""
    out = {}
    for name, ddl in SCHEMAS.items():
        schema = T.StructType.fromDDL(ddl)
        if name in frames:
            out[name] = frames[name].select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
        else:
            out[name] = spark.createDataFrame([], schema)
    return Snapshot(**out)


def columns_of(
    df: DataFrame, pair_id: int, side: str, schema: str, table: str, identity: dict[str, str] | None = None
) -> DataFrame:
    """Column rows of a real table, read from its schema; no data is scanned."""
    rows = [
        (
            pair_id, side, schema, table, f.name, i + 1, f.dataType.simpleString(), f.nullable,
            None, None, (identity or {}).get(f.name), None, False, None,
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, SCHEMAS["columns"])
