"""One snapshot from the landed catalogs of a whole fleet.

Every reader refers to tables by object id. The ids are resolved to names once: that table is written to
the shared folder and all readers join it, so that each landed catalog is scanned by the readers of its
own rows only. A PostgreSQL scope narrows the namespaces before anything joins them, so that it reaches
the dimension and through it every reader.

Code objects keep the order in which the server made them: `input_ord` is the rank of the object id within
(pair, side), as ids can exceed an int.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.plans.lineage import cut
from evenkeel.sources import mssql, postgres
from evenkeel.sources.snapshot import Snapshot, build

DB = ["pair_id", "side"]


def _spark(landed: Mapping[str, DataFrame], name: str):
    return landed[name].sparkSession


def _ranked(code: DataFrame) -> DataFrame:
    """`input_ord` from the server's ids: the objects of one database are counted, which a server bounds."""
    order = Window.partitionBy(*DB).orderBy("object_id", "kind", "schema", "name")
    return code.withColumn("input_ord", F.row_number().over(order).cast("int")).drop("object_id")


def from_mssql(landed: Mapping[str, DataFrame]) -> Snapshot:
    """The snapshot of landed SQL Server catalogs (see `mssql`). Tables that ship with the server stay out."""
    known = {name: landed[name] for name in _MSSQL}
    known["user_tables"] = cut(mssql.user_tables(known))
    current = known["databases"].filter("is_current")
    code = mssql.code_objects(known).withColumn("object_id", F.col("input_ord").cast("long")).drop("input_ord")
    return build(
        _spark(landed, "tables"),
        databases=current.select(*DB, F.lit("SQL Server").alias("provider"), F.col("name").alias("database")),
        schemas=mssql.list_schemas(known["schemas"]),
        tables=known["user_tables"].select(*DB, "schema", "table"),
        columns=mssql.columns(known),
        keys=mssql.keys(known),
        fks=mssql.foreign_keys(known),
        indexes=mssql.indexes(known),
        checks=mssql.checks(known),
        code_objects=_ranked(code),
    )


def from_postgres(landed: Mapping[str, DataFrame], databases: DataFrame, scope: str | None = None) -> Snapshot:
    """The snapshot of landed PostgreSQL catalogs (see `postgres`), of one schema if a scope is given.

    `databases` has pair_id, side and database: a catalog does not say which one it is of."""
    known = {name: landed[name] for name in _POSTGRES}
    known["relations"] = cut(postgres.relations(known, scope))
    found = cut(postgres.constraints(known, scope))
    views = postgres.views(known, scope)
    ids = known["relations"].filter("relkind = 'v'").select(*DB, "schema", F.col("table").alias("name"), F.col("rel_oid").alias("object_id"))
    views = views.join(ids, DB + ["schema", "name"])
    # Routines and triggers carry their id out of the reader as a part of the row.
    routines = postgres.routines(known, scope, keep_id=True)
    triggers = postgres.triggers(known, scope, keep_id=True)
    code = views.unionByName(routines).unionByName(triggers)
    return build(
        databases.sparkSession,
        databases=databases.select(*DB, F.lit("PostgreSQL").alias("provider"), "database"),
        schemas=postgres.list_schemas(known, scope).select(*DB, "schema"),
        tables=known["relations"].filter("relkind = 'r'").select(*DB, "schema", "table"),
        columns=postgres.columns(known, scope),
        keys=postgres.keys(found),
        fks=postgres.foreign_keys(found),
        indexes=postgres.indexes(known, scope),
        checks=postgres.checks(found),
        code_objects=_ranked(code),
    )


_MSSQL = (
    "schemas databases tables columns types identity_columns default_constraints computed_columns key_constraints indexes "
    "index_columns foreign_keys foreign_key_columns check_constraints objects sql_modules"
).split()
_POSTGRES = "pg_namespace pg_class pg_attribute pg_type pg_attrdef pg_collation pg_constraint pg_index pg_proc pg_depend pg_trigger".split()
