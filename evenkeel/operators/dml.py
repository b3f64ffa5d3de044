"""INSERT, UPDATE and DELETE statements for the changes between two tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.dialect import Dialect
from evenkeel.operators.rowdiff import RowDiff

# The order of operations within the script of one table.
_HEADER, _DELETE, _UPDATE, _BEFORE, _INSERT, _AFTER = range(6)


@dataclass(frozen=True)
class TableRef:
    schema: str
    name: str
    # Identity clauses by column, such as IDENTITY(1,1) or GENERATED ALWAYS AS IDENTITY.
    identity: dict[str, str] | None = None
    # Default expressions by column; a sequence default asks for the same note.
    defaults: dict[str, str] | None = None

    @property
    def full_name(self) -> str:
        return f"{self.schema}.{self.name}"


def _quoted(table: TableRef, dialect: Dialect) -> str:
    return f"{dialect.quote_text(table.schema)}.{dialect.quote_text(table.name)}"


def _where(diff: RowDiff, dialect: Dialect) -> Column:
    def one(k: str) -> Column:
        name, value = dialect.quote_text(k), F.col(f"`{k}`")
        equal = F.concat(F.lit(name + " = "), dialect.literal(value, diff.types[k]))
        return F.when(value.isNull(), F.lit(name + " IS NULL")).otherwise(equal) if diff.options.null_safe_keys else equal

    return F.concat_ws(" AND ", *[one(k) for k in diff.keys])


def _unstorable(diff: RowDiff, dialect: Dialect) -> Column:
    """The names of the columns whose value in the source the target's engine can't store."""
    names = []
    for c in diff.values:
        lacks = dialect.lacks_literal(F.col("s")[c], diff.types[c])
        if lacks is not None:
            names.append(F.when((F.col("status") == "missing") & lacks, F.lit(c)))
            names.append(F.when((F.col("status") == "different") & F.array_contains("changed", c) & lacks, F.lit(c)))
    return F.concat_ws(", ", *names) if names else F.lit("")


def insert_text(diff: RowDiff, table: TableRef, dialect: Dialect) -> Column:
    columns = list(diff.keys) + list(diff.values)
    always = any("ALWAYS" in clause.upper() for clause in (table.identity or {}).values())
    head = (
        f"INSERT INTO {_quoted(table, dialect)} ({', '.join(map(dialect.quote_text, columns))}) "
        f"{dialect.insert_prefix(always)}VALUES ("
    )
    values = [dialect.literal(F.col(f"`{k}`"), diff.types[k]) for k in diff.keys]
    values += [dialect.literal(F.col("s")[c], diff.types[c]) for c in diff.values]
    return F.concat(F.lit(head), F.concat_ws(", ", *values), F.lit(");"))


def update_text(diff: RowDiff, table: TableRef, dialect: Dialect) -> Column:
    """Sets the changed columns only, to the values of the source."""
    assignments = [
        F.when(
            F.array_contains("changed", c),
            F.concat(F.lit(dialect.quote_text(c) + " = "), dialect.literal(F.col("s")[c], diff.types[c])),
        )
        for c in diff.values
    ]
    return F.concat(
        F.lit(f"UPDATE {_quoted(table, dialect)} SET "),
        F.concat_ws(", ", *assignments),
        F.lit(" WHERE "),
        _where(diff, dialect),
        F.lit(";"),
    )


def delete_text(diff: RowDiff, table: TableRef, dialect: Dialect) -> Column:
    return F.concat(F.lit(f"DELETE FROM {_quoted(table, dialect)} WHERE "), _where(diff, dialect), F.lit(";"))


def statements(diff: RowDiff, table: TableRef, dialect: Dialect) -> DataFrame:
    """One statement per change: op_ord, op, keys, statement. Unordered."""
    status = F.col("status")
    wanted = ["missing", "different"] + (["extra"] if diff.options.include_deletes else [])
    statement = (
        F.when(status == "missing", insert_text(diff, table, dialect))
        .when(status == "different", update_text(diff, table, dialect) if diff.values else F.lit(None))
        .otherwise(delete_text(diff, table, dialect))
    )
    unstorable = _unstorable(diff, dialect)
    warning = F.concat(
        F.lit(f"-- WARNING: {table.full_name}: {dialect.name} has no value for "), unstorable, F.lit(" of the row with "), _where(diff, dialect)
    )
    statement = F.when(unstorable != "", warning).otherwise(statement)
    return diff.df.filter(status.isin(*wanted)).select(
        F.when(status == "extra", _DELETE).when(status == "different", _UPDATE).otherwise(_INSERT).alias("op_ord"),
        F.when(status == "extra", "delete").when(status == "different", "update").otherwise("insert").alias("op"),
        *diff.key_columns,
        statement.alias("statement"),
    )


def samples(diff: RowDiff, table: TableRef, dialect: Dialect) -> DataFrame:
    """The first statements in key order, whatever the operation. NULL keys come first."""
    rows = statements(diff, table, dialect)
    return rows.orderBy(*diff.key_columns).limit(diff.options.max_sample_rows).select(*diff.key_columns, "op", "statement")


def table_script(diff: RowDiff, table: TableRef, dialect: Dialect, table_ord: int = 0) -> DataFrame:
    """Lines of the script of one table: deletes, updates, inserts, with what must stand
    around them. A table without changes has no lines. Sort with `script_order`."""
    rows = statements(diff, table, dialect)
    quoted = _quoted(table, dialect)
    has_identity = bool(table.identity)
    sequence_default = any("nextval" in d.lower() for d in (table.defaults or {}).values())
    before = dialect.before_inserts(quoted, has_identity)
    after = dialect.after_inserts(quoted, table.full_name, has_identity or (sequence_default and dialect.name == "PostgreSQL"))
    body = rows.select(
        F.lit(table_ord).alias("table_ord"), F.col("op_ord").alias("line_ord"), *diff.key_columns, "statement"
    )
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("op") == "insert").alias("inserts"))
    frame = [
        F.struct(F.lit(_HEADER).alias("line_ord"), F.lit(f"-- ==== Data changes for {table.full_name} ====").alias("statement"),
                 (F.col("n") > 0).alias("shown"))
    ]
    if before:
        frame.append(F.struct(F.lit(_BEFORE).alias("line_ord"), F.lit(before).alias("statement"), (F.col("inserts") > 0).alias("shown")))
    if after:
        frame.append(F.struct(F.lit(_AFTER).alias("line_ord"), F.lit(after).alias("statement"), (F.col("inserts") > 0).alias("shown")))
    around = counts.select(F.explode(F.array(*frame)).alias("line")).filter("line.shown")
    around = around.select(
        F.lit(table_ord).alias("table_ord"),
        F.col("line.line_ord").alias("line_ord"),
        *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in diff.key_columns],
        F.col("line.statement").alias("statement"),
    )
    return body.unionByName(around)


def script_order(diff: RowDiff) -> list[str]:
    return ["table_ord", "line_ord", *diff.key_columns]


def _sort_keys(df: DataFrame, keys: list[str], width: int) -> list[Column]:
    """Keys of any type as pairs of a number and a text, so that tables can be stacked."""
    out: list[Column] = []
    for i in range(width):
        numeric = i < len(keys) and isinstance(df.schema[keys[i]].dataType, (T.IntegralType, T.DecimalType))
        value = F.col(f"`{keys[i]}`") if i < len(keys) else F.lit(None)
        out.append((value if numeric else F.lit(None)).cast("decimal(38,10)").alias(f"num_{i + 1}"))
        out.append((F.lit(None) if numeric else value).cast("string").alias(f"text_{i + 1}"))
    return out


def data_script(scripts: list[DataFrame], dialect: Dialect) -> DataFrame:
    """The scripts of several tables inside one transaction. Sorting by all columns but
    `statement`, in column order, gives the script."""
    fixed = ["table_ord", "line_ord", "statement"]
    keys = [[c for c in one.columns if c not in fixed] for one in scripts]
    width = max(len(k) for k in keys)
    body = None
    for one, key in zip(scripts, keys):
        part = one.select("table_ord", "line_ord", *_sort_keys(one, key, width), "statement")
        body = part if body is None else body.unionByName(part)
    frame = [(-1, i, line) for i, line in enumerate(dialect.data_script_start)]
    frame += [(len(scripts), i, line) for i, line in enumerate(dialect.data_script_end)]
    lines = F.array(
        *[
            F.struct(F.lit(a).alias("table_ord"), F.lit(b).alias("line_ord"), F.lit(line).alias("statement"))
            for a, b, line in frame
        ]
    )
    edges = body.sparkSession.range(1).select(F.explode(lines).alias("e"))
    edges = edges.select("e.table_ord", "e.line_ord", *_sort_keys(edges, [], width), "e.statement")
    return body.unionByName(edges)
