"""Statement wording of SQL Server and PostgreSQL as column expressions.

A dialect turns columns that hold names, types and expressions into columns that hold
statements. The statement texts are fixed values: a target server must accept them.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions import literals, text


def fill(template: str, **parts: Column) -> Column:
    """Concatenate literal text with columns named in braces; '{{' stands for a brace."""
    pieces: list[Column] = []
    for literal_text, field, _, _ in string.Formatter().parse(template):
        if literal_text:
            pieces.append(F.lit(literal_text))
        if field is not None:
            pieces.append(parts[field])
    return F.concat(*pieces)


class Dialect:
    """Shared part of both dialects."""

    name = ""
    quotes = ("", "")

    # Names ------------------------------------------------------------------
    def quote(self, name: Column) -> Column:
        left, right = self.quotes
        return F.concat(F.lit(left), F.replace(name, F.lit(right), F.lit(right * 2)), F.lit(right))

    def qualify(self, schema: Column, name: Column) -> Column:
        return F.concat(self.quote(schema), F.lit("."), self.quote(name))

    def quote_text(self, name: str) -> str:
        left, right = self.quotes
        return left + name.replace(right, right * 2) + right

    def quote_list(self, names: Column) -> Column:
        return F.array_join(F.transform(names, self.quote), ", ")

    def key_columns(self, columns: Column) -> Column:
        """Quoted column list of a key or index; each element has name and is_desc."""
        return F.array_join(
            F.transform(
                columns,
                lambda c: F.concat(self.quote(c["name"]), F.when(c["is_desc"], " DESC").otherwise("")),
            ),
            ", ",
        )

    # Values -----------------------------------------------------------------
    def literal(self, value: Column, dtype: T.DataType) -> Column:
        raise NotImplementedError

    def lacks_literal(self, value: Column, dtype: T.DataType) -> Column | None:
        """Whether the engine can't store the value at all; None if it stores all of the type."""
        return None

    # Statements both dialects share -------------------------------------------
    def key_clause(self, key: Column) -> Column:
        raise NotImplementedError

    def add_key(self, table: Column, key: Column) -> Column:
        return fill("ALTER TABLE {t} ADD {k};", t=table, k=self.key_clause(key))

    def check_clause(self, name: Column, expression: Column) -> Column:
        return fill("CONSTRAINT {n} CHECK {e}", n=self.quote(name), e=expression)

    def add_check(self, table: Column, name: Column, expression: Column) -> Column:
        return fill("ALTER TABLE {t} ADD {c};", t=table, c=self.check_clause(name, expression))

    def add_foreign_key(self, table: Column, fk: Column) -> Column:
        def action(clause: str, value: Column) -> Column:
            return F.when(value != "NO ACTION", F.concat(F.lit(f" {clause} "), value)).otherwise("")

        pairs = fk["columns"]
        return fill(
            "ALTER TABLE {t} ADD CONSTRAINT {n} FOREIGN KEY ({c}) REFERENCES {rt} ({rc}){d}{u};",
            t=table,
            n=self.quote(fk["name"]),
            c=self.quote_list(F.transform(pairs, lambda p: p["name"])),
            rt=self.qualify(fk["ref_schema"], fk["ref_table"]),
            rc=self.quote_list(F.transform(pairs, lambda p: p["ref_name"])),
            d=action("ON DELETE", fk["on_delete"]),
            u=action("ON UPDATE", fk["on_update"]),
        )


class SqlServer(Dialect):
    name = "SQL Server"
    quotes = ("[", "]")
    # A changed module is altered in place.
    drops_changed_code = False

    def literal(self, value: Column, dtype: T.DataType) -> Column:
        return literals.mssql_literal(value, dtype)

    def lacks_literal(self, value: Column, dtype: T.DataType) -> Column | None:
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return F.coalesce(literals.not_finite(value), F.lit(False))
        return None

    def script_start(self, use_transaction: bool) -> list[str]:
        lines = ["", "SET XACT_ABORT ON;", "SET NOCOUNT ON;"]
        return lines + (["BEGIN TRANSACTION;", "GO"] if use_transaction else [])

    def script_end(self, use_transaction: bool) -> list[str]:
        return ["", "COMMIT TRANSACTION;", "GO"] if use_transaction else []

    data_script_start = ("SET XACT_ABORT ON;", "BEGIN TRANSACTION;")
    data_script_end = ("COMMIT TRANSACTION;",)

    def create_schema(self, schema: Column) -> list[Column]:
        escaped = F.replace(schema, F.lit("'"), F.lit("''"))
        return [
            fill("IF SCHEMA_ID(N'{e}') IS NULL EXEC(N'CREATE SCHEMA {q}');", e=escaped, q=self.quote(schema)),
            F.lit("GO"),
        ]

    def drop_code(self, code: Column) -> Column:
        return fill(
            "DROP {k} IF EXISTS {n};", k=F.upper(code["kind"]), n=self.qualify(code["schema"], code["name"])
        )

    def create_code(self, definition: Column) -> list[Column]:
        return [
            F.lit("GO"),
            F.rtrim(text.create_or_alter(definition), F.lit(text.WHITESPACE)),
            F.lit("GO"),
        ]

    def drop_foreign_key(self, table: Column, name: Column) -> Column:
        return self.drop_constraint(table, name)

    def drop_constraint(self, table: Column, name: Column) -> Column:
        return fill("ALTER TABLE {t} DROP CONSTRAINT {n};", t=table, n=self.quote(name))

    def key_clause(self, key: Column) -> Column:
        kind = F.when(
            key["is_primary"], F.when(key["is_clustered"], "PRIMARY KEY CLUSTERED").otherwise("PRIMARY KEY NONCLUSTERED")
        ).otherwise(F.when(key["is_clustered"], "UNIQUE CLUSTERED").otherwise("UNIQUE"))
        return fill(
            "CONSTRAINT {n} {k} ({c})", n=self.quote(key["name"]), k=kind, c=self.key_columns(key["columns"])
        )

    def drop_index(self, schema: Column, table: Column, name: Column) -> Column:
        return fill("DROP INDEX {n} ON {t};", n=self.quote(name), t=self.qualify(schema, table))

    def create_index(self, table: Column, ix: Column) -> Column:
        return fill(
            "CREATE {u}{cl}INDEX {n} ON {t} ({c}){inc}{w};",
            u=F.when(ix["is_unique"], "UNIQUE ").otherwise(""),
            cl=F.when(ix["is_clustered"], "CLUSTERED ").otherwise(""),
            n=self.quote(ix["name"]),
            t=table,
            c=self.key_columns(ix["columns"]),
            inc=F.when(
                F.size(ix["included"]) > 0, F.concat(F.lit(" INCLUDE ("), self.quote_list(ix["included"]), F.lit(")"))
            ).otherwise(""),
            w=F.when(
                F.coalesce(ix["filter_expr"], F.lit("")) != "", F.concat(F.lit(" WHERE "), ix["filter_expr"])
            ).otherwise(""),
        )

    def drop_table(self, table: Column) -> Column:
        return fill("DROP TABLE {t};", t=table)

    def column_definition(self, col: Column) -> Column:
        def opt(prefix: str, value: Column) -> Column:
            return F.when(value.isNotNull(), F.concat(F.lit(prefix), value)).otherwise("")

        computed = fill(
            "{n} AS {e}{p}",
            n=self.quote(col["name"]),
            e=col["computed_expr"],
            p=F.when(col["is_persisted"], " PERSISTED").otherwise(""),
        )
        default = F.concat(
            F.when(
                col["default_constraint"].isNotNull(),
                F.concat(F.lit(" CONSTRAINT "), self.quote(col["default_constraint"])),
            ).otherwise(""),
            F.lit(" DEFAULT "),
            col["default_expr"],
        )
        stored = F.concat(
            self.quote(col["name"]),
            F.lit(" "),
            col["data_type"],
            opt(" COLLATE ", col["collation"]),
            opt(" ", col["identity_clause"]),
            F.when(col["is_nullable"], " NULL").otherwise(" NOT NULL"),
            F.when(col["default_expr"].isNotNull(), default).otherwise(""),
        )
        return F.when(col["computed_expr"].isNotNull(), computed).otherwise(stored)

    def add_column(self, table: Column, col: Column) -> Column:
        return fill("ALTER TABLE {t} ADD {d};", t=table, d=self.column_definition(col))

    def drop_column(self, table: Column, col: Column) -> list[Column]:
        """Lines in order; NULL lines are left out."""
        return [self._drop_default(table, col), self._drop_column(table, col["name"])]

    def _drop_column(self, table: Column, name: Column) -> Column:
        return fill("ALTER TABLE {t} DROP COLUMN {n};", t=table, n=self.quote(name))

    def _drop_default(self, table: Column, col: Column) -> Column:
        return F.when(
            col["default_constraint"].isNotNull(), self.drop_constraint(table, col["default_constraint"])
        )

    def show_name(self, name: Column) -> Column:
        return F.concat(F.lit("["), name, F.lit("]"))

    def change_column(self, table: Column, full_name: Column, s: Column, t: Column, changes: Column, ignore_collation: bool) -> list[Column]:
        """Lines that bring column t in line with column s; NULL lines are left out."""
        rebuilt = changes["computed"]
        typed = changes["type"] & ~rebuilt
        shape = changes["type"] | changes["nullability"]
        if not ignore_collation:
            shape = shape | changes["collation"]
        shape = shape & ~rebuilt
        default_only = changes["default"] & ~rebuilt & ~shape
        none = F.lit("none")
        add_default = F.when(
            s["default_expr"].isNotNull(),
            fill(
                "ALTER TABLE {t} ADD CONSTRAINT {n} DEFAULT {e} FOR {c};",
                t=table,
                n=self.quote(F.coalesce(s["default_constraint"], F.concat(F.lit("DF_"), s["name"]))),
                e=s["default_expr"],
                c=self.quote(s["name"]),
            ),
        )
        return [
            F.when(rebuilt, fill("-- Recreating computed column [{c}] on {f}.", c=s["name"], f=full_name)),
            F.when(rebuilt, self._drop_column(table, s["name"])),
            F.when(rebuilt, self.add_column(table, s)),
            F.when(
                changes["identity"] & ~rebuilt,
                fill(
                    "-- WARNING: identity change on [{c}] ({a} → {b}) cannot be scripted in place;"
                    " requires table rebuild.",
                    c=s["name"],
                    a=F.coalesce(t["identity_clause"], none),
                    b=F.coalesce(s["identity_clause"], none),
                ),
            ),
            F.when(
                typed,
                fill(
                    "-- WARNING: verify {a} → {b} does not truncate data in [{c}].",
                    a=t["data_type"],
                    b=s["data_type"],
                    c=s["name"],
                ),
            ),
            # A default constraint blocks ALTER COLUMN, so it goes first and comes back last.
            F.when(shape | default_only, self._drop_default(table, t)),
            F.when(
                shape,
                fill(
                    "ALTER TABLE {t} ALTER COLUMN {c} {d}{co} {n};",
                    t=table,
                    c=self.quote(s["name"]),
                    d=s["data_type"],
                    co=F.when(s["collation"].isNotNull(), F.concat(F.lit(" COLLATE "), s["collation"])).otherwise(""),
                    n=F.when(s["is_nullable"], "NULL").otherwise("NOT NULL"),
                ),
            ),
            F.when(shape | default_only, add_default),
        ]

    # Row changes --------------------------------------------------------------
    def insert_prefix(self, has_always_identity: bool) -> str:
        return ""

    def before_inserts(self, table: str, has_identity: bool) -> str | None:
        return f"SET IDENTITY_INSERT {table} ON;" if has_identity else None

    def after_inserts(self, table: str, full_name: str, has_identity: bool) -> str | None:
        return f"SET IDENTITY_INSERT {table} OFF;" if has_identity else None


class PostgreSql(Dialect):
    name = "PostgreSQL"
    quotes = ('"', '"')
    # CREATE OR REPLACE fails on changed result columns, so changed code is dropped first.
    drops_changed_code = True

    def literal(self, value: Column, dtype: T.DataType) -> Column:
        return literals.pg_literal(value, dtype)

    def script_start(self, use_transaction: bool) -> list[str]:
        return [""] + (["BEGIN;"] if use_transaction else [])

    def script_end(self, use_transaction: bool) -> list[str]:
        return ["", "COMMIT;"] if use_transaction else []

    data_script_start = ("BEGIN;",)
    data_script_end = ("COMMIT;",)

    def create_schema(self, schema: Column) -> list[Column]:
        return [fill("CREATE SCHEMA IF NOT EXISTS {q};", q=self.quote(schema))]

    def drop_code(self, code: Column) -> Column:
        parent_schema, parent_table = text.split_parent(code["parent_table"])
        parent = F.when(parent_schema.isNotNull(), self.qualify(parent_schema, parent_table)).otherwise(
            self.quote(parent_table)
        )
        routine = F.concat(
            self.qualify(code["schema"], text.routine_name(code["name"])), text.routine_arguments(code["name"])
        )
        return (
            F.when(
                F.lower(code["kind"]) == "view",
                fill("DROP VIEW IF EXISTS {n};", n=self.qualify(code["schema"], code["name"])),
            )
            .when(
                F.lower(code["kind"]) == "trigger",
                fill("DROP TRIGGER IF EXISTS {n} ON {p};", n=self.quote(code["name"]), p=parent),
            )
            .otherwise(fill("DROP {k} IF EXISTS {r};", k=F.upper(code["kind"]), r=routine))
        )

    def _ended(self, statement: Column) -> Column:
        bare = F.rtrim(statement, F.lit(text.WHITESPACE))
        return F.when(bare.endswith(";"), bare).otherwise(F.concat(bare, F.lit(";")))

    def create_code(self, definition: Column) -> list[Column]:
        return [self._ended(definition)]

    def drop_foreign_key(self, table: Column, name: Column) -> Column:
        return self.drop_constraint(table, name)

    def drop_constraint(self, table: Column, name: Column) -> Column:
        return fill("ALTER TABLE {t} DROP CONSTRAINT IF EXISTS {n};", t=table, n=self.quote(name))

    def key_clause(self, key: Column) -> Column:
        return fill(
            "CONSTRAINT {n} {k} ({c})",
            n=self.quote(key["name"]),
            k=F.when(key["is_primary"], "PRIMARY KEY").otherwise("UNIQUE"),
            c=self.quote_list(F.transform(key["columns"], lambda c: c["name"])),
        )

    def drop_index(self, schema: Column, table: Column, name: Column) -> Column:
        return fill("DROP INDEX IF EXISTS {n};", n=self.qualify(schema, name))

    def create_index(self, table: Column, ix: Column) -> Column:
        built = fill(
            "CREATE {u}INDEX {n} ON {t} ({c}){w};",
            u=F.when(ix["is_unique"], "UNIQUE ").otherwise(""),
            n=self.quote(ix["name"]),
            t=table,
            c=self.key_columns(ix["columns"]),
            w=F.when(
                F.coalesce(ix["filter_expr"], F.lit("")) != "", F.concat(F.lit(" WHERE "), ix["filter_expr"])
            ).otherwise(""),
        )
        return F.when(ix["raw_definition"].isNotNull(), self._ended(ix["raw_definition"])).otherwise(built)

    def drop_table(self, table: Column) -> Column:
        return fill("DROP TABLE IF EXISTS {t};", t=table)

    def column_definition(self, col: Column) -> Column:
        computed = fill(
            "{n} {d} GENERATED ALWAYS AS ({e}) STORED",
            n=self.quote(col["name"]),
            d=col["data_type"],
            e=text.strip_outer_parens(F.trim(col["computed_expr"])),
        )
        stored = F.concat(
            self.quote(col["name"]),
            F.lit(" "),
            col["data_type"],
            F.when(col["collation"].isNotNull(), F.concat(F.lit(" COLLATE "), self.quote(col["collation"]))).otherwise(""),
            F.when(col["identity_clause"].isNotNull(), F.concat(F.lit(" "), col["identity_clause"])).otherwise(""),
            F.when(col["is_nullable"], "").otherwise(" NOT NULL"),
            F.when(col["default_expr"].isNotNull(), F.concat(F.lit(" DEFAULT "), col["default_expr"])).otherwise(""),
        )
        return F.when(col["computed_expr"].isNotNull(), computed).otherwise(stored)

    def add_column(self, table: Column, col: Column) -> Column:
        return fill("ALTER TABLE {t} ADD COLUMN {d};", t=table, d=self.column_definition(col))

    def drop_column(self, table: Column, col: Column) -> list[Column]:
        return [self._drop_column(table, col["name"])]

    def _drop_column(self, table: Column, name: Column) -> Column:
        return fill("ALTER TABLE {t} DROP COLUMN {n};", t=table, n=self.quote(name))

    def show_name(self, name: Column) -> Column:
        return F.concat(F.lit('"'), name, F.lit('"'))

    def change_column(self, table: Column, full_name: Column, s: Column, t: Column, changes: Column, ignore_collation: bool) -> list[Column]:
        rebuilt = changes["expression"]
        quoted = self.quote(s["name"])

        def alter(tail: str, **parts: Column) -> Column:
            return fill("ALTER TABLE {t} ALTER COLUMN {c} " + tail, t=table, c=quoted, **parts)

        identity = (
            F.when(s["identity_clause"].isNull(), alter("DROP IDENTITY IF EXISTS;"))
            .when(t["identity_clause"].isNull(), alter("ADD {i};", i=s["identity_clause"]))
            .when(s["identity_clause"].contains("ALWAYS"), alter("SET GENERATED ALWAYS;"))
            .otherwise(alter("SET GENERATED BY DEFAULT;"))
        )
        return [
            F.when(rebuilt, fill('-- Recreating generated column "{c}" on {f}.', c=s["name"], f=full_name)),
            F.when(rebuilt, self._drop_column(table, s["name"])),
            F.when(rebuilt, self.add_column(table, s)),
            F.when(
                changes["type"] & ~rebuilt,
                fill(
                    '-- WARNING: verify the cast {a} → {b} preserves the data in "{c}".',
                    a=t["data_type"],
                    b=s["data_type"],
                    c=s["name"],
                ),
            ),
            F.when(changes["type"] & ~rebuilt, alter("TYPE {d} USING {c}::{d};", d=s["data_type"])),
            F.when(
                changes["nullability"] & ~rebuilt,
                F.when(s["is_nullable"], alter("DROP NOT NULL;")).otherwise(alter("SET NOT NULL;")),
            ),
            F.when(
                changes["default"] & ~rebuilt,
                F.when(s["default_expr"].isNull(), alter("DROP DEFAULT;")).otherwise(
                    alter("SET DEFAULT {e};", e=s["default_expr"])
                ),
            ),
            F.when(changes["identity"] & ~rebuilt, identity),
        ]

    # Row changes --------------------------------------------------------------
    def insert_prefix(self, has_always_identity: bool) -> str:
        return "OVERRIDING SYSTEM VALUE " if has_always_identity else ""

    def before_inserts(self, table: str, has_identity: bool) -> str | None:
        return None

    def after_inserts(self, table: str, full_name: str, has_identity: bool) -> str | None:
        if not has_identity:
            return None
        return (
            f"-- NOTE: resync the sequence for {full_name} if needed,"
            " e.g. setval(pg_get_serial_sequence(...), max(id))."
        )


SQL_SERVER = SqlServer()
POSTGRESQL = PostgreSql()
