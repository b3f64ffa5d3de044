"""The deployment plan: script lines that make each target schema match its source.

A plan is a set of rows, one per line of script, for all database pairs at once. The rows
sort by PLAN_ORDER into one script per pair; nothing is collected to build them. Texts of
the section titles and warnings are fixed values.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import fields
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.functions.dialect import Dialect, fill
from evenkeel.operators.codediff import code_key
from evenkeel.operators.schemadiff import TABLE_KEY, SchemaDiff
from evenkeel.options import CompareOptions, ScriptOptions
from evenkeel.plans.lineage import landed
from evenkeel.plans.ordering import creation_order, creation_orders
from evenkeel.sources.snapshot import Snapshot

PLAN_ORDER = ["phase", "n1", "t1", "t2", "n2", "n3", "t3", "line"]

SECTIONS = {
    0: "Create missing schemas",
    1: "Drop removed/recreated code objects",
    2: "Drop foreign keys",
    3: "Drop changed/removed indexes and constraints",
    4: "Drop tables that exist only in the target",
    5: "Create missing tables",
    6: "Alter columns",
    7: "Create primary keys and constraints",
    8: "Create indexes",
    9: "Create foreign keys",
    10: "Create/replace code objects",
}
_START, _END, _TITLE = -1, 99, -1000


def _lines(df: DataFrame, phase: int, texts: list[Column], *, n1=None, t1=None, t2=None, n2=None, n3=None, t3=None) -> DataFrame:
    """Plan rows from a list of texts per input row; NULL texts are left out."""
    zero, empty = F.lit(0), F.lit("")
    rows = F.array_compact(
        F.array(*[F.when(t.isNotNull(), F.struct(F.lit(i).alias("line"), t.alias("text"))) for i, t in enumerate(texts)])
    )
    out = df.select(
        "pair_id",
        F.lit(phase).alias("phase"),
        (n1 if n1 is not None else zero).cast("int").alias("n1"),
        F.upper(t1 if t1 is not None else empty).alias("t1"),
        F.upper(t2 if t2 is not None else empty).alias("t2"),
        (n2 if n2 is not None else zero).cast("int").alias("n2"),
        (n3 if n3 is not None else zero).cast("int").alias("n3"),
        F.upper(t3 if t3 is not None else empty).alias("t3"),
        F.explode(rows).alias("r"),
    )
    return out.select(*[c for c in out.columns if c != "r"], "r.line", "r.text")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class DeploymentPlan:
    def __init__(
        self,
        snapshot: Snapshot,
        dialect: Dialect,
        compare: CompareOptions = CompareOptions(),
        script: ScriptOptions = ScriptOptions(),
        selection: DataFrame | None = None,
    ):
        self.diff = SchemaDiff(snapshot, compare)
        self.snapshot = snapshot
        self.dialect = dialect
        self.script = script
        self.selection = selection

    # What is selected ---------------------------------------------------------
    @cached_property
    def _tables(self) -> DataFrame:
        """Selected tables by key and presence. Without a selection every table counts:
        one that is equal has nothing to script."""
        tables = self.diff.tables
        if self.selection is None:
            return tables
        fold = self.diff.options.fold
        wanted = self.selection.filter("type = 'Table'").select("pair_id", fold(F.concat("schema", F.lit("."), "name")).alias("tkey"))
        return tables.join(wanted, TABLE_KEY, "left_semi")

    def _kept(self, pairs: DataFrame) -> DataFrame:
        """Children of selected tables that exist on both sides."""
        if self.selection is None:
            return pairs
        return pairs.join(self._tables.select(*TABLE_KEY), TABLE_KEY, "left_semi")

    @cached_property
    def _new(self) -> DataFrame:
        return self._tables.filter("presence = 'SourceOnly'").select(*TABLE_KEY)

    @cached_property
    def _dropped(self) -> DataFrame:
        rows = self._tables.filter("presence = 'TargetOnly'").select(*TABLE_KEY, "schema", "table")
        return rows if self.script.include_drops else rows.limit(0)

    def _side(self, df: DataFrame, side: str) -> DataFrame:
        return self.diff.keyed(df.filter(F.col("side") == side).drop("side"))

    def _source_names(self) -> Column:
        return self.dialect.qualify(F.col("schema"), F.col("table"))

    def _target_names(self) -> Column:
        return self.dialect.qualify(F.col("target_schema"), F.col("target_table"))

    def _redefined(self, kind: str) -> DataFrame:
        """Children of one kind that differ, with both models."""
        if kind == "pk":
            pairs = self.diff.pk_pairs
        else:
            rows = self.diff.child_rows(kind).withColumn("nkey", self.diff.options.fold(F.col("name")))
            pairs = self.diff.pair_up(rows.drop("schema", "table"), TABLE_KEY + ["nkey"])
        return self._kept(pairs).filter(~F.col("s.sig").eqNullSafe(F.col("t.sig")))

    @cached_property
    def _code(self) -> DataFrame:
        """Selected code objects that are not equal, with their key and status."""
        rows = self.diff.code.filter("status <> 'Equal'")
        key = code_key(F.col("type"), F.col("schema"), F.col("name"), self.diff.options)
        rows = rows.select("pair_id", key.alias("ckey"), "status")
        if self.selection is None:
            return rows
        wanted = self.selection.filter("type <> 'Table'").select("pair_id", key.alias("ckey"))
        return rows.join(wanted, ["pair_id", "ckey"], "left_semi")

    def _code_models(self, side: str, statuses: list[str]) -> DataFrame:
        rows = self.snapshot.code_objects.filter(F.col("side") == side).drop("side")
        key = code_key(F.initcap("kind"), F.col("schema"), F.col("name"), self.diff.options)
        wanted = self._code.filter(F.col("status").isin(*statuses)).select("pair_id", "ckey")
        return rows.withColumn("ckey", key).join(wanted, ["pair_id", "ckey"], "left_semi")

    @cached_property
    def _redefined_of(self) -> dict[str, DataFrame]:
        return {kind: self._redefined(kind) for kind in ("pk", "unique", "check", "index", "fk")}

    @cached_property
    def _gone_code(self) -> DataFrame | None:
        """Code that goes or is created anew, if any can."""
        statuses = (["TargetOnly"] if self.script.include_drops else []) + (
            ["Different"] if self.dialect.drops_changed_code else []
        )
        return self._code_models("target", statuses) if statuses else None

    @cached_property
    def _created_code(self) -> DataFrame:
        return self._code_models("source", ["SourceOnly", "Different"])

    @cached_property
    def _gone_order(self) -> DataFrame | None:
        return None if self._gone_code is None else creation_order(self._gone_code)

    @cached_property
    def _created_order(self) -> DataFrame:
        return creation_order(self._created_code)

    def _land(self) -> None:
        """Land what several phases read, so that each of it is computed once; and order all code in the same rounds."""
        self.diff.tables = landed(self.diff.tables, "plan-tables")
        self._redefined_of = {kind: landed(rows, f"plan-{kind}") for kind, rows in self._redefined_of.items()}
        self._code = landed(self._code, "plan-code")
        if self._gone_code is not None:
            self._gone_code = landed(self._gone_code, "plan-gone")
            self._created_code = landed(self._created_code, "plan-created")
            self._gone_order, self._created_order = creation_orders([self._gone_code, self._created_code])

    # Phases ------------------------------------------------------------------------
    @cached_property
    def schemas(self) -> DataFrame:
        """Schemas the source has and the target lacks; the selection does not matter."""
        fold = self.diff.options.fold
        rows = self.snapshot.schemas.withColumn("skey", fold(F.col("schema")))
        source, target = SchemaDiff.sides(rows)
        missing = source.join(target.select("pair_id", "skey"), ["pair_id", "skey"], "left_anti")
        return _lines(missing, 0, self.dialect.create_schema(F.col("schema")), t1=F.col("schema"))

    @cached_property
    def drop_code(self) -> DataFrame:
        """Code that goes or is created anew, in reverse creation order."""
        if self._gone_order is None:
            return self._no_rows()
        code = F.struct("kind", "schema", "name", "parent_table")
        return _lines(
            self._gone_order, 1, [self.dialect.drop_code(code)], n1=-F.col("kind_ord"), n2=-F.col("level"), n3=-F.col("input_ord")
        )

    @cached_property
    def drop_fks(self) -> DataFrame:
        """Changed and removed foreign keys, and all that refer or belong to a dropped table."""
        fold = self.diff.options.fold
        changed = self._redefined_of["fk"].filter("t is not null").select(
            *TABLE_KEY, "nkey", F.col("target_schema").alias("schema"), F.col("target_table").alias("table"), F.col("t.name").alias("name")
        )
        all_fks = self._side(self.snapshot.fks, "target").withColumn("nkey", fold(F.col("name")))
        all_fks = all_fks.withColumn("rkey", fold(F.concat("ref_schema", F.lit("."), "ref_table")))
        gone = self._dropped.select(*TABLE_KEY)
        columns = [*TABLE_KEY, "nkey", "schema", "table", "name"]
        of_dropped = all_fks.join(gone, TABLE_KEY, "left_semi").select(*columns)
        to_dropped = all_fks.join(gone.withColumnRenamed("tkey", "rkey"), ["pair_id", "rkey"], "left_semi").select(*columns)
        rows = _union([changed, of_dropped, to_dropped]).dropDuplicates([*TABLE_KEY, "nkey"])
        text = self.dialect.drop_foreign_key(self._source_names(), F.col("name"))
        return _lines(rows, 2, [text], t1=F.col("schema"), t2=F.col("table"), t3=F.col("name"))

    @cached_property
    def drop_constraints(self) -> DataFrame:
        """Indexes, unique constraints, checks and primary keys that go or change."""
        target = self._target_names()
        parts = []
        for position, kind in enumerate(("index", "unique", "check", "pk")):
            rows = self._redefined_of[kind].filter("t is not null")
            if kind == "index":
                text = self.dialect.drop_index(F.col("target_schema"), F.col("target_table"), F.col("t.name"))
            else:
                text = self.dialect.drop_constraint(target, F.col("t.name"))
            parts.append(
                _lines(rows, 3, [text], t1=F.col("schema"), t2=F.col("table"), n2=F.lit(position), t3=F.col("t.name"))
            )
        return _union(parts)

    @cached_property
    def drop_tables(self) -> DataFrame:
        warning = fill("-- WARNING: dropping table {s}.{t} discards its data.", s=F.col("schema"), t=F.col("table"))
        texts = [warning, self.dialect.drop_table(self._source_names())]
        return _lines(self._dropped, 4, texts, t1=F.col("schema"), t2=F.col("table"))

    def create_table_lines(self, side: str, tables: DataFrame | None = None) -> DataFrame:
        """CREATE TABLE of each table as lines: pair_id, schema, table, part, ord, name, text."""
        s, d = self.snapshot, self.dialect

        def rows(df: DataFrame) -> DataFrame:
            df = self._side(df, side)
            return df if tables is None else df.join(tables, TABLE_KEY, "left_semi")

        def part(df: DataFrame, number: int, ord_: Column, text: Column) -> DataFrame:
            return df.select(*TABLE_KEY, "schema", "table", F.lit(number).alias("part"), ord_.cast("int").alias("ord"), "name", F.concat(F.lit("    "), text).alias("text"))

        keys = rows(s.keys).withColumn("columns", F.array_sort("columns"))
        key = F.struct("name", "is_primary", "is_clustered", "columns")
        column = F.struct(*[F.col(c) for c in s.columns.columns])
        body = _union(
            [
                part(rows(s.columns).withColumn("side", F.lit(side)), 1, F.col("ordinal"), d.column_definition(column)),
                part(keys.filter("is_primary"), 2, F.lit(0), d.key_clause(key)),
                part(keys.filter("not is_primary"), 3, F.lit(0), d.key_clause(key)),
                part(rows(s.checks), 4, F.lit(0), d.check_clause(F.col("name"), F.col("expression"))),
            ]
        )
        place = F.struct("part", "ord", F.upper("name").alias("u"))
        last = body.groupBy(*TABLE_KEY).agg(F.max(place).alias("last"))
        body = body.join(last, TABLE_KEY).withColumn(
            "text", F.when(place == F.col("last"), F.col("text")).otherwise(F.concat("text", F.lit(",")))
        )
        frame = rows(s.tables).select(
            *TABLE_KEY,
            "schema",
            "table",
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("part"), F.concat(F.lit("CREATE TABLE "), d.qualify(F.col("schema"), F.col("table")), F.lit(" (")).alias("text")),
                    F.struct(F.lit(9).alias("part"), F.lit(");").alias("text")),
                )
            ).alias("f"),
        )
        frame = frame.select(*TABLE_KEY, "schema", "table", "f.part", F.lit(0).alias("ord"), F.lit("").alias("name"), "f.text")
        return body.drop("last").unionByName(frame)

    def render_lines(self, side: str) -> DataFrame:
        """CREATE TABLE lines with the foreign keys and indexes of the table as comments."""
        d = ", "
        fks = self._side(self.snapshot.fks, side).withColumn("columns", F.array_sort("columns"))
        fk_text = fill(
            "-- FK {n}: ({c}) → {rs}.{rt} ({rc})",
            n=F.col("name"),
            c=F.array_join(F.transform("columns", lambda c: c["name"]), d),
            rs=F.col("ref_schema"),
            rt=F.col("ref_table"),
            rc=F.array_join(F.transform("columns", lambda c: c["ref_name"]), d),
        )
        from evenkeel.functions.signatures import column_list

        indexes = self._side(self.snapshot.indexes, side)
        ix_text = F.when(
            F.col("raw_definition").isNotNull(), F.concat(F.lit("-- "), F.col("raw_definition"))
        ).otherwise(
            fill("-- INDEX {n}{u}: ({c})", n=F.col("name"), u=F.when(F.col("is_unique"), " UNIQUE").otherwise(""), c=column_list(F.col("columns"), d))
        )

        def comment(df: DataFrame, part: int, text: Column) -> DataFrame:
            return df.select(*TABLE_KEY, "schema", "table", F.lit(part).alias("part"), F.lit(0).alias("ord"), "name", text.alias("text"))

        return _union([self.create_table_lines(side), comment(fks, 10, fk_text), comment(indexes, 11, ix_text)])

    @cached_property
    def create_tables(self) -> DataFrame:
        """New tables without their foreign keys and indexes, which come in later phases."""
        lines = self.create_table_lines("source", self._new)
        texts = [F.col("text"), F.when(F.col("part") == 9, "")]
        return _lines(
            lines, 5, texts, t1=F.col("schema"), t2=F.col("table"), n2=F.col("part"), n3=F.col("ord"), t3=F.col("name")
        )

    @cached_property
    def alter_columns(self) -> DataFrame:
        """Columns to add, then to change, then to drop, table by table."""
        d = self.dialect
        s, t, changes = F.col("s"), F.col("t"), F.col("changes")
        pairs = self._kept(self.diff.column_pairs)
        table = self._source_names()
        full = F.concat("schema", F.lit("."), "table")
        where = {"t1": F.col("schema"), "t2": F.col("table")}

        added = pairs.filter("t is null")
        risky = ~s["is_nullable"] & s["default_expr"].isNull() & s["computed_expr"].isNull() & s["identity_clause"].isNull()
        warning = fill(
            "-- WARNING: adding NOT NULL column {c} without a default fails if {f} has rows.", c=d.show_name(s["name"]), f=full
        )
        parts = [
            _lines(added, 6, [F.when(risky, warning), d.add_column(table, s)], n2=F.lit(0), n3=s["ordinal"], t3=s["name"], **where)
        ]
        changed = pairs.filter("s is not null and t is not null").filter(self.diff.any_change())
        lines = d.change_column(table, full, s, t, changes, self.diff.options.ignore_collation)
        parts.append(_lines(changed, 6, lines, n2=F.lit(1), n3=s["ordinal"], t3=s["name"], **where))
        if self.script.include_drops:
            loss = fill(
                "-- WARNING: dropping column {c} from {f} discards its data.", c=d.show_name(t["name"]), f=full
            )
            parts.append(
                _lines(pairs.filter("s is null"), 6, [loss, *d.drop_column(table, t)], n2=F.lit(2), n3=t["ordinal"], t3=t["name"], **where)
            )
        return _union(parts)

    @cached_property
    def add_constraints(self) -> DataFrame:
        """Primary keys, unique constraints and checks of kept tables."""
        parts = []
        for position, kind in enumerate(("pk", "unique", "check")):
            rows = self._redefined_of[kind].filter("s is not null")
            table = self._source_names()
            text = (
                self.dialect.add_check(table, F.col("s.name"), F.col("s.expression"))
                if kind == "check"
                else self.dialect.add_key(table, F.col("s"))
            )
            parts.append(
                _lines(rows, 7, [text], t1=F.col("schema"), t2=F.col("table"), n2=F.lit(position), t3=F.col("s.name"))
            )
        return _union(parts)

    def _created(self, kind: str, frame: DataFrame) -> DataFrame:
        """Children to create: changed ones of kept tables and all of new tables."""
        kept = self._redefined_of[kind].filter("s is not null").select("pair_id", "schema", "table", "s", F.lit(0).alias("is_new"))
        new = self._side(frame, "source").join(self._new, TABLE_KEY, "left_semi")
        if kind in ("fk", "index"):
            new = new.withColumn("columns", F.array_sort("columns"))
        names = [f.name for f in kept.schema["s"].dataType.fields if f.name in new.columns]
        new = new.select("pair_id", "schema", "table", F.struct(*names).alias("s"), F.lit(1).alias("is_new"))
        kept = kept.withColumn("s", F.struct(*[F.col(f"s.{n}").alias(n) for n in names]))
        return kept.unionByName(new)

    @cached_property
    def create_indexes(self) -> DataFrame:
        rows = self._created("index", self.snapshot.indexes)
        text = self.dialect.create_index(self._source_names(), F.col("s"))
        return _lines(rows, 8, [text], n1=F.col("is_new"), t1=F.col("schema"), t2=F.col("table"), t3=F.col("s.name"))

    @cached_property
    def create_fks(self) -> DataFrame:
        rows = self._created("fk", self.snapshot.fks)
        text = self.dialect.add_foreign_key(self._source_names(), F.col("s"))
        return _lines(rows, 9, [text], n1=F.col("is_new"), t1=F.col("schema"), t2=F.col("table"), t3=F.col("s.name"))

    @cached_property
    def create_code(self) -> DataFrame:
        """New and changed code: functions, views, procedures, triggers; needed ones first."""
        texts = self.dialect.create_code(F.col("definition"))
        return _lines(self._created_order, 10, texts, n1=F.col("kind_ord"), n2=F.col("level"), n3=F.col("input_ord"))

    def _no_rows(self) -> DataFrame:
        return _lines(self.snapshot.databases.limit(0), 0, [F.lit("")])

    # The whole ----------------------------------------------------------------------
    @cached_property
    def rows(self) -> DataFrame:
        """All phases with titles, header and transaction, for the pairs whose two sides run the dialect's engine."""
        self._land()
        phases = [
            self.schemas, self.drop_code, self.drop_fks, self.drop_constraints, self.drop_tables, self.create_tables,
            self.alter_columns, self.add_constraints, self.create_indexes, self.create_fks, self.create_code,
        ]
        # Landed once: the titles and any sort would compute all phases again.
        body = landed(_union(phases), "plan-lines")
        title = F.lit("")
        for phase, name in SECTIONS.items():
            title = F.when(F.col("phase") == phase, f"-- ==== {name} ====").otherwise(title)
        seen = body.select("pair_id", "phase").distinct()
        titles = _lines_with_phase(seen, [F.lit(""), title])
        source, target = SchemaDiff.sides(self.snapshot.databases)
        names = source.select("pair_id", F.col("database").alias("s")).join(
            target.select("pair_id", F.col("database").alias("t")), "pair_id"
        )
        header = [
            F.lit(f"-- Deployment script ({self.dialect.name})"),
            fill("-- Source: {s}   Target: {t}", s=F.col("s"), t=F.col("t")),
            F.lit("-- Review carefully before executing against the target database."),
        ]
        use = self.script.use_transaction
        start = _lines(names, _START, header + [F.lit(x) for x in self.dialect.script_start(use)])
        parts = [body, titles, start]
        closing = self.dialect.script_end(use)
        if closing:
            parts.append(_lines(names, _END, [F.lit(x) for x in closing]))
        return _union(parts).join(engine_pairs(self.snapshot, self.dialect), "pair_id", "left_semi")


def _engines(snapshot: Snapshot) -> DataFrame:
    source, target = SchemaDiff.sides(snapshot.databases)
    return source.select("pair_id", F.col("provider").alias("s")).join(target.select("pair_id", F.col("provider").alias("t")), "pair_id")


def engine_pairs(snapshot: Snapshot, dialect: Dialect) -> DataFrame:
    """The pairs whose two sides run the engine of the dialect."""
    name = dialect.name.upper()
    return _engines(snapshot).where((F.upper("s") == name) & (F.upper("t") == name)).select("pair_id")


def fleet_rows(
    snapshot: Snapshot,
    dialects: Sequence[Dialect],
    compare: CompareOptions = CompareOptions(),
    script: ScriptOptions = ScriptOptions(),
    selection: DataFrame | None = None,
) -> DataFrame:
    """The plan of every pair in the dialect of its own engine. A pair of two engines, or of one
    without a dialect, has a line that says why it has no script."""
    place = "_dialect"
    served = _union([engine_pairs(snapshot, d).withColumn(place, F.lit(i)) for i, d in enumerate(dialects)])
    served = landed(served, "served-pairs")
    # Landed once for all dialects, each in its own folder, as a plan reads each frame several times.
    frames = {f.name: landed(getattr(snapshot, f.name).join(served, "pair_id"), f.name, place) for f in fields(snapshot)}
    parts = []
    for i, dialect in enumerate(dialects):
        own = Snapshot(**{name: frame.where(F.col(place) == i).drop(place) for name, frame in frames.items()})
        parts.append(DeploymentPlan(own, dialect, compare, script, selection).rows)
    left = _engines(snapshot).join(served, "pair_id", "left_anti")
    text = fill("-- ERROR: no script: the source runs {s}, the target runs {t}.", s=F.coalesce("s", F.lit("?")), t=F.coalesce("t", F.lit("?")))
    return _union([*parts, _lines(left, _START, [text])])


def _lines_with_phase(df: DataFrame, texts: list[Column]) -> DataFrame:
    """Title rows: like `_lines`, with the phase taken from the row."""
    rows = F.array(*[F.struct(F.lit(i).alias("line"), t.alias("text")) for i, t in enumerate(texts)])
    out = df.select("pair_id", "phase", F.explode(rows).alias("r"))
    return out.select(
        "pair_id", "phase", F.lit(_TITLE).alias("n1"), F.lit("").alias("t1"), F.lit("").alias("t2"),
        F.lit(0).alias("n2"), F.lit(0).alias("n3"), F.lit("").alias("t3"), "r.line", "r.text",
    )
