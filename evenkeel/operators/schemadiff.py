"""Compare two schema snapshots, for any number of database pairs in one job.

Names are matched with full outer joins on (pair, table, name). What differs is kept as
long rows, one per finding, so a table with very many findings never becomes one value.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenkeel.functions import signatures
from evenkeel.functions.text import details_preview, normalize_expression
from evenkeel.operators.codediff import code_key, compare_code, type_order
from evenkeel.options import CompareOptions
from evenkeel.sources.snapshot import Snapshot

TABLE_KEY = ["pair_id", "tkey"]

# The order of findings within a table and the words used for each kind.
KINDS = {
    "column": (0, "Column"),
    "pk": (1, "Primary key"),
    "unique": (2, "Unique constraint"),
    "fk": (3, "Foreign key"),
    "check": (4, "Check constraint"),
    "index": (5, "Index"),
}
FINDING_ORDER = ["kind_ord", "only_target", "ord", "item_key", "aspect_ord"]


def _null(word: Column) -> Column:
    return F.when(word, "NULL").otherwise("NOT NULL")


def _show(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "(none)").otherwise(value)


class SchemaDiff:
    """Findings about a snapshot. Every attribute is a lazy DataFrame."""

    def __init__(self, snapshot: Snapshot, options: CompareOptions = CompareOptions()):
        self.snapshot = snapshot
        self.options = options

    # Matching -----------------------------------------------------------------
    def table_key(self, schema: str = "schema", table: str = "table") -> Column:
        return self.options.fold(F.concat(F.col(schema), F.lit("."), F.col(table)))

    def keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("tkey", self.table_key())

    @staticmethod
    def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        return df.filter("side = 'source'").drop("side"), df.filter("side = 'target'").drop("side")

    @cached_property
    def tables(self) -> DataFrame:
        """pair_id, tkey, schema, table, presence. Names are the source's where it has them."""
        source, target = self.sides(self.keyed(self.snapshot.tables))
        joined = source.alias("l").join(target.alias("r"), TABLE_KEY, "full_outer")
        presence = F.when(F.col("r.table").isNull(), "SourceOnly").when(F.col("l.table").isNull(), "TargetOnly")
        return joined.select(
            *TABLE_KEY,
            F.coalesce("l.schema", "r.schema").alias("schema"),
            F.coalesce("l.table", "r.table").alias("table"),
            F.col("r.schema").alias("target_schema"),
            F.col("r.table").alias("target_table"),
            presence.otherwise("Both").alias("presence"),
        )

    @cached_property
    def matched(self) -> DataFrame:
        return self.tables.filter("presence = 'Both'").drop("presence")

    def pair_up(self, df: DataFrame, on: list[str]) -> DataFrame:
        """Children of matched tables by name: keys, table names, structs `s` and `t`."""
        source, target = self.sides(df)
        rest = [c for c in df.columns if c not in on + ["side"]]
        left = source.select(*on, F.struct(*rest).alias("s"))
        right = target.select(*on, F.struct(*rest).alias("t"))
        return left.join(right, on, "full_outer").join(self.matched, TABLE_KEY)

    # Columns ------------------------------------------------------------------
    @cached_property
    def column_pairs(self) -> DataFrame:
        """Columns of matched tables with `s`, `t` and, where both exist, `changes`."""
        rows = self.keyed(self.snapshot.columns).withColumn("ckey", self.options.fold(F.col("name")))
        rows = rows.select(
            "*",
            normalize_expression(F.col("default_expr")).alias("n_default"),
            normalize_expression(F.col("identity_clause")).alias("n_identity"),
            normalize_expression(F.col("computed_expr")).alias("n_computed"),
        )
        pairs = self.pair_up(rows.drop("schema", "table"), TABLE_KEY + ["ckey"])
        s, t = F.col("s"), F.col("t")
        expression = s["n_computed"] != t["n_computed"]
        persisted = s["computed_expr"].isNotNull() & (s["is_persisted"] != t["is_persisted"])
        changes = F.struct(
            (F.upper(s["data_type"]) != F.upper(t["data_type"])).alias("type"),
            (s["is_nullable"] != t["is_nullable"]).alias("nullability"),
            (s["n_default"] != t["n_default"]).alias("default"),
            (s["n_identity"] != t["n_identity"]).alias("identity"),
            expression.alias("expression"),
            (expression | persisted).alias("computed"),
            (F.upper(F.coalesce(s["collation"], F.lit(""))) != F.upper(F.coalesce(t["collation"], F.lit("")))).alias(
                "collation"
            ),
        )
        return pairs.withColumn("changes", F.when(s.isNotNull() & t.isNotNull(), changes))

    def any_change(self) -> Column:
        c = F.col("changes")
        aspects = ["type", "nullability", "default", "identity", "computed"]
        if not self.options.ignore_collation:
            aspects.append("collation")
        return reduce(lambda a, b: a | b, [c[a] for a in aspects])

    @cached_property
    def column_findings(self) -> DataFrame:
        """One row per difference of a column: what was there, then what the source has."""
        s, t, c = F.col("s"), F.col("t"), F.col("changes")
        head = F.concat(F.lit("Column ["), F.coalesce(s["name"], t["name"]), F.lit("]: "))

        def aspect(position: int, name: str, word: str, before: Column, after: Column) -> Column:
            text = F.concat(head, F.lit(word), before, F.lit(" → "), after)
            row = F.struct(F.lit(position).alias("aspect_ord"), F.lit(name).alias("aspect"), text.alias("detail"))
            return F.when(c[name], row)

        def presence(name: str, text: str, kind: Column) -> Column:
            detail = F.concat(head, F.lit(f"{text} ("), kind, F.lit(")"))
            return F.struct(F.lit(0).alias("aspect_ord"), F.lit(name).alias("aspect"), detail.alias("detail"))

        aspects = [
            aspect(0, "type", "type ", t["data_type"], s["data_type"]),
            aspect(1, "nullability", "", _null(t["is_nullable"]), _null(s["is_nullable"])),
            aspect(2, "default", "default ", _show(t["default_expr"]), _show(s["default_expr"])),
            aspect(3, "identity", "identity ", _show(t["identity_clause"]), _show(s["identity_clause"])),
            aspect(4, "computed", "computed ", _show(t["computed_expr"]), _show(s["computed_expr"])),
        ]
        if not self.options.ignore_collation:
            aspects.append(aspect(5, "collation", "collation ", _show(t["collation"]), _show(s["collation"])))
        found = (
            F.when(t.isNull(), F.array(presence("missing", "missing in target", s["data_type"])))
            .when(s.isNull(), F.array(presence("extra", "only in target", t["data_type"])))
            .otherwise(F.array_compact(F.array(*aspects)))
        )
        rows = self.column_pairs.select(
            *TABLE_KEY,
            "schema",
            "table",
            F.lit("column").alias("kind"),
            F.lit(0).alias("kind_ord"),
            s.isNull().cast("int").alias("only_target"),
            F.coalesce(s["ordinal"], t["ordinal"]).alias("ord"),
            F.col("ckey").alias("item_key"),
            F.coalesce(s["name"], t["name"]).alias("item"),
            F.explode(found).alias("f"),
        )
        return rows.select(*[c for c in rows.columns if c != "f"], "f.aspect_ord", "f.aspect", "f.detail")

    # Keys, constraints, indexes -------------------------------------------------
    def key_rows(self, primary: bool) -> DataFrame:
        rows = self.keyed(self.snapshot.keys).filter("is_primary" if primary else "not is_primary")
        signature = signatures.key_signature(F.col("is_primary"), F.col("is_clustered"), F.col("columns"))
        return rows.withColumn("columns", F.array_sort("columns")).withColumn("sig", signature)

    def child_rows(self, kind: str) -> DataFrame:
        """Named children of one kind with their signature."""
        if kind == "unique":
            return self.key_rows(primary=False)
        if kind == "fk":
            rows = self.keyed(self.snapshot.fks).withColumn("columns", F.array_sort("columns"))
            return rows.withColumn("sig", signatures.fk_signature(*map(F.col, ("columns", "ref_schema", "ref_table", "on_delete", "on_update"))))
        if kind == "check":
            rows = self.keyed(self.snapshot.checks)
            return rows.withColumn("sig", signatures.check_signature(F.col("expression")))
        rows = self.keyed(self.snapshot.indexes).withColumn("columns", F.array_sort("columns"))
        parts = ("is_unique", "is_clustered", "columns", "included", "filter_expr", "raw_definition")
        return rows.withColumn("sig", signatures.index_signature(*map(F.col, parts)))

    @cached_property
    def pk_pairs(self) -> DataFrame:
        return self.pair_up(self.key_rows(primary=True).drop("schema", "table"), TABLE_KEY)

    @cached_property
    def pk_findings(self) -> DataFrame:
        s, t = F.col("s"), F.col("t")

        def shown(key: Column) -> Column:
            return signatures.column_list(key["columns"], ", ")

        detail = (
            F.when(s.isNull(), F.concat(F.lit("Primary key ["), t["name"], F.lit("]: only in target")))
            .when(t.isNull(), F.concat(F.lit("Primary key ["), s["name"], F.lit("]: missing in target")))
            .otherwise(F.concat(F.lit("Primary key: ("), shown(t), F.lit(") → ("), shown(s), F.lit(")")))
        )
        differs = self.pk_pairs.filter(~F.col("s.sig").eqNullSafe(F.col("t.sig")))
        return differs.select(
            *TABLE_KEY, "schema", "table",
            F.lit("pk").alias("kind"), F.lit(1).alias("kind_ord"), F.lit(0).alias("only_target"), F.lit(0).alias("ord"),
            F.lit("").alias("item_key"), F.coalesce(s["name"], t["name"]).alias("item"), F.lit(0).alias("aspect_ord"),
            F.when(s.isNull(), "extra").when(t.isNull(), "missing").otherwise("definition").alias("aspect"),
            detail.alias("detail"),
        )

    @cached_property
    def child_pairs(self) -> DataFrame:
        """Names and signatures of all unique, foreign key, check and index children; one
        join for the four kinds."""
        light = [
            self.child_rows(kind).select(
                *TABLE_KEY, "side", F.lit(kind).alias("kind"), self.options.fold(F.col("name")).alias("nkey"), "name", "sig"
            )
            for kind in ("unique", "fk", "check", "index")
        ]
        return self.pair_up(reduce(DataFrame.unionByName, light), TABLE_KEY + ["kind", "nkey"])

    @cached_property
    def child_findings(self) -> DataFrame:
        s, t = F.col("s"), F.col("t")
        word, position = F.lit(""), F.lit(9)
        for kind, (place, label) in KINDS.items():
            word = F.when(F.col("kind") == kind, label).otherwise(word)
            position = F.when(F.col("kind") == kind, place).otherwise(position)
        aspect = F.when(t.isNull(), "missing").when(s.isNull(), "extra").otherwise("definition")
        ending = F.when(t.isNull(), "missing in target").when(s.isNull(), "only in target").otherwise("definition differs")
        differs = self.child_pairs.filter(~F.col("s.sig").eqNullSafe(F.col("t.sig")))
        name = F.coalesce(s["name"], t["name"])
        return differs.select(
            *TABLE_KEY, "schema", "table",
            "kind", position.alias("kind_ord"), s.isNull().cast("int").alias("only_target"), F.lit(0).alias("ord"),
            F.col("nkey").alias("item_key"), name.alias("item"), F.lit(0).alias("aspect_ord"), aspect.alias("aspect"),
            F.concat(word, F.lit(" ["), name, F.lit("]: "), ending).alias("detail"),
        )

    # Results ------------------------------------------------------------------
    @cached_property
    def findings(self) -> DataFrame:
        """All findings about matched tables. Sort by FINDING_ORDER within a table."""
        return self.column_findings.unionByName(self.pk_findings).unionByName(self.child_findings)

    @cached_property
    def code(self) -> DataFrame:
        return compare_code(self.snapshot.code_objects, self.options)

    @cached_property
    def objects(self) -> DataFrame:
        """One row per object: type, names, status, number of findings and a preview."""
        order = [F.col(c) for c in FINDING_ORDER]
        # The rank limit works before the shuffle too, so each task passes on four rows.
        ranked = self.findings.withColumn(
            "place", F.row_number().over(Window.partitionBy(*TABLE_KEY).orderBy(*order))
        ).filter("place <= 4")
        first = ranked.groupBy(*TABLE_KEY).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("place", "detail"))), lambda x: x["detail"]).alias("first")
        )
        counted = self.findings.groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("n_details"))
        tables = self.tables.join(counted, TABLE_KEY, "left").join(first, TABLE_KEY, "left")
        n = F.coalesce(F.col("n_details"), F.lit(0))
        status = F.when(F.col("presence") != "Both", F.col("presence")).when(n > 0, "Different").otherwise("Equal")
        rows = tables.select(
            "pair_id", F.lit("Table").alias("type"), "schema", F.col("table").alias("name"), status.alias("status"),
            n.alias("n_details"), F.coalesce(details_preview(F.col("first"), n), F.lit("")).alias("preview"),
        )
        different = F.col("status") == "Different"
        code = self.code.select(
            "pair_id", "type", "schema", "name", "status",
            different.cast("long").alias("n_details"),
            F.when(different, "Definition differs").otherwise("").alias("preview"),
        )
        return rows.unionByName(code).withColumn("type_ord", type_order(F.col("type")))

    def object_key(self) -> Column:
        """Key of an object row, for selections."""
        return self.options.fold(F.concat("type", F.lit(":"), "schema", F.lit("."), "name"))

    def selected(self, selection: DataFrame | None = None) -> DataFrame:
        """Objects that are not equal; with a selection (pair_id, type, schema, name), those of it."""
        rows = self.objects.filter("status <> 'Equal'")
        if selection is None:
            return rows
        wanted = selection.select("pair_id", self.object_key().alias("okey"))
        return rows.withColumn("okey", self.object_key()).join(wanted, ["pair_id", "okey"], "left_semi").drop("okey")

    @cached_property
    def pair_errors(self) -> DataFrame:
        """Pairs whose sides run different engines cannot be compared."""
        source, target = self.sides(self.snapshot.databases)
        both = source.alias("l").join(target.alias("r"), "pair_id")
        return both.filter(F.upper("l.provider") != F.upper("r.provider")).select(
            "pair_id", F.lit("Source and target must use the same database engine.").alias("error")
        )

    @cached_property
    def summary(self) -> DataFrame:
        """Objects by pair, type and status; a pair of different engines has its reason instead."""
        counts = self.objects.join(self.pair_errors, "pair_id", "left_anti").groupBy("pair_id", "type", "status").agg(
            F.count(F.lit(1)).alias("objects")
        )
        failed = self.pair_errors.select(
            "pair_id", F.lit("").alias("type"), F.col("error").alias("status"), F.lit(0).cast("long").alias("objects")
        )
        return counts.unionByName(failed)

    @cached_property
    def duplicate_names(self) -> DataFrame:
        """Names that occur more than once on one side; a join on them would multiply rows."""
        def repeated(df: DataFrame, kind: str, key: Column) -> DataFrame:
            return df.groupBy("pair_id", "side", F.lit(kind).alias("kind"), key.alias("key")).agg(
                F.count(F.lit(1)).alias("n")
            ).filter("n > 1")

        table = self.table_key()
        item = F.concat(table, F.lit("."), self.options.fold(F.col("name")))
        s = self.snapshot
        parts = [
            repeated(s.tables, "table", table),
            repeated(s.columns, "column", item),
            repeated(s.keys.filter("not is_primary"), "unique", item),
            repeated(s.fks, "fk", item),
            repeated(s.checks, "check", item),
            repeated(s.indexes, "index", item),
            repeated(s.code_objects, "code", code_key(F.col("kind"), F.col("schema"), F.col("name"), self.options)),
        ]
        return reduce(DataFrame.unionByName, parts)

    @cached_property
    def delta(self) -> DataFrame:
        """What to add, drop or change in matched tables: pair_id, schema, table, action,
        item_kind, name. Something redefined is dropped under the target's name and added
        under the source's."""
        s, t = F.col("s"), F.col("t")

        def step(action: str, name: Column) -> Column:
            return F.struct(F.lit(action).alias("action"), name.alias("name"))

        column_step = (
            F.when(t.isNull(), step("add", s["name"]))
            .when(s.isNull(), step("drop", t["name"]))
            .when(self.any_change(), step("change", s["name"]))
        )
        columns = self.column_pairs.select(
            "pair_id", "schema", "table", F.lit("column").alias("item_kind"), column_step.alias("step")
        ).filter("step is not null")

        def redefined(pairs: DataFrame, kind: Column) -> DataFrame:
            steps = F.array_compact(
                F.array(F.when(t.isNotNull(), step("drop", t["name"])), F.when(s.isNotNull(), step("add", s["name"])))
            )
            return pairs.filter(~F.col("s.sig").eqNullSafe(F.col("t.sig"))).select(
                "pair_id", "schema", "table", kind.alias("item_kind"), F.explode(steps).alias("step")
            )

        rows = columns.unionByName(redefined(self.pk_pairs, F.lit("pk"))).unionByName(
            redefined(self.child_pairs, F.col("kind"))
        )
        return rows.select("pair_id", "schema", "table", "step.action", "item_kind", "step.name")

    # Row compare, planned from the catalog -----------------------------------------
    @cached_property
    def comparable_columns(self) -> DataFrame:
        """For each matched table with a usable key: which columns a row compare reads.

        Keys come first in key order, then stored source columns the target has, by ordinal.
        """
        fold = self.options.fold
        source_keys = self.keyed(self.snapshot.keys.filter("is_primary and side = 'source'"))
        key_cols = source_keys.select(*TABLE_KEY, F.explode("columns").alias("k")).select(
            *TABLE_KEY, fold(F.col("k.name")).alias("ckey"), F.col("k.ord").alias("key_ord")
        )
        usable = self.eligibility.filter("error is null").select("pair_id", "tkey")
        pairs = self.column_pairs.filter(F.col("s").isNotNull() & F.col("t").isNotNull())
        rows = pairs.join(usable, TABLE_KEY, "left_semi").join(key_cols, TABLE_KEY + ["ckey"], "left")
        rows = rows.filter(F.col("key_ord").isNotNull() | F.col("s.computed_expr").isNull())
        return rows.select(
            "pair_id", "schema", "table",
            F.when(F.col("key_ord").isNotNull(), "key").otherwise("value").alias("role"),
            F.coalesce("key_ord", "s.ordinal").alias("ord"),
            F.col("s.name").alias("source_name"), F.col("t.name").alias("target_name"),
        )

    @cached_property
    def eligibility(self) -> DataFrame:
        """Matched tables and the reason why rows cannot be compared, if there is one."""
        from evenkeel.operators.rowdiff import KEY_NOT_IN_TARGET, NO_KEY

        fold = self.options.fold
        source_keys = self.keyed(self.snapshot.keys.filter("is_primary and side = 'source'"))
        key_cols = source_keys.select(*TABLE_KEY, F.explode("columns").alias("k")).select(
            *TABLE_KEY, fold(F.col("k.name")).alias("ckey")
        )
        target_cols = self.keyed(self.snapshot.columns.filter("side = 'target'")).select(
            *TABLE_KEY, fold(F.col("name")).alias("ckey"), F.lit(True).alias("found")
        )
        found = key_cols.join(target_cols, TABLE_KEY + ["ckey"], "left")
        usable = found.groupBy(*TABLE_KEY).agg(F.count_if(F.col("found").isNull()).alias("absent"))
        error = F.when(F.col("absent").isNull(), NO_KEY).when(F.col("absent") > 0, KEY_NOT_IN_TARGET)
        return self.matched.join(usable, TABLE_KEY, "left").select(*TABLE_KEY, "schema", "table", error.alias("error"))
