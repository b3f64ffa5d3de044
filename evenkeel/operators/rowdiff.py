"""Row compare of two keyed tables, and everything that follows from it.

`diff_rows` is one full outer join. Counts, changed columns, the change feed and the
statements are projections or aggregates of it. Where only one outcome is asked for, a
semi or anti join is the cheaper plan and has its own function.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.functions.compare import common_type, comparable, exact_text
from evenkeel.operators.occurrences import number_occurrences
from evenkeel.options import RowDiffOptions

NO_KEY = "No primary key — rows cannot be matched."
KEY_NOT_IN_TARGET = "Primary key columns are missing in the target — sync the schema first."


@dataclass(frozen=True)
class ColumnPlan:
    """Which columns identify a row and which are compared, with their names per side. `carried`
    columns are computed ones that both sides have: not compared, but the source's value counts."""

    keys: tuple[str, ...]
    values: tuple[str, ...]
    target_name: dict[str, str] = field(default_factory=dict)
    target_only: tuple[str, ...] = ()
    error: str | None = None
    carried: tuple[str, ...] = ()


def plan_columns(
    source: T.StructType, target: T.StructType, keys: Sequence[str], computed: Iterable[str] = ()
) -> ColumnPlan:
    """Keys in key order, then the source columns that are stored and exist on both sides.

    Names match without regard to case; each side keeps its own spelling.
    """
    if not keys:
        return ColumnPlan((), (), error=NO_KEY)
    target_names = {f.name.upper(): f.name for f in target.fields}
    if any(k.upper() not in target_names for k in keys):
        return ColumnPlan(tuple(keys), (), error=KEY_NOT_IN_TARGET)
    source_names = {f.name.upper(): f.name for f in source.fields}
    key_names = tuple(source_names[k.upper()] for k in keys)
    skip = {k.upper() for k in keys} | {c.upper() for c in computed}
    values = tuple(
        f.name for f in source.fields if f.name.upper() not in skip and f.name.upper() in target_names
    )
    computed_names = {c.upper() for c in computed} - {k.upper() for k in keys}
    carried = tuple(f.name for f in source.fields if f.name.upper() in computed_names & set(target_names))
    shared = {v.upper() for v in key_names + values + carried}
    return ColumnPlan(
        key_names,
        values,
        {c: target_names[c.upper()] for c in key_names + values + carried},
        tuple(f.name for f in target.fields if f.name.upper() not in shared),
        carried=carried,
    )


@dataclass(frozen=True)
class RowDiff:
    """`df` has the keys (and `occ` if rows were paired), `status`, `changed`, `s` and `t`.
    `s` has the carried columns too."""

    df: DataFrame
    keys: tuple[str, ...]
    values: tuple[str, ...]
    types: dict[str, T.DataType]
    options: RowDiffOptions
    plan: ColumnPlan | None = None

    @property
    def key_columns(self) -> list[str]:
        return list(self.keys) + (["occ"] if self.options.pair_duplicates else [])


class NotComparable(ValueError):
    """The two tables cannot be compared; the message says why."""


def _require(plan: ColumnPlan) -> ColumnPlan:
    if plan.error:
        raise NotComparable(plan.error)
    return plan


def _sides(
    source: DataFrame, target: DataFrame, plan: ColumnPlan, options: RowDiffOptions
) -> tuple[DataFrame, DataFrame, dict[str, T.DataType]]:
    """Both sides with the same names and types, keys and compared columns only."""
    types, texts = {}, set()
    for c in plan.keys + plan.values:
        a, b = source.schema[c].dataType, target.schema[plan.target_name[c]].dataType
        types[c] = common_type(a, b)
        if types[c] is None:
            # No type holds both exactly: keys become text, values keep the source's type beside a text.
            types[c] = T.StringType() if c in plan.keys else a
            texts.add(c)

    def project(df: DataFrame, name: dict[str, str], own: bool) -> DataFrame:
        out = []
        for c in plan.keys + plan.values:
            dtype = df.schema[name.get(c, c)].dataType
            col = F.col(f"`{name.get(c, c)}`")
            if c in texts and c in plan.values:
                out.append(exact_text(col, dtype).alias(_FORM + c))
                col = col.try_cast(types[c]) if dtype != types[c] else col
            elif c in texts:
                col = exact_text(col, dtype)
            elif dtype != types[c]:
                col = col.cast(types[c])
            out.append(col.alias(c))
        if own:
            out += [F.col(f"`{c}`") for c in plan.carried]
        side = df.select(*out)
        if options.pair_duplicates:
            # Compared columns decide first, so that positions are those of the compare.
            order = [f for c in plan.values for f in ([_FORM + c, c] if c in texts else [c])]
            side = number_occurrences(side, plan.keys, order + (list(plan.carried) if own else []))
        return side

    return project(source, {}, True), project(target, plan.target_name, False), types


#: Prefix of the text in which a column is compared.
_FORM = "_form_of_"


def _key_condition(keys: Sequence[str], null_safe: bool, left: str = "l", right: str = "r") -> Column:
    cond = None
    for k in keys:
        a, b = F.col(f"{left}.`{k}`"), F.col(f"{right}.`{k}`")
        one = a.eqNullSafe(b) if null_safe and k != "occ" else a == b
        cond = one if cond is None else cond & one
    return cond


def diff_rows(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    options: RowDiffOptions = RowDiffOptions(),
    computed: Iterable[str] = (),
) -> RowDiff:
    """Match rows by key and say for each whether it is missing, extra, different or equal."""
    plan = _require(plan_columns(source.schema, target.schema, keys, computed))
    left, right, types = _sides(source, target, plan, options)
    on = list(plan.keys) + (["occ"] if options.pair_duplicates else [])
    # A literal marks presence: a nullable data column cannot.
    joined = left.withColumn("_in", F.lit(True)).alias("l").join(
        right.withColumn("_in", F.lit(True)).alias("r"), _key_condition(on, options.null_safe_keys), "full_outer"
    )
    in_source, in_target = F.col("l._in").isNotNull(), F.col("r._in").isNotNull()

    def differs(c: str) -> Column:
        return _differs(left, c, types[c])

    def packed(side: str, present: Column) -> Column:
        columns = plan.values + (plan.carried if side == "l" else ())
        if not columns:
            return F.when(present, F.struct(F.lit(True).alias("present")))
        return F.when(present, F.struct(*[F.col(f"{side}.`{c}`").alias(c) for c in columns]))

    any_change = F.lit(False)
    for c in plan.values:
        any_change = any_change | differs(c)
    changed = (
        F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in plan.values]))
        if plan.values
        else F.array().cast("array<string>")
    )
    df = joined.select(
        *[F.coalesce(F.col(f"l.`{k}`"), F.col(f"r.`{k}`")).alias(k) for k in on],
        F.when(~in_target, "missing")
        .when(~in_source, "extra")
        .when(any_change, "different")
        .otherwise("equal")
        .alias("status"),
        F.when(in_source & in_target, changed).otherwise(F.array().cast("array<string>")).alias("changed"),
        packed("l", in_source).alias("s"),
        packed("r", in_target).alias("t"),
    )
    return RowDiff(df, plan.keys, plan.values, types, options, plan)


def _differs(side: DataFrame, c: str, dtype: T.DataType) -> Column:
    """Whether column `c` of the joined sides l and r differs."""
    if _FORM + c in side.columns:
        a, b = (F.col(f"{s}.`{_FORM + c}`") for s in "lr")
    else:
        a, b = (comparable(F.col(f"{s}.`{c}`"), dtype) for s in "lr")
    return ~a.eqNullSafe(b)


def row_status(diff: RowDiff) -> DataFrame:
    return diff.df.select(*diff.key_columns, "status")


def changed_columns(diff: RowDiff) -> DataFrame:
    """Rows that differ, with the names of the columns that do."""
    return diff.df.filter(F.col("status") == "different").select(
        *diff.key_columns, F.array_join("changed", ",").alias("changed")
    )


def summarize(diff: RowDiff, table: str) -> DataFrame:
    """One row of counts for the table."""

    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    counts = diff.df.agg(
        count("missing").alias("missing"),
        count("extra").alias("extra"),
        count("different").alias("different"),
        count("equal").alias("equal"),
    )
    changes = F.col("missing") + F.col("extra") + F.col("different")
    return counts.select(
        F.lit(table).alias("table_name"), "missing", "extra", "different", "equal", (changes > 0).alias("has_changes")
    )


@dataclass(frozen=True)
class TablePair:
    name: str
    source: DataFrame
    target: DataFrame
    keys: Sequence[str]
    computed: tuple[str, ...] = ()


def diff_tables(pairs: Sequence[TablePair], options: RowDiffOptions = RowDiffOptions()) -> DataFrame:
    """Counts of many tables in one job; a table that cannot be compared keeps its reason."""
    parts = []
    for pair in pairs:
        plan = plan_columns(pair.source.schema, pair.target.schema, pair.keys, pair.computed)
        if plan.error:
            spark = pair.source.sparkSession
            zero = [F.lit(0).cast("long").alias(c) for c in ("missing", "extra", "different", "equal")]
            parts.append(
                spark.range(1).select(
                    F.lit(pair.name).alias("table_name"), *zero, F.lit(False).alias("has_changes"),
                    F.lit(plan.error).alias("note"),
                )
            )
            continue
        counts = summarize(diff_rows(pair.source, pair.target, pair.keys, options, pair.computed), pair.name)
        parts.append(counts.withColumn("note", F.when(F.col("has_changes"), "").otherwise("in sync")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def diff_tables_to(pairs: Sequence[TablePair], path: str, options: RowDiffOptions = RowDiffOptions(), batch: int = 25) -> None:
    """The same for any number of tables: batches of them, each a job of its own, appended to the
    Parquet folder `path`, so that no plan holds more than `batch` tables."""
    for at in range(0, len(pairs), batch):
        diff_tables(pairs[at : at + batch], options).write.mode("append").parquet(path)


def _one_sided(
    source: DataFrame, target: DataFrame, keys: Sequence[str], options: RowDiffOptions, how: str, swap: bool
) -> DataFrame:
    plan = _require(plan_columns(source.schema, target.schema, keys))
    left, right, _ = _sides(source, target, plan, options)
    if swap:
        left, right = right, left
    on = list(plan.keys) + (["occ"] if options.pair_duplicates else [])
    shown = left.select(*[c for c in left.columns if not c.startswith(_FORM)])
    return shown.alias("l").join(right.select(*on).alias("r"), _key_condition(on, options.null_safe_keys), how)


def missing_rows(source, target, keys, options: RowDiffOptions = RowDiffOptions()) -> DataFrame:
    """Source rows whose key the target lacks."""
    return _one_sided(source, target, keys, options, "left_anti", swap=False)


def extra_rows(source, target, keys, options: RowDiffOptions = RowDiffOptions()) -> DataFrame:
    """Target rows whose key the source lacks."""
    return _one_sided(source, target, keys, options, "left_anti", swap=True)


def shared_rows(source, target, keys, options: RowDiffOptions = RowDiffOptions()) -> DataFrame:
    """Source rows whose key the target has."""
    return _one_sided(source, target, keys, options, "left_semi", swap=False)


def matched_rows(source, target, keys, options: RowDiffOptions = RowDiffOptions()) -> DataFrame:
    """Keys on both sides with both versions of each compared column."""
    plan = _require(plan_columns(source.schema, target.schema, keys))
    left, right, types = _sides(source, target, plan, options)
    on = list(plan.keys) + (["occ"] if options.pair_duplicates else [])
    joined = left.alias("l").join(right.alias("r"), _key_condition(on, options.null_safe_keys), "inner")
    different = F.lit(False)
    for c in plan.values:
        different = different | _differs(left, c, types[c])
    return joined.select(
        *[F.col(f"l.`{k}`").alias(k) for k in on],
        *[F.col(f"l.`{c}`").alias(f"source_{c}") for c in plan.values],
        *[F.col(f"r.`{c}`").alias(f"target_{c}") for c in plan.values],
        F.when(different, "different").otherwise("equal").alias("status"),
    )


def change_feed(diff: RowDiff, options: RowDiffOptions | None = None) -> DataFrame:
    """The changes that turn target into source: op, keys, before, after, changed."""
    options = options or diff.options
    status = F.col("status")
    wanted = status.isin("missing", "different", "extra") if options.include_deletes else status.isin(
        "missing", "different"
    )
    op = F.when(status == "missing", "insert").when(status == "extra", "delete").otherwise("update")
    return diff.df.filter(wanted).select(
        op.alias("op"), *diff.key_columns, F.col("t").alias("before"), F.col("s").alias("after"), "changed"
    )


def apply_changes(
    source: DataFrame,
    target: DataFrame,
    keys: Sequence[str],
    options: RowDiffOptions = RowDiffOptions(),
    computed: Iterable[str] = (),
) -> DataFrame:
    """The target as it is after the sync, in the target's own columns and types: the change feed
    of the compare, applied to the target. Write the result to a new place, never over the table being read."""
    diff = diff_rows(source, target, keys, options, computed)
    return apply_feed(target, change_feed(diff), diff)


def apply_feed(target: DataFrame, feed: DataFrame, diff: RowDiff) -> DataFrame:
    """`target` after the changes in `feed`, which is the change feed of `diff` or a landed copy of it.

    Rows that the feed doesn't mention stay as they are, in all columns. Inserted and updated rows take
    the source's value in every column that both sides have, computed ones included; columns that
    only the target has keep their value, and are null in inserted rows."""
    plan, options = diff.plan, diff.options
    on, to_source = diff.key_columns, {t: s for s, t in plan.target_name.items()}
    # Keys in the type of the compare, beside the target's own columns.
    key = {k: f"_key_{k}" for k in on}
    rows = target.withColumns({key[k]: _form(target, plan.target_name[k], diff.types[k]) for k in plan.keys})
    if options.pair_duplicates:
        # The positions that the compare gave; what it didn't compare decides last.
        forms = {f"_value_{c}": _form(target, plan.target_name[c], diff.types[c]) for c in plan.values}
        rows = number_occurrences(rows.withColumns(forms), [key[k] for k in plan.keys], [*forms, *target.columns], key["occ"])
    rows = rows.withColumn("_in", F.lit(True))
    cond = F.lit(True)
    for k in on:
        a, b = F.col(f"t.`{key[k]}`"), F.col(f"f.`{k}`")
        cond = cond & (a.eqNullSafe(b) if options.null_safe_keys and k != "occ" else a == b)
    nameless, deletes = None, feed
    if not options.null_safe_keys:
        # A null key equals none, so the feed deletes such rows of the target one and all. They are matched
        # apart and null-safely; equality alone would leave them, and it keeps bucketed sides in place.
        in_target, in_feed = (_any_null([names[k] for k in plan.keys]) for names in (key, {k: k for k in plan.keys}))
        unkeyed = in_feed & (F.col("op") == "delete")
        gone = feed.where(unkeyed).select(*[F.col(f"`{k}`") for k in on]).distinct()
        same = F.lit(True)
        for k in on:
            same = same & F.col(f"t.`{key[k]}`").eqNullSafe(F.col(f"g.`{k}`"))
        nameless = rows.where(in_target).alias("t").join(gone.alias("g"), same, "left_anti").select(*[F.col(f"t.`{c}`") for c in target.columns])
        rows, deletes = rows.where(~in_target), feed.where(~unkeyed)
    joined = rows.alias("t").join(deletes.alias("f"), cond, "full_outer")
    joined = joined.where(F.col("f.op").isNull() | (F.col("f.op") != "delete"))
    written, out = F.col("f.op").isNotNull(), []
    for f in target.schema.fields:
        stays, name = F.col(f"t.`{f.name}`"), to_source.get(f.name)
        if name is None:
            value = stays
        elif name in plan.keys:
            value = F.when(F.col("t._in").isNull(), F.col(f"f.`{name}`").cast(f.dataType)).otherwise(stays)
        else:
            value = F.when(written, F.col("f.after")[name].cast(f.dataType)).otherwise(stays)
        out.append(value.alias(f.name))
    return joined.select(*out) if nameless is None else joined.select(*out).union(nameless)


def _any_null(names: Sequence[str]) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | F.col(f"`{name}`").isNull()
    return found


def _form(rows: DataFrame, name: str, dtype: T.DataType) -> Column:
    """A column as `_sides` compares it."""
    own, col = rows.schema[name].dataType, F.col(f"`{name}`")
    if own == dtype:
        return col
    if isinstance(own, T.NumericType) and (isinstance(dtype, T.StringType) or common_type(own, dtype) is None):
        return exact_text(col, own)
    return col.cast(dtype)
