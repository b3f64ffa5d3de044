"""Text normalisation used by every comparison of definitions and expressions.

All functions map columns to columns and stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode White_Space characters.
WHITESPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def collapse_whitespace(text: Column) -> Column:
    """Every run of whitespace becomes one space; none is left at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_module(text: Column, collapse: bool = True) -> Column:
    """Comparable form of a view, routine or trigger body. NULL counts as empty."""
    if collapse:
        return F.coalesce(collapse_whitespace(text), F.lit(""))
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    trimmed = F.transform(lines, lambda line: F.rtrim(line, F.lit(WHITESPACE)))
    return F.coalesce(F.trim(F.array_join(trimmed, "\n"), F.lit("\n")), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it by name in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_of(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _wrapping_pairs(text: Column) -> Column:
    """How many pairs of parentheses wrap the whole of a text.

    It is the least of three counts: opening parentheses at the front, closing ones at the
    back, and the lowest nesting depth reached between them. One pass over the
    parentheses finds it, so there is no limit on the depth.
    """

    def count(ends: Column) -> Column:
        front, back = ends["front"], ends["back"]
        opened, closed = _count_of(front, "("), _count_of(back, ")")
        inner_length = F.length(text) - F.length(front) - F.length(back)
        inner = F.substring(text, F.length(front) + 1, F.greatest(inner_length, F.lit(0)))
        marks = F.filter(F.split(F.regexp_replace(inner, r"[^()]", ""), ""), lambda c: c != "")

        def step(state: Column, mark: Column) -> Column:
            depth = state["depth"] + F.when(mark == "(", 1).otherwise(-1)
            return F.struct(depth.alias("depth"), F.least(state["low"], depth).alias("low"))

        start = F.struct(opened.alias("depth"), opened.alias("low"))
        return let(
            F.aggregate(marks, start, step),
            lambda walk: F.when(walk["depth"] - closed < 0, F.lit(0)).otherwise(
                F.greatest(F.least(opened, closed, walk["low"]), F.lit(0))
            ),
        )

    front = F.regexp_extract(text, r"^[( ]*", 0).alias("front")
    back = F.regexp_extract(text, r"[) ]*$", 0).alias("back")
    return let(F.struct(front, back), count)


def _without(text: Column, pairs: Column) -> Column:
    """The text inside its outermost parentheses, `pairs` levels deep."""
    skip = F.length(F.call_function("substring_index", text, F.lit("("), pairs)) + 1
    cut = F.length(F.call_function("substring_index", text, F.lit(")"), -pairs)) + 1
    return F.trim(F.substring(text, skip + 1, F.greatest(F.length(text) - skip - cut, F.lit(0))))


def strip_outer_parens(text: Column) -> Column:
    """Drop parentheses that wrap the whole text, however many there are."""

    def stripped(flat: Column) -> Column:
        inside = let(
            _wrapping_pairs(flat), lambda pairs: F.when(pairs > 0, _without(flat, pairs)).otherwise(flat)
        )
        return F.when(flat.startswith("(") & flat.endswith(")"), inside).otherwise(flat)

    return let(text, stripped)


def normalize_expression(text: Column) -> Column:
    """Comparable form of a default, check or computed expression. Blank and NULL give ''."""
    return strip_outer_parens(F.lower(collapse_whitespace(F.coalesce(text, F.lit("")))))


def base_type(type_text: Column) -> Column:
    """Type name without its length or precision."""
    return F.lower(F.trim(F.substring_index(type_text, "(", 1), F.lit(WHITESPACE)))


def create_or_alter(definition: Column) -> Column:
    """Turn the first CREATE of a module into CREATE OR ALTER; one already there stays."""
    return F.regexp_replace(
        definition,
        r"(?is)^(.*?)\bCREATE\s+(?:OR\s+ALTER\s+)?(?=(?:VIEW|PROC(?:EDURE)?|FUNCTION|TRIGGER)\b)",
        "$1CREATE OR ALTER ",
    )


def routine_name(name: Column) -> Column:
    return F.substring_index(name, "(", 1)


def routine_arguments(name: Column) -> Column:
    """The '(…)' part of a routine name, or '()' where there is none."""
    at = F.instr(name, "(")
    return F.when(at == 0, F.lit("()")).otherwise(F.substring(name, at, F.length(name)))


def split_parent(parent: Column) -> tuple[Column, Column]:
    """Schema and table of 'schema.table', cut at the first dot; schema is NULL without one."""
    at = F.instr(parent, ".")
    schema = F.when(at > 0, F.substring(parent, F.lit(1), at - 1))
    table = F.when(at > 0, F.substring(parent, at + 1, F.length(parent))).otherwise(F.coalesce(parent, F.lit("")))
    return schema, table


def details_preview(first_four: Column, total: Column) -> Column:
    """The first four details on one line, then how many more there are."""
    shown = F.array_join(F.slice(first_four, 1, 4), "; ")
    return F.when(total > 4, F.concat(shown, F.lit(" … (+"), (total - 4).cast("string"), F.lit(")"))).otherwise(shown)
