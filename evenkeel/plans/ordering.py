"""Creation order of code objects: a definition that mentions a name comes after it.

Input rows: pair_id, kind, name, definition, input_ord, where (pair_id, input_ord) is
unique. Only objects of one kind in one pair of databases are ordered against each other.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.plans.lineage import landed

_GRAM = 4
_BITS = 1 << 20
_GROUP = ["pair_id", "kind"]

# The order in which kinds are created.
KIND_ORDER = {"function": 0, "view": 1, "procedure": 2, "trigger": 3}


def kind_order(kind: Column) -> Column:
    out = F.lit(len(KIND_ORDER))
    for name, position in KIND_ORDER.items():
        out = F.when(F.lower(kind) == name, position).otherwise(out)
    return out


def _grams(value: Column, size: Column) -> Column:
    """Distinct substrings of the given size; empty if the value is shorter."""
    pattern = F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))"))
    return F.array_distinct(F.regexp_extract_all(value, pattern, F.lit(1)))


def _filter(pieces: DataFrame) -> tuple[list[int], Callable[[Column], Column]]:
    """The sizes of the pieces of names, and a test that every such piece passes and most others don't: a table of
    2^20 bits by hash, whatever the number of names."""
    at = F.xxhash64("_gram").bitwiseAND(F.lit(_BITS - 1))
    bit = F.expr("shiftleft(1L, cast(_at & 63 as int))")
    sized = pieces.select("_size", at.alias("_at")).distinct()
    rows = sized.groupBy(F.shiftright("_at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.collect_set("_size").alias("sizes")).collect()
    words, sizes = [0] * (_BITS // 64), set()
    for r in rows:
        words[r.word] = r.bits
        sizes.update(r.sizes)
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal

    def test(piece: Column) -> Column:
        at = F.xxhash64(piece).bitwiseAND(F.lit(_BITS - 1))
        return F.getbit(F.get(table, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1

    return sorted(sizes), test


def mentions(objects: DataFrame) -> DataFrame:
    """Pairs (input_ord, needs) where the definition contains the name, ignoring case.

    A name can only occur where every four-letter piece of it does. Of those pieces the
    rarest one in the group is the join key; the text itself then decides. No pair of
    objects is formed that does not share this piece.
    """
    named = objects.filter(F.length("name") > 0).select(
        *_GROUP, F.col("input_ord").alias("needs"), F.upper("name").alias("_name")
    )
    named = named.withColumn("_size", F.least(F.length("_name"), F.lit(_GRAM)))
    texts = objects.select(*_GROUP, "input_ord", F.upper("definition").alias("_text"))
    in_name = named.select(*_GROUP, "needs", "_size", F.explode(_grams(F.col("_name"), F.col("_size"))).alias("_gram"))
    sizes, may_be_known = _filter(in_name)
    # Pieces that no name of the fleet has go before the text is taken apart, the other groups' in the join.
    pieces = [F.filter(_grams(F.col("_text"), F.lit(size)), may_be_known) for size in sizes]
    pieces = F.concat(*pieces) if pieces else F.array().cast("array<string>")
    in_text = texts.select(*_GROUP, "input_ord", F.explode(pieces).alias("_gram"))
    known = in_name.select(*_GROUP, "_gram").distinct().hint("shuffle_hash")
    in_text = landed(in_text.join(known, _GROUP + ["_gram"], "left_semi"), "name-pieces")
    in_name = in_name.drop("_size")
    spread = in_text.groupBy(*_GROUP, "_gram").agg(F.count(F.lit(1)).alias("_texts"))
    rated = in_name.join(spread, _GROUP + ["_gram"], "left")
    anchor = rated.groupBy(*_GROUP, "needs").agg(
        F.min_by("_gram", F.struct("_texts", "_gram")).alias("_gram"),
        F.count_if(F.col("_texts").isNull()).alias("_absent"),
    )
    anchor = anchor.filter("_absent = 0").drop("_absent")
    candidates = anchor.join(in_text, _GROUP + ["_gram"]).filter(F.col("needs") != F.col("input_ord"))
    candidates = candidates.select(*_GROUP, "input_ord", "needs")
    checked = candidates.join(named.select(*_GROUP, "needs", "_name"), _GROUP + ["needs"])
    checked = checked.join(texts, _GROUP + ["input_ord"])
    return checked.filter(F.contains("_text", "_name")).select(*_GROUP, "input_ord", "needs")


def creation_levels(edges: DataFrame) -> DataFrame:
    """Level of every object that needs another: one more than the highest it needs.

    Each round takes away the edges whose needed object is free. A group in which a round takes away
    nothing has only cycles left, and what hangs on them: its first object is then set free. Groups go on by
    themselves, so that the levels of a pair don't depend on the other pairs of the fleet.
    Objects that do not appear have level 0.
    """
    left = landed(edges.distinct(), "edges-left")
    found: list[DataFrame] = []
    level = 0
    while not left.isEmpty():
        level += 1
        waiting = left.select(*_GROUP, "input_ord").distinct()
        found.append(waiting.withColumn("level", F.lit(level)))
        still = waiting.select(*_GROUP, F.col("input_ord").alias("needs"), F.lit(True).alias("_waits"))
        tried = left.join(still, _GROUP + ["needs"], "left")
        stuck = tried.groupBy(*_GROUP).agg(F.count("_waits").alias("_kept"), F.count(F.lit(1)).alias("_all"), F.min("input_ord").alias("input_ord"))
        freed = stuck.filter("_kept = _all").select(*_GROUP, "input_ord")
        left = landed(tried.filter("_waits").drop("_waits").join(freed, _GROUP + ["input_ord"], "left_anti"), "edges-left")
        if len(found) == 16:
            found = [landed(_highest(found), "levels")]
    if not found:
        return edges.select(*_GROUP, "input_ord").withColumn("level", F.lit(0)).limit(0)
    return _highest(found)


def _highest(parts: list[DataFrame]) -> DataFrame:
    stacked = reduce(DataFrame.unionByName, parts)
    return stacked.groupBy(*_GROUP, "input_ord").agg(F.max("level").alias("level"))


def creation_order(objects: DataFrame) -> DataFrame:
    """Add kind_ord and level. Create by (kind_ord, level, input_ord), drop in reverse."""
    return _with_levels(objects, creation_levels(mentions(objects)))


def creation_orders(sets: list[DataFrame]) -> list[DataFrame]:
    """`creation_order` of several sets of objects, each by itself, in the rounds of one."""

    def apart(i: int) -> Column:
        return F.concat(F.lit(f"{i} "), F.col("kind")).alias("kind")

    needed = ["name", "definition", "input_ord"]
    objects = reduce(DataFrame.unionByName, [s.select("pair_id", apart(i), *needed) for i, s in enumerate(sets)])
    levels = landed(creation_levels(mentions(landed(objects, "code-to-order"))), "creation-levels")
    own = [levels.filter(F.col("kind").startswith(f"{i} ")) for i in range(len(sets))]
    return [_with_levels(s, found.withColumn("kind", F.expr("substring(kind, instr(kind, ' ') + 1)"))) for s, found in zip(sets, own)]


def _with_levels(objects: DataFrame, levels: DataFrame) -> DataFrame:
    out = objects.join(levels, _GROUP + ["input_ord"], "left")
    return out.withColumn("kind_ord", kind_order(F.col("kind"))).withColumn(
        "level", F.coalesce(F.col("level"), F.lit(0))
    )
