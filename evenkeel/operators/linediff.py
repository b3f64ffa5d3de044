"""Which lines of two versions of a text were deleted, inserted or kept."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(source: DataFrame, target: DataFrame, keys: list[str], text: str) -> DataFrame:
    """All lines of both versions, tagged with their side. The versions need no join: equal
    lines meet when lines are grouped by key and line."""

    def split(df: DataFrame, side: int) -> DataFrame:
        lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n", -1)
        return df.select(*keys, F.lit(side).alias("side"), F.posexplode(lines).alias("line_no", "line"))

    return split(source, 0).unionByName(split(target, 1))


def line_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], text: str = "definition") -> DataFrame:
    """One row per line: keys, line_no from 0 in its own version, line, status.

    Equal lines pair up in order of appearance; a kept line is listed once, where the
    source has it. A group holds the equal lines of one object, so no more than two texts.
    """
    keys = list(keys)
    same = Window.partitionBy(*keys, "line")
    rows = _lines(source, target, keys, text).select(
        *keys,
        "side",
        "line_no",
        "line",
        F.row_number().over(Window.partitionBy(*keys, "line", "side").orderBy("line_no")).alias("_occ"),
        F.least(F.count_if(F.col("side") == 0).over(same), F.count_if(F.col("side") == 1).over(same)).alias("_both"),
    )
    status = F.when(F.col("_occ") <= F.col("_both"), "unchanged").when(F.col("side") == 0, "deleted").otherwise("inserted")
    kept_twice = (F.col("status") == "unchanged") & (F.col("side") == 1)
    return rows.withColumn("status", status).filter(~kept_twice).select(*keys, "line_no", "line", "status")


def line_diff_summary(
    source: DataFrame, target: DataFrame, keys: Sequence[str], text: str = "definition"
) -> DataFrame:
    """Line counts per object. Equal lines are counted before the shuffle."""
    keys = list(keys)
    counted = _lines(source, target, keys, text).groupBy(*keys, "line").agg(
        F.count_if(F.col("side") == 0).alias("s"), F.count_if(F.col("side") == 1).alias("t")
    )
    zero = F.lit(0)
    return counted.groupBy(*keys).agg(
        F.sum(F.greatest(F.col("s") - F.col("t"), zero)).alias("deleted"),
        F.sum(F.greatest(F.col("t") - F.col("s"), zero)).alias("inserted"),
        F.sum(F.least("s", "t")).alias("unchanged"),
    )


#: Symbols that occur more often than this keep their mask, so that masks stay small together.
_OFTEN = 64


def _lengths(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> np.ndarray:
    """Lengths of the longest common subsequences of `a` with every beginning of `b`, by rows of bits."""
    places: dict[int, list[int]] = {}
    for place, (_, symbol) in enumerate(b):
        places.setdefault(symbol, []).append(place)
    masks: dict[int, int] = {}
    full = (1 << len(b)) - 1
    row = full
    for _, symbol in a:
        mask = masks.get(symbol)
        if mask is None:
            mask = 0
            for place in places.get(symbol, ()):
                mask |= 1 << place
            if len(places.get(symbol, ())) > _OFTEN:
                masks[symbol] = mask
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _align(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence of two lists of (place, symbol), ascending."""
    short, head, tail = min(len(a), len(b)), 0, 0
    while head < short and a[head][1] == b[head][1]:
        head += 1
    while tail < short - head and a[-1 - tail][1] == b[-1 - tail][1]:
        tail += 1
    start = [(x, y) for (x, _), (y, _) in zip(a[:head], b[:head])]
    end = [(x, y) for (x, _), (y, _) in zip(a[len(a) - tail :], b[len(b) - tail :])]
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    known = {symbol for _, symbol in b}
    a = [x for x in a if x[1] in known]
    known = {symbol for _, symbol in a}
    b = [y for y in b if y[1] in known]
    if len(a) == 1:
        start.append((a[0][0], b[0][0]))
    elif a:
        half = len(a) // 2
        total = _lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]
        cut = int(np.argmax(total))
        start += _align(a[:half], b[:cut]) + _align(a[half:], b[cut:])
    return start + end


def edit_script(source: list[str], target: list[str]) -> list[tuple[int | None, int | None]]:
    """(line of the source, line of the target) in order of display: both for a kept line, one for others.

    As many lines as possible are kept, in the order both versions have them. Of several such choices
    the halves of the source decide: each takes as few lines of the target as it can. Between two
    kept lines, deleted ones come before inserted ones. Memory is proportional to the lines, time to
    the product of the numbers of lines that differ, in words of 64.
    """
    symbols: dict[str, int] = {}
    a, b = ([(i, symbols.setdefault(line, len(symbols))) for i, line in enumerate(side)] for side in (source, target))
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for x, y in [*_align(a, b), (len(a), len(b))]:
        out += [(k, None) for k in range(i, x)] + [(None, k) for k in range(j, y)]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def ordered_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], text: str = "definition") -> DataFrame:
    """One row per line in order of display: keys, position from 0, source_no, target_no, line, status.

    Unlike `line_diff`, a line that moved is deleted in one place and inserted in another. Keys are unique on
    either side and null keys are equal; a missing row or null text has no lines. Both versions of an object meet in one
    row, and each batch of such rows is compared where it lies.
    """
    keys = list(keys)
    sides = [df.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.regexp_replace(text, "\r\n?", "\n").alias(side)) for df, side in ((source, "_s"), (target, "_t"))]
    names = [f"_k{n}" for n in range(len(keys))]
    same = reduce(and_, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in names))
    both = sides[0].alias("l").join(sides[1].alias("r"), same, "full_outer")
    both = both.select(*[F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in names], "_s", "_t")
    numbers = T.StructType([T.StructField(c, T.IntegerType()) for c in ("position", "source_no", "target_no")])
    schema = T.StructType([*both.select(names).schema.fields, *numbers.fields, T.StructField("line", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (s, t) in enumerate(zip(batch.column("_s").to_pylist(), batch.column("_t").to_pylist())):
                old, new = ([] if x is None else x.split("\n") for x in (s, t))
                script = edit_script(old, new)
                own = batch.select(names).take(pa.array([row] * len(script), pa.int64()))
                places = [pa.array(x, pa.int32()) for x in (range(len(script)), [x for x, _ in script], [y for _, y in script])]
                lines = pa.array([new[y] if x is None else old[x] for x, y in script], pa.string())
                yield pa.RecordBatch.from_arrays([*own.columns, *places, lines], schema.names)

    status = F.when(F.col("target_no").isNull(), "deleted").when(F.col("source_no").isNull(), "inserted").otherwise("unchanged")
    found = both.mapInArrow(run, schema).withColumn("status", status)
    return found.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "position", "source_no", "target_no", "line", "status")
