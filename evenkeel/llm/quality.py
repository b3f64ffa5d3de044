"""Quality rules: plain counts, and a hashed n-gram likelihood ratio of target against raw corpus.

Tokens (runs of letters and digits, runs of symbols) and adjacent pairs of them fall into
`buckets` cells by hash. Two multinomials over the cells
are counted: one over the trusted-target documents, one over all documents. A document's score is
its mean log-likelihood ratio per n-gram; below the threshold it is rejected. Counting is one
explode with a map-side combine to at most `buckets` rows; the ratios then travel as one literal of
`buckets` numbers, and scoring is a projection without a shuffle. All of it is built-in functions.

A null text has no words. A text without n-grams has score 0. Without target documents all ratios are 0.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import WORD, col

TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]+"

#: Positions that the packed windows of `repeated_words` can tell apart.
_POSITIONS = 1 << 24


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    buckets: int = 8192
    smoothing: float = 1.0
    threshold: float = -0.2


def _words(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _window(i: Column) -> list[Column]:
    return [F.get("words", i + k) for k in range(3)]


def _meets(array: str, part):
    """Whether an element of a sorted array agrees in `part` with the one before or after it."""
    return lambda x, i: F.coalesce((part(F.get(array, i - 1)) == part(x)) | (part(F.get(array, i + 1)) == part(x)), F.lit(False))


def with_repeats(rows: DataFrame) -> DataFrame:
    """Adds `n_repeat_words` to rows with `words`: words in three-word windows that the text holds
    twice or more, the first included.

    Windows are first packed as (40 bits of hash, position) and sorted as plain longs; only those
    whose hash bits meet a neighbour's are then compared as words. The result is exact. Each array
    that a lambda looks into is a column of its own, so that it is made once a row."""
    keep = rows.columns
    index = F.when(F.size("words") > 3, F.sequence(F.lit(0), F.size("words") - 3)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_index", index)
    packed = F.transform("_index", lambda i: F.shiftleft(F.xxhash64(*_window(i)), 24).bitwiseOR(i.cast("long")))
    rows = rows.withColumn("_packed", F.sort_array(packed))
    alike = F.filter("_packed", _meets("_packed", lambda v: F.shiftright(v, 24)))
    low = F.transform(alike, lambda x: x.bitwiseAND(_POSITIONS - 1).cast("int"))
    rows = rows.withColumn("_alike", F.when(F.size("_index") < _POSITIONS, low).otherwise(F.col("_index")))
    # A tab joins the words, as no word holds one.
    windows = F.transform("_alike", lambda i: F.struct(F.concat_ws("\t", *_window(i)).alias("w"), i.alias("i")))
    rows = rows.withColumn("_windows", F.sort_array(windows))
    twice = F.filter("_windows", _meets("_windows", lambda v: v["w"]))
    rows = rows.withColumn("_starts", F.sort_array(F.transform(twice, lambda x: x["i"])))
    # Each start covers three words, fewer if the next start comes sooner.
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return rows.select(*keep, covered.alias("n_repeat_words"))


def duplicate_lines(text: str) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _tokens(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _cells(buckets: int) -> Column:
    """The cell of every token, and of every token with the one before it."""

    def cell(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")

    pairs = F.transform("tokens", lambda t, i: F.when(i > 0, cell(F.get("tokens", i - 1), t)))
    return F.concat(F.transform("tokens", lambda t: cell(t)), F.array_compact(pairs))


def fit(docs: DataFrame, trusted: DataFrame, rules: QualityRules, key: str = "doc_id", text: str = "text") -> list[float]:
    """log(target / raw) of every cell, smoothed. All rows of `docs` form the raw corpus; the target
    are all those whose key is among `trusted`.

    Texts meet the trusted keys before they are taken apart, by one plan at every size; rows without a key
    stay out of that join."""
    ids = trusted.select(col(key).alias("id")).where("id is not null").distinct().withColumn("target", F.lit(1))
    rows = docs.select(col(key).alias("id"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    known = rows.where("id is not null").join(ids.hint("merge"), "id", "left").select("target", "text")
    rows = known.union(rows.where("id is null").select(F.lit(None).cast("int").alias("target"), "text"))
    rows = rows.select("target", _tokens("text").alias("tokens")).select("target", _cells(rules.buckets).alias("cells"))
    # The outer form, as for the other one the optimiser copies what makes `cells` into a filter.
    grams = rows.select("target", F.explode_outer("cells").alias("cell"))
    counts = grams.where("cell is not null").groupBy("cell").agg(F.count("target"), F.count(F.lit(1)))
    return ratios({cell: (target, raw) for cell, target, raw in counts.collect()}, rules)  # a row per cell


def ratios(counts: dict[int, tuple[int, int]], rules: QualityRules) -> list[float]:
    target, raw = (sum(v[k] for v in counts.values()) for k in (0, 1))
    if not target:
        return [0.0] * rules.buckets
    s, b = rules.smoothing, rules.buckets
    pairs = (counts.get(cell, (0, 0)) for cell in range(b))
    return [round(math.log((t + s) / (target + s * b)) - math.log((r + s) / (raw + s * b)), 4) for t, r in pairs]


def measured(docs: DataFrame, weights: list[float], rules: QualityRules, text: str = "text") -> DataFrame:
    """One row per row of `docs`: `row`, the whole row as a struct, and its measures and verdict."""
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"words": _words("text"), "tokens": _tokens("text")})
    rows = rows.select(
        "row",
        "words",
        "tokens",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        duplicate_lines("text").alias("n_dup_lines"),
    )
    rows = with_repeats(rows).withColumn("_cells", _cells(rules.buckets)).drop("words", "tokens")
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate("_cells", F.lit(0.0), lambda acc, c: acc + F.get(table, c))
    rows = rows.withColumn("llr", F.when(F.size("_cells") > 0, F.round(total / F.size("_cells"), 6)).otherwise(0.0)).drop("_cells")
    failed = f"n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words"
    rows = rows.withColumn("base_failed", F.expr(failed))
    return rows.withColumn("kept", F.expr(f"not base_failed and llr >= {rules.threshold}D"))


def kept(docs: DataFrame, weights: list[float], rules: QualityRules, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass, as they were."""
    # An outer generator, not a filter: the optimiser would copy all measures into a filter's condition.
    rows = measured(docs, weights, rules, text).select(F.explode_outer(F.when(F.col("kept"), F.array("row"))).alias("row"))
    return rows.where("row is not null").select("row.*")
