"""Licence scan: a trained classifier of paragraphs, with an unknown class and a look at templates.

Paragraphs end at blank lines; line breaks within them are white space, so that wrapped notices read as one. The word
pairs that templates have are looked up in every paragraph, whatever its length. From each of them a stretch goes on
while the next one is at most `gap` words away, up to `stretch` words: all places where a notice can lie, and short
ones, so that text around a notice does not weigh on it. Words and word pairs of a stretch are the features of a
multinomial logistic regression that tells licence families and an unknown class apart. It is trained by
gradient descent on the templates, on every variant of them that lacks one word, and on the stretches and runs of
`stretch` words of all documents that share no word triple with a template. Equal ones count as one row with a number; with more than
`batch` such rows the rounds take turns on equal parts of them, so that every document is learnt from. A third of the stretches and runs is held out: the share `unknown_quantile` of it must come out as unknown, which sets the
probability from which a family is believed. A prediction counts once a template of its family has most of its word
pairs in the stretch.

Training and scan are DataFrame functions. Features are the few hundred n-grams that templates have; weights are as
many rows of numbers, whatever the input. A stretch with fewer than `least_known` of them is unknown. Null and
empty texts have no paragraph. Rows that share an id are separate rows; a paragraph has one row per family.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm.common import col, landed

# Short notices by which works name their licence.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "Proprietary": ("All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited."),
}


@dataclass(frozen=True)
class LicenseRules:
    least_known: int = 3
    gap: int = 6
    stretch: int = 32
    rounds: int = 12
    rate: float = 4.0
    decay: float = 1e-4
    batch: int = 4096
    unknown_quantile: float = 0.999
    least_probability: float = 0.5
    least_template: float = 0.75


FAMILIES = [*TEMPLATES, "unknown"]
_UNKNOWN = len(FAMILIES) - 1


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _grams(size: int) -> Column:
    """Hashes of the runs of `size` words in the column `words`."""
    each = F.transform("words", lambda w, i: F.xxhash64(F.lit(size), w, *[F.get("words", i + k) for k in range(1, size)]))
    return F.slice(each, F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(0)))


def _literal(values, kind: str) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")  # folded to one literal


def _local(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows without Python workers."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(FAMILIES.index(family), n, text) for family, texts in TEMPLATES.items() for n, text in enumerate(texts)]
    return _local(spark, rows, ["family", "n", "text"]).withColumn("words", _words(F.col("text")))


class Vocabulary:
    """The words and word pairs of the templates, numbered, and the templates as numbers of pairs.

    A hash finds its number by its remainder; the divisor is the first one that keeps all known hashes apart."""

    def __init__(self, spark: SparkSession):
        rows = _templates(spark).select("family", _grams(1).alias("one"), _grams(2).alias("two"), _grams(3).alias("three")).collect()
        self.hashes = sorted({h for r in rows for h in [*r.one, *r.two]})
        number = {h: i for i, h in enumerate(self.hashes)}
        self.templates = [(r.family, sorted({number[h] for h in r.two})) for r in rows]
        self.triples = sorted({h for r in rows for h in r.three})
        self.divisor = len(number)
        while len({h % self.divisor for h in number}) < len(number):
            self.divisor += 1
        places = [-1] * self.divisor
        for h, i in number.items():
            places[h % self.divisor] = i
        self._places, self._known = _literal(places, "int"), _literal(self.hashes, "bigint")

    def number(self, h: Column) -> Column:
        """The number of a hash, null for an unknown one."""
        at = F.get(self._places, F.pmod(h, F.lit(self.divisor)).cast("int"))
        return F.when(F.get(self._known, at) == h, at)

    def numbers(self, hashes: Column) -> Column:
        return F.array_compact(F.transform(hashes, self.number))


def _only(rows: DataFrame, keep: list[str], condition: Column) -> DataFrame:
    """The rows that meet the condition, through a generator: the optimiser would copy what makes the columns into a filter's condition."""
    rows = rows.select(F.explode_outer(F.when(condition, F.array(F.struct(*keep)))).alias("x"))
    return rows.where("x is not null").select("x.*")


def _paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, id, paragraph, words) of every paragraph."""
    parts = F.split(F.coalesce(col(text).cast("string"), F.lit("")), r"\n[\x20\t\r\x0B\f]*\n", -1)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(key).alias("id"), parts.alias("parts"))
    rows = rows.select("row", "id", F.posexplode("parts").alias("paragraph", "part"))
    return rows.select("row", "id", "paragraph", _words(F.col("part")).alias("words"))


def _known(vocabulary: Vocabulary) -> Column:
    """The places of the known pairs in `words`."""
    numbers = F.transform(_grams(2), lambda h, i: F.struct(i.alias("at"), vocabulary.number(h).alias("number")))
    return F.transform(F.filter(numbers, lambda x: x["number"].isNotNull()), lambda x: x["at"])


def _spans(rules: LicenseRules) -> Column:
    """The stretches (first, last) that the places in `known` make, each by its first and last pair."""

    def end(first: Column, i: Column) -> Column:
        """The last known pair that is reached from the one at `first`."""
        later = F.slice("known", i + 1, F.lit(rules.stretch))
        return F.aggregate(later, first, lambda at, x: F.when((x - at <= rules.gap) & (x - first <= rules.stretch - 2), x).otherwise(at))

    spans = F.transform("known", lambda first, i: F.struct(first.alias("first"), end(first, i).alias("last")))
    return F.filter(spans, lambda x: x["last"] > x["first"])


def _stretches(paragraphs: DataFrame, vocabulary: Vocabulary, rules: LicenseRules) -> DataFrame:
    """The columns of `paragraphs`, with `words` cut to a stretch: one from every known pair that another follows closely."""
    keep = [c for c in paragraphs.columns if c != "words"]
    rows = paragraphs.withColumn("known", _known(vocabulary))
    rows = _only(rows, [*keep, "words", "known"], F.size("known") > 1)
    rows = rows.select(*keep, "words", F.explode(_spans(rules)).alias("span"))
    return rows.select(*keep, F.slice("words", F.col("span.first") + 1, F.col("span.last") - F.col("span.first") + 2).alias("words"))


def _negatives(docs: DataFrame, vocabulary: Vocabulary, rules: LicenseRules, key: str, text: str) -> DataFrame:
    """(family, held, features, total) of the stretches and of all runs of `stretch` words that share no word triple with a
    template. Words and pairs are looked up once for each paragraph; a triple can only be where two known pairs meet."""
    rows = _paragraphs(docs, key, text).select("words")
    rows = rows.select("words", F.transform(_grams(1), vocabulary.number).alias("one"), F.transform(_grams(2), vocabulary.number).alias("two"))
    places = F.filter(F.transform("two", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    rows = rows.select("words", "one", "two", places.alias("known"))
    triples = _literal(vocabulary.triples, "bigint")

    def shared(at: Column) -> Column:
        triple = F.xxhash64(F.lit(3), *[F.get("words", at + k) for k in range(3)])
        return F.when(F.get("two", at + 1).isNotNull(), F.array_contains(triples, triple)).otherwise(False)

    rows = rows.select("words", "one", "two", "known", F.filter("known", shared).alias("shared"))
    size = F.size("words")
    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1, F.lit(rules.stretch))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda at: F.struct(at.alias("first"), F.least(at + rules.stretch, size).alias("end")))
    spans = F.transform(_spans(rules), lambda x: F.struct(x["first"].alias("first"), (x["last"] + 2).alias("end")))
    clear = F.filter(F.concat(spans, runs), lambda x: ~F.exists("shared", lambda at: (at >= x["first"]) & (at + 3 <= x["end"])))
    rows = rows.select("words", "one", "two", F.explode(clear).alias("x"))
    first, length = F.col("x.first") + 1, F.col("x.end") - F.col("x.first")
    features = F.array_sort(F.array_compact(F.concat(F.slice("one", first, length), F.slice("two", first, length - 1))))
    held = F.pmod(F.xxhash64(F.slice("words", first, length)), F.lit(3)) == 0
    return rows.select(F.lit(_UNKNOWN).alias("family"), held.alias("held"), features.alias("features"), (2 * length - 1).alias("total"))


def _featured(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Adds `features`, the numbers of known n-grams, and `total`, the number of all n-grams."""
    rows = rows.withColumn("all", F.concat(_grams(1), _grams(2)))
    return rows.withColumns({"features": vocabulary.numbers(F.col("all")), "total": F.size("all")}).drop("all")


@dataclass(frozen=True)
class LicenseModel:
    vocabulary: Vocabulary
    weights: list[list[float]]  # by feature, then family
    bias: list[float]
    least_probability: float


def _probabilities(weights: list[list[float]], bias: list[float]) -> Column:
    """The probability of each family, in order: all logits in one pass over the features."""
    n = len(bias)
    flat = _literal([w for row in weights for w in row], "double")
    sums = F.aggregate(
        "features",
        F.array_repeat(F.lit(0.0), n),
        lambda acc, f: F.zip_with(acc, F.slice(flat, f * n + 1, F.lit(n)), lambda x, w: x + w),
    )
    scale = F.sqrt(F.greatest(F.col("total"), F.lit(1)))
    logits = F.zip_with(sums, _literal(bias, "double"), lambda x, b: F.greatest(F.lit(-30.0), F.least(F.lit(30.0), b + x / scale)))
    return F.transform(logits, F.exp)


def _shares(p: str) -> Column:
    return F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda a, y: a + y))


def fit(docs: DataFrame, rules: LicenseRules, key: str = "doc_id", text: str = "text") -> LicenseModel:
    """Train on templates and on all of `docs`."""
    spark = docs.sparkSession
    vocabulary, templates = Vocabulary(spark), _templates(spark)
    position = F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("gone")
    variants = templates.select("family", "words", position).select(
        "family", F.filter("words", lambda w, i: i != F.col("gone")).alias("words"), F.lit(False).alias("held")
    )
    variants = _featured(variants, vocabulary).select("family", "held", F.array_sort("features").alias("features"), "total")
    rows = variants.union(_negatives(docs, vocabulary, rules, key, text))
    rows = landed(rows.groupBy("family", "held", "features", "total").agg(F.count(F.lit(1)).alias("n")), "license-training")
    batches = max(1, min(rules.rounds, rows.where("not held").count() // rules.batch))
    # Templates are in every batch whole, frequent rows with an equal share, and any other row in one of them.
    known, often = F.col("family") != _UNKNOWN, F.col("n") >= batches
    part = F.when(known | often, -1).otherwise(F.pmod(F.xxhash64("features", "total"), F.lit(batches))).alias("part")
    share = F.when(~known & often, F.col("n") / batches).otherwise(F.col("n")).alias("n")
    trained = rows.where("not held").select("family", "features", "total", share, part)
    counts = trained.groupBy("part", "family").agg(F.sum("n").alias("n")).collect()
    weights, bias = [[0.0] * len(FAMILIES) for _ in vocabulary.hashes], [0.0] * len(FAMILIES)
    for i in range(rules.rounds):
        own = Counter()
        for r in counts:
            own[r.family] += r.n * (r.part in (-1, i % batches))
        step(trained.where(F.col("part").isin(-1, i % batches)), {k: n for k, n in own.items() if n}, weights, bias, rules)
    held = rows.where("held").select("n", _probabilities(weights, bias).alias("p")).select("n", _shares("p").alias("p"))
    # Six decimals, as the cut has: no more than a million values.
    believed = held.groupBy(F.round(F.array_max(F.slice("p", 1, _UNKNOWN)), 6).alias("b")).agg(F.sum("n").alias("n"))
    cut = believed.agg(F.percentile("b", F.lit(rules.unknown_quantile), F.col("n"))).first()[0]
    return LicenseModel(vocabulary, weights, bias, max(rules.least_probability, round(cut or 0.0, 6)))


def step(rows: DataFrame, counts: dict[int, int], weights: list[list[float]], bias: list[float], rules: LicenseRules) -> None:
    """One gradient step, in place; every family weighs the same. The sums have a row per weight at most."""
    share = reduce(lambda other, family: F.when(F.col("family") == family, 1.0 / (counts[family] * len(counts))).otherwise(other), counts, F.lit(0.0))
    p = rows.withColumn("p", _probabilities(weights, bias)).withColumn("p", _shares("p"))
    slope = F.transform("p", lambda x, k: (x - F.when(k == F.col("family"), 1.0).otherwise(0.0)) * share * F.col("n"))
    each = p.select("features", "total", F.posexplode(slope).alias("k", "slope"))
    flat = each.select("k", "slope", F.explode(F.concat(F.array(F.lit(-1)), "features")).alias("feature"), "total")
    size = F.when(F.col("feature") < 0, 1.0).otherwise(1 / F.sqrt(F.greatest("total", F.lit(1))))
    for k, feature, total in flat.groupBy("k", "feature").agg(F.sum(F.col("slope") * size)).collect():
        if feature < 0:
            bias[k] = round(bias[k] - rules.rate * total, 5)
        else:
            weights[feature][k] = round(weights[feature][k] * (1 - rules.decay) - rules.rate * len(FAMILIES) * total, 5)


def scan(docs: DataFrame, model: LicenseModel, rules: LicenseRules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, paragraph, family, probability, template_share) of every paragraph that names a licence, a row per
    family, with the best of its stretches."""
    rows = _stretches(_paragraphs(docs, key, text), model.vocabulary, rules)
    rows = _only(_featured(rows, model.vocabulary), ["row", "id", "paragraph", "features", "total"], F.size("features") >= rules.least_known)
    rows = rows.withColumn("p", _probabilities(model.weights, model.bias)).withColumn("p", _shares("p"))
    rows = rows.withColumns({"probability": F.array_max("p"), "best": F.array_position("p", F.array_max("p")).cast("int") - 1})
    share = [
        F.when(F.col("best") == family, F.size(F.array_intersect("features", _literal(pairs, "int"))) / len(pairs)).otherwise(0.0)
        for family, pairs in model.vocabulary.templates
        if pairs
    ]
    rows = rows.withColumn("template_share", F.greatest(*share))
    said = F.col("best") != _UNKNOWN
    rows = rows.where(said & (F.col("probability") >= model.least_probability) & (F.col("template_share") >= rules.least_template))
    best = rows.groupBy("row", "paragraph", "best").agg(F.first("id").alias("id"), F.max("probability").alias("probability"), F.max("template_share").alias("template_share"))
    name = F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("best") + 1)
    return best.select("id", "paragraph", name.alias("family"), F.round("probability", 4).alias("probability"), F.round("template_share", 4).alias("template_share"))
