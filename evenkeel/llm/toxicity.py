"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are positives; all other text is unlabelled, a mixture of both classes with
prior `pi`. A linear classifier over the presence of hashed features minimises the class-prior-corrected
risk  pi R+(p) + max(0, R-(u) - pi R-(p)) , whose second part estimates the risk on negatives and
is kept from turning negative (Kiryo et al., 2017). Features are whole tokens and the character
grams of tokens; those are kept whose share among positives differs most clearly from
the share that follows for negatives.

The classifier is fitted on at most `max_positive` and `max_unlabelled` labelled rows, chosen by hash, whose
texts are found with a broadcast of their ids; labels of unlabelled rows stay hidden but for the
prior. Every document is scored in one pass without a shuffle.

Null and empty texts have the score of a text without features. Without positives all scores are 0.
Rows that share an id are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import col, keyed
from evenkeel.llm.textwords import grams, words


@dataclass(frozen=True)
class ToxicityRules:
    bits: int = 18
    grams: tuple[int, ...] = (5,)
    features: int = 768
    least_z: float = 5.0
    max_positive: int = 4_000
    max_unlabelled: int = 12_000
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4
    threshold: float = 0.7


def buckets(text: str, rules: ToxicityRules) -> np.ndarray:
    """The hashed features of a text, repeats included."""
    _, _, whole = words(text)
    both = np.concatenate([whole, *(grams(text, n) for n in rules.grams)])
    return (both >> np.uint64(64 - rules.bits)).astype(np.int32)


@dataclass
class Classifier:
    slot: np.ndarray  # for each bucket its feature, or -1
    weight: np.ndarray
    bias: float

    def score(self, text: str, rules: ToxicityRules) -> float:
        slots = self.slot[buckets(text, rules)] if text else self.slot[:0]
        logit = self.bias + float(self.weight[np.unique(slots[slots >= 0])].sum())
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def selected(n_pos: np.ndarray, n_unl: np.ndarray, pos: int, unl: int, prior: float, rules: ToxicityRules) -> np.ndarray:
    """The buckets whose share among positives differs most from the share implied for negatives."""
    p = n_pos / max(pos, 1)
    n = np.clip((n_unl / max(unl, 1) - prior * p) / max(1 - prior, 1e-6), 0, 1)
    mid = (n_pos + n_unl + 1) / (pos + unl + 2)
    z = np.abs(p - n) / np.sqrt(mid * (1 - mid) * (1 / max(pos, 1) + 1 / max(unl, 1)))
    order = np.lexsort((np.arange(len(z)), -z))[: rules.features]
    return order[z[order] >= rules.least_z]


def train(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, rules: ToxicityRules) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the whole sample. Where the estimated risk on negatives is below
    zero, a step raises it instead."""

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    x = np.vstack([x_pos, x_unl]).astype(np.float32)
    n_pos, n_unl = len(x_pos), len(x_unl)
    w = np.zeros(x.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rules.steps + 1):
        g = x @ w[:-1].astype(np.float32) + w[-1]
        s = sigmoid(g)
        loss_neg = np.logaddexp(0, g)
        risk_neg = loss_neg[n_pos:].mean() - prior * loss_neg[:n_pos].mean()
        toward_neg = np.concatenate([-prior * s[:n_pos] / n_pos, s[n_pos:] / n_unl])
        if risk_neg < 0:
            slope = -toward_neg
        else:
            slope = toward_neg
            slope[:n_pos] += prior * (s[:n_pos] - 1) / n_pos
        grad = np.append(slope.astype(np.float32) @ x, slope.sum())
        grad[:-1] += rules.decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rules.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, rules: ToxicityRules, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Classifier:
    """Fit on the rows of `labels` (key, label of 0 or 1); give only those that may be learnt from."""
    rows = labels.select(col(key).alias("id"), col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    rows = rows.groupBy("id").agg(F.max("y").alias("y"))
    prior = rows.agg(F.avg("y")).first()[0] or 0.0
    none = Classifier(np.full(1 << rules.bits, -1, np.int32), np.zeros(0), -40.0)
    if prior == 0:
        return none
    by_hash = [F.xxhash64("id"), F.col("id")]
    positive = rows.where("y = 1").orderBy(*by_hash).limit(rules.max_positive).select("id", F.lit(True).alias("positive"))
    unlabelled = rows.orderBy(*by_hash).limit(rules.max_unlabelled).select("id", F.lit(False).alias("positive"))
    # At most max_positive + max_unlabelled ids: a safe hint.
    sample = keyed(docs, key, text).join(F.broadcast(positive.union(unlabelled)), "id")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, 1 << rules.bits), np.int32), [0, 0]
        for batch in batches:
            for positive, t in zip(batch.column(1).to_pylist(), batch.column(0)):
                counts[int(positive)][np.unique(buckets(t.as_py(), rules))] += 1
                n[int(positive)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at]), pa.array([n[1], *counts[1][at]]), pa.array([n[0], *counts[0][at]])], ["bucket", "p", "u"])

    sums = sample.select("text", "positive").mapInArrow(counted, "bucket bigint, p bigint, u bigint").groupBy("bucket").agg(F.sum("p"), F.sum("u"))
    table = np.zeros((2, (1 << rules.bits) + 1), np.int64)
    for bucket, p, u in sums.toArrow().to_pandas().itertuples(index=False):  # 2 ** bits rows at most
        table[:, bucket] = p, u
    pos, unl = table[:, -1].tolist()
    if not pos or not unl:
        return none
    prior = min(prior, 0.9)
    chosen = selected(table[0, :-1], table[1, :-1], pos, unl, prior, rules)
    slot = np.full(1 << rules.bits, -1, np.int32)
    slot[chosen] = np.arange(len(chosen))

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [slot[np.unique(buckets(t.as_py(), rules))] for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([f[f >= 0] for f in found], pa.list_(pa.int32()))], ["positive", "found"])

    drawn = sample.select("text", "positive").mapInArrow(slotted, "positive boolean, found array<int>").toArrow()
    x = np.zeros((drawn.num_rows, len(chosen)), np.float32)
    for k, found in enumerate(drawn.column("found")):
        x[k, found.values.to_numpy()] = 1
    is_positive = drawn.column("positive").to_numpy()
    weight, bias = train(x[is_positive], x[~is_positive], prior, rules)
    return Classifier(slot, weight, bias)


def scored(docs: DataFrame, model: Classifier, rules: ToxicityRules, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score) for every row."""
    rows = keyed(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t.as_py(), rules) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")
