"""Centroid clustering with an incremental distance matrix, in exact integers.

A component x becomes floor(scale * x). The state of a vector is its components and its dot products
with all centroids, written after every round. A round moves each centroid to the componentwise
floor of its vectors' mean; the dot products then change only by the components that have changed in each
centroid, and the nearest centroid follows from |x|^2 - 2 x.c + |c|^2 without another full product.
The sums of a round are one row per centroid; nothing else reaches the driver. A state goes when the one after it is written.

Vectors that are null, of another length, or hold null or non-finite components are not kept. Components beyond
+-2^27 after scaling count as that, so that distances fit into a long. A null id is hashed as an empty one. Rows
that share an id are separate rows; should two of them be first centroids, the one of smaller components
comes first. With fewer kept vectors than centroids there are as many centroids as vectors; without any, no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import col, dropped, landed

_MOST = 1 << 27


@dataclass(frozen=True)
class CentroidRules:
    centroids: int = 40
    rounds: int = 5
    dimensions: int = 64
    scale: int = 256
    seed: str = "2:"


def _integers(vectors: pa.Array, rules: CentroidRules) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the vectors that are kept, and their components."""
    n = rules.dimensions
    offsets = vectors.offsets.to_numpy()
    fit = np.flatnonzero((np.diff(offsets) == n) & vectors.is_valid().to_numpy(zero_copy_only=False))
    at = offsets[fit][:, None] + np.arange(n)
    flat = vectors.values
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    x = values[at] if len(values) else np.zeros((0, n))
    sound = np.isfinite(x).all(axis=1) & (known[at].all(axis=1) if len(values) else True)
    return fit[sound], np.clip(np.floor(x[sound] * rules.scale), -_MOST, _MOST).astype(np.int64)


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(matrix.ravel()))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def kept(rows: DataFrame, rules: CentroidRules, key: str, vector: str) -> DataFrame:
    """(id, x) of the vectors that are kept, as integers."""
    rows = rows.select(col(key).alias("id"), col(vector).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _integers(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _lists(x)], ["id", "x"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x array<bigint>")


def moved(dots: np.ndarray, x: np.ndarray, old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Dot products of `x` with the centroids `new`, from those with `old`: for each centroid only the
    components that differ are multiplied."""
    dots = dots.copy()
    for k in np.flatnonzero((old != new).any(axis=1)):
        at = np.flatnonzero(old[k] != new[k])
        dots[:, k] += x[:, at] @ (new[k, at] - old[k, at])
    return dots


def nearest(dots: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid, the smaller one of equals, and the squared distance."""
    far = (centroids**2).sum(axis=1) - 2 * dots
    cluster = far.argmin(axis=1)
    return cluster, far[np.arange(len(x)), cluster] + (x**2).sum(axis=1)


def _advance(rows: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """(id, x, dots, cluster, distance) for the centroids `new`; rows without `dots` start from centroids of zeros."""
    first = "dots" not in rows.columns
    rows = rows.select("id", "x") if first else rows.select("id", "x", "dots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            dots = np.zeros((len(x), len(new)), np.int64) if first else _matrix(batch.column(2))
            dots = moved(dots, x, old, new)
            cluster, distance = nearest(dots, x, new)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), _lists(dots), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["id", "x", "dots", "cluster", "distance"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, x array<bigint>, dots array<bigint>, cluster int, distance bigint")


def _means(state: DataFrame, centroids: np.ndarray, rules: CentroidRules) -> np.ndarray:
    """The floor of the mean of each cluster; empty clusters keep their centroid."""
    sums = [F.sum(F.get("x", F.lit(j))).alias(f"s{j}") for j in range(rules.dimensions)]
    new = centroids.copy()
    for cluster, n, *total in state.groupBy("cluster").agg(F.count(F.lit(1)), *sums).collect():  # a row per centroid
        new[cluster] = [int(t) // n for t in total]
    return new


def clustered(vectors: DataFrame, rules: CentroidRules = CentroidRules(), key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector after the last assignment, in a landed table, and the centroids."""
    rows = landed(kept(vectors, rules, key, vector), "integers")
    name = F.sha2(F.concat(F.lit(rules.seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = rows.select("x", name.alias("h")).orderBy("h", "x").limit(rules.centroids).collect()
    new = np.array([r.x for r in chosen], np.int64).reshape(len(chosen), rules.dimensions)
    old, state = np.zeros_like(new), rows
    if not len(new):
        return rows.selectExpr("id", "0 as cluster", "0L as distance"), new
    for done in range(rules.rounds + 1):
        state, before = _advance(state, old, new), state
        state = landed(state if done < rules.rounds else state.select("id", "cluster", "distance"), "distances")
        dropped(before)
        if done < rules.rounds:
            old, new = new, _means(state, new, rules)
    return state, new


def described(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds `cluster_inertia`, `inertia` (null beyond a long) and `centroid_sha256`, by a join with one row per centroid."""
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # a row per centroid
    total, top = sum(int(s) for _, s in sums), 2**63
    known = []
    for cluster, own in sums:
        digest = hashlib.sha256(",".join(map(str, centroids[cluster].tolist())).encode()).hexdigest()
        known.append((cluster, int(own) if own < top else None, total if total < top else None, digest))
    known = assigned.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
