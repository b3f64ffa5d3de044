"""Near copies of embeddings by cosine, through an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the two numbers of a vector's nearest codewords are its
cell in the product grid. A vector visits cells in the order of what they lie farther away than its own
(the squared distances of the halves to their codewords, less the least ones, added up): a multi-sequence traversal of the
two sorted lists that ends at the `reach`. Visited cells are compared within one label, by exact cosine.
A pair is met once, by the vector whose cell has the smaller number.

Codebooks are fitted on at most `sample` vectors chosen by hash. The reach follows from the target recall: it covers all
steps of `sigmas` deviations that a pair at the similarity takes across a border of cells, and then grows until it
covers the share `recall` of the true pairs that `queries` sampled vectors have among all vectors, found by brute
force in one pass. All vectors are indexed; the pairs of a visited cell are never cut.

Rows of equal label and vector meet first and count as one with copies, so a group of any size adds one vector. Vectors of one
grid row (label, first codeword) form blocks of at most `block` stored and visiting vectors, each pair of
blocks a task of bounded size, which returns numbers of links and a spanning forest, never the pairs.

Vectors that are null, empty, zero, or hold null or non-finite components, and those with a null label, link with
nothing; vectors of different lengths do not link, and each length has an index of its own. Rows that share an id are separate rows; a null id is never a
component's id while the component holds another. An odd dimension gives the first half the smaller part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenkeel.llm.common import col, landed
from evenkeel.llm.components import components
from evenkeel.llm.simhash import forest

_BINS = 512


@dataclass(frozen=True)
class VectorRules:
    similarity: float = 0.98
    recall: float = 0.999
    sample: int = 20_000
    queries: int = 256
    per_cell: int = 32
    most_codewords: int = 1024
    iterations: int = 8
    sigmas: float = 3.0
    block: int = 2048


def _signed(vectors: pa.Array, labels: pa.Array, kind: str) -> tuple[list[bytes | None], list[bytes | None]]:
    """The bytes of each vector that can link and a digest of it with its label, else nulls."""
    held, digests = [], []
    known = labels.is_valid().to_numpy(zero_copy_only=False)
    for vector, label, named in zip(vectors, labels, known):
        x = None
        if named and vector.is_valid and len(vector) and not vector.values.null_count:
            x = vector.values.to_numpy(zero_copy_only=False).astype(kind)
            x = x + x.dtype.type(0)  # one zero
            if not np.isfinite(x).all() or not x.any():
                x = None
        held.append(None if x is None else x.tobytes())
        # Labels are values of one type, so that text and bytes tell rows apart.
        digests.append(None if x is None else hashlib.sha256(f"{label.as_py()}\n".encode() + held[-1]).digest())
    return held, digests


def _prepared(rows: DataFrame, key: str, label: str, vector: str) -> tuple[DataFrame, str]:
    """(row, id, label, vector, digest) with a number for each row, the last two null where the row links with
    nothing, and the kind of number that `vector` holds as bytes."""
    single = isinstance(rows.select(col(vector).alias("v")).schema["v"].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    values = col(vector).cast("array<float>" if single else "array<double>")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), col(key).alias("id"), col(label).alias("label"), values.alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, digests = _signed(batch.column(3), batch.column(2), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(held, pa.binary()), pa.array(digests, pa.binary())], ["row", "id", "label", "vector", "digest"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"row bigint, id {kinds['id']}, label {kinds['label']}, vector binary, digest binary"), kind


def _matrix(vectors: list[bytes], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codebook(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """At most `k` codewords by Lloyd's rounds, from evenly spaced ones of the sorted points."""
    if not points.shape[1]:
        return np.zeros((1, 0))
    points = np.unique(points, axis=0)
    words = points[np.unique(np.linspace(0, len(points) - 1, k).astype(np.int64))]
    for _ in range(rounds):
        own = _far(points, words).argmin(axis=1)
        n = np.bincount(own, minlength=len(words))
        sums = np.stack([np.bincount(own, column, len(words)) for column in points.T], axis=1)
        words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
    return words


def _far(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances of points to codewords."""
    return np.maximum((points**2).sum(axis=1)[:, None] - 2 * points @ words.T + (words**2).sum(axis=1), 0)


class Grid:
    """Two codebooks, and how far a traversal goes."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], reach: float):
        self.books, self.reach = books, reach

    def excess(self, unit: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each half: the nearest codeword, and by how much every codeword is farther."""
        half = self.books[0].shape[1]
        out = []
        for part, words in zip((unit[:, :half], unit[:, half:]), self.books):
            far = _far(part, words)
            own = far.argmin(axis=1)
            out.append((own, far - far[np.arange(len(own)), own][:, None]))
        return out

    def cells(self, unit: np.ndarray) -> np.ndarray:
        (i, _), (j, _) = self.excess(unit)
        return i * len(self.books[1]) + j

    def visits(self, unit: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(position, first codeword, second codewords) for every vector and grid row that its traversal
        visits: its own cell and those of larger numbers within reach."""
        (i, u), (j, v) = self.excess(unit)
        order_u, order_v = np.argsort(u, axis=1, kind="stable"), np.argsort(v, axis=1, kind="stable")
        for x in range(len(unit)):
            near = v[x, order_v[x]]
            for first in order_u[x]:
                left = self.reach - u[x, first]
                if left < 0:
                    break
                seconds = order_v[x, : np.searchsorted(near, left, "right")]
                if first == i[x]:
                    seconds = seconds[seconds >= j[x]]
                if first >= i[x] and len(seconds):
                    yield x, int(first), np.sort(seconds)


def fit(distinct: DataFrame, n: int, kind: str, rules: VectorRules) -> Grid:
    """Codebooks from a bounded sample of the `n` rows (row, label, vector), and a reach that meets the target recall."""
    taken = distinct.orderBy(F.xxhash64("row"), "row").select("vector").limit(rules.sample).collect()
    sample = _unit(_matrix([v for (v,) in taken], kind))
    half = sample.shape[1] // 2
    k = min(rules.most_codewords, max(2, 2 ** math.ceil(math.log2(max(n / rules.per_cell, 1)) / 2)))
    books = codebook(sample[:, :half], k, rules.iterations), codebook(sample[:, half:], k, rules.iterations)
    # Of a pair that lies e apart, one is farther from the other's codeword by 2 e.w, w being what parts the codewords:
    # 2 |e| |w| at most, and a deviation of 2 |e| |w| / sqrt(dimensions) where e has no direction of its own.
    apart, between = math.sqrt(2 - 2 * rules.similarity), [_far(b, b) for b in books]
    whole = 2 * apart * math.sqrt(sum(far.max(initial=0) for far in between))
    usual = 2 * apart * math.sqrt(sum(np.median(far) for far in between)) / math.sqrt(sample.shape[1])
    grid = Grid(books, min(whole, rules.sigmas * usual))
    asked = distinct.orderBy(F.xxhash64("row", F.lit(1)), "row").select("row", "label", "vector").limit(rules.queries).collect()
    rows, queries = np.array([r.row for r in asked]), _unit(_matrix([r.vector for r in asked], kind))
    codes = {label: c for c, label in enumerate({r.label for r in asked})}
    labels = np.array([codes[r.label] for r in asked])

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """True pairs of the queries by the reach that finds them."""
        counts = np.zeros(_BINS + 1, np.int64)
        (_, u), (_, v) = grid.excess(queries)
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column(2).to_pylist(), kind))
                (i, _), (j, _) = grid.excess(unit)
                same = labels[:, None] == np.array([codes.get(label, -1) for label in batch.column(1).to_pylist()])
                same &= rows[:, None] != batch.column(0).to_numpy()
                q, x = np.nonzero((queries @ unit.T >= rules.similarity) & same)
                far = (u[q, i[x]] + v[q, j[x]]) * (_BINS / whole if whole else 0)
                counts += np.bincount(np.minimum(np.ceil(far), _BINS).astype(np.int64), minlength=_BINS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(_BINS + 1)), pa.array(counts)], ["bin", "n"])

    found = np.zeros(_BINS + 1)
    counted = distinct.select("row", "label", "vector").mapInArrow(needed, "bin bigint, n bigint")
    for at, pairs in counted.groupBy("bin").agg(F.sum("n")).collect():  # a row per bin
        found[at] = pairs
    if found.any():
        share = np.cumsum(found) / found.sum()
        grid.reach = max(grid.reach, int(np.searchsorted(share, rules.recall)) / _BINS * whole)
    return grid


def _placed(distinct: DataFrame, grid: Grid, kind: str) -> DataFrame:
    """(row, label, vector, copies, cell, first, seconds): each vector stored once in its own grid row
    (`seconds` null), and once for each grid row that it visits, with the second codewords of the cells."""
    rows = distinct.select("row", "label", "vector", "copies")
    label = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit = _unit(_matrix(part.column(2).to_pylist(), kind))
                cell, found = grid.cells(unit), list(grid.visits(unit))
                place = np.array([x for x, _, _ in found])
                seconds = [s.astype("<i2").tobytes() for _, _, s in found]
                both = np.concatenate([np.arange(len(unit)), place])
                first = np.concatenate([cell // len(grid.books[1]), [f for _, f, _ in found]])
                yield pa.RecordBatch.from_arrays(
                    [*part.take(pa.array(both)).columns, pa.array(cell[both], pa.int64()), pa.array(first, pa.int64()), pa.array([None] * len(unit) + seconds, pa.binary())],
                    ["row", "label", "vector", "copies", "cell", "first", "seconds"],
                )

    return rows.mapInArrow(run, f"row bigint, label {label}, vector binary, copies bigint, cell bigint, first bigint, seconds binary")


def _blocked(placed: DataFrame, rules: VectorRules) -> DataFrame:
    """Every stored vector beside every block of those that visit its grid row, and the other way round."""
    stored = F.col("seconds").isNull()
    sizes = placed.groupBy("label", "first").agg(*[F.ceil(F.count_if(x) / rules.block).cast("int").alias(n) for x, n in ((stored, "stores"), (~stored, "visitors"))])
    rows = placed.join(landed(sizes, "grid-rows"), ["label", "first"])

    def numbers(own: Column, n: str) -> Column:
        mine = F.array(F.pmod(F.xxhash64("row"), F.greatest(F.col(n), F.lit(1))).cast("int"))
        return F.when(own, mine).when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

    rows = rows.withColumn("store", F.explode(numbers(stored, "stores"))).withColumn("visitor", F.explode(numbers(~stored, "visitors")))
    return rows.drop("stores", "visitors")


def linked(group: pa.Table, kind: str, codes: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in `group` of the pairs (visitor, stored) that reach the similarity, of one pair of blocks."""
    visiting = group.column("seconds").is_valid().to_numpy()
    row, cell = group.column("row").to_numpy(), group.column("cell").to_numpy()
    x = _matrix(group.column("vector").to_pylist(), kind)
    unit = _unit(x)
    store = np.flatnonzero(~visiting)
    store = store[np.argsort(cell[store], kind="stable")]
    asking = np.flatnonzero(visiting)
    seconds = [np.frombuffer(s, "<i2") for s in group.column("seconds").take(pa.array(asking)).to_pylist()]
    owner = np.repeat(asking, [len(s) for s in seconds])
    seconds = np.concatenate(seconds) if len(asking) else np.zeros(0, np.int64)
    order = np.argsort(seconds, kind="stable")
    owner, seconds = owner[order], seconds[order]
    for own in np.unique(cell[store]):
        low, high = np.searchsorted(cell[store], [own, own + 1])
        there, second = store[low:high], own % codes
        who = owner[slice(*np.searchsorted(seconds, [second, second + 1]))]
        for at in range(0, len(who), 256):
            ask = who[at : at + 256]
            cosine = unit[ask] @ unit[there].T
            a, s = np.nonzero(cosine >= similarity - 1e-9)
            close, a, s = cosine[a, s], ask[a], there[s]
            # Within its own cell a vector asks for larger rows only; what lies at the bound is decided by the plain formula.
            fit = (cell[a] != own) | (row[a] < row[s])
            edge = fit & (close < similarity + 1e-9)
            if edge.any():
                p, q = x[a[edge]], x[s[edge]]
                with np.errstate(all="ignore"):
                    plain = (p * q).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((q * q).sum(axis=1)))
                fit[edge] = np.where(np.isfinite(plain), plain, close[edge]) >= similarity
            yield a[fit], s[fit]


def _linked(kind: str, codes: int, similarity: float):
    def run(group: pa.Table) -> pa.Table:
        row, copies = group.column("row").to_numpy(), group.column("copies").to_numpy()
        rows, at = np.unique(row, return_inverse=True)
        n = np.zeros(len(rows))

        def pairs():
            for a, s in linked(group, kind, codes, similarity):
                for x, y in ((a, s), (s, a)):
                    n[:] += np.bincount(at[x], copies[y], len(rows))  # exact below 2^53
                yield at[a], at[s]

        root = forest(pairs(), len(rows))
        some = n > 0
        return pa.table({"row": rows[some], "root": rows[root[some]], "n": n[some].astype(np.int64)})

    return run


def _links(distinct: DataFrame, n: int, kind: str, rules: VectorRules) -> DataFrame:
    """(row, root, n): links of each row by the copies of its partners, and edges that join what links join."""
    grid = fit(distinct, n, kind, rules)
    placed = landed(_placed(distinct, grid, kind), "grid")
    groups = _blocked(placed, rules).groupBy("label", "first", "store", "visitor")
    return groups.applyInArrow(_linked(kind, len(grid.books[1]), rules.similarity), "row bigint, root bigint, n bigint")


def near_copies(
    vectors: DataFrame, rules: VectorRules = VectorRules(), key: str = "vec_id", label: str = "label", vector: str = "embedding"
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row."""
    rows, kind = _prepared(vectors, key, label, vector)
    rows = landed(rows, "vectors")
    some = rows.where("digest is not null")
    distinct = some.groupBy("digest").agg(
        F.min("row").alias("row"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    distinct = landed(distinct, "distinct-vectors")
    found = None
    for size, n in distinct.groupBy(F.octet_length("vector")).count().collect():  # a row per length of vectors
        more = landed(_links(distinct.where(F.octet_length("vector") == size), n, kind, rules), "vector-links")
        found = more if found is None else found.union(more)
    nothing = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    if found is not None:
        root = components(found.select(F.col("row").alias("u"), F.col("root").alias("v"))).select(F.col("vertex").alias("row"), "root")
        degree = found.groupBy("row").agg(F.sum("n").alias("n"))
        known = distinct.drop("label", "vector").join(degree, "row", "left").join(root, "row", "left").withColumn("root", F.coalesce("root", "row"))
        known = landed(known, "vector-roots")
        known = known.join(known.groupBy("root").agg(F.min("least").alias("component_id")), "root")
        known = known.select("digest", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
        nothing = some.select("id", "digest").join(known, "digest").select("id", "n_links", "component_id").union(nothing)
    return nothing.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
