"""Near duplicates by SimHash: fingerprints, and all pairs within a few bits by a binary trie.

Equal fingerprints meet once. The trie over the distinct ones is grown until every leaf holds at
most `leaf_size` of them; pairs of its nodes are followed downwards together, the differing bits
of their prefixes add up, and a pair that exceeds the budget goes. These steps are joins of small
node tables. Each surviving pair of leaves is one task-sized problem: the same descent goes on bit
by bit over the two sorted arrays, and a task gives back a spanning forest of its links, never all
pairs of a group.

Null texts count as empty. Empty texts have fingerprint zero. A null id is never a component's id
while the component holds another; rows that share an id are separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import col, keyed, landed, numbered
from evenkeel.llm.components import components

_LANES = np.uint64(0x0101010101010101)
_STEP = 2
_BLOCK = 16
_CHUNK = 200_000
_LEAF = 8


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 (seed 42) of all shingles of a text, repeats included. A-Z are lower-cased, words
    are split at ASCII white space; a text of fewer words has itself as its only shingle."""
    split = text.encode().lower().split()
    if not split:
        return []
    joined = b" ".join(split)
    ends = np.cumsum([len(w) + 1 for w in split]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hash_ = xxhash.xxh64_intdigest
    return [hash_(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())] or [hash_(joined, 42)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of `counts` hashes: bits that over half of them have.

    Eight bits are counted at a time in the byte lanes of a word, in groups of up to 255."""
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    groups = -(-n // 255)
    owner = np.repeat(np.arange(len(some)), groups)
    within = np.arange(groups.sum()) - np.repeat(np.cumsum(groups) - groups, groups)
    starts = (np.cumsum(n) - n)[owner] + 255 * within
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, starts)
        bits = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[some] |= (2 * bits[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(id, fp) for every row; `fp` holds the 64 bits as a signed long."""
    rows = keyed(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, fps, hashes, counts = batch.column(1), [], [], []

            def flush():
                flat = np.fromiter((h for part in hashes for h in part), np.uint64, sum(counts))
                fps.append(majority_bits(flat, np.array(counts, np.int64)))
                hashes.clear()
                counts.clear()

            held = 0
            for value in column:
                hashes.append(shingle_hashes(value.as_py(), words))
                counts.append(len(hashes[-1]))
                held += counts[-1]
                if held > 500_000:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(fps).view(np.int64))], ["id", "fp"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, fp bigint")


def _prefix(depth: int):
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned("fp", 64 - depth)


def _grow(fps: DataFrame, leaf_size: int) -> DataFrame:
    """The nodes (depth, prefix, leaf) of a trie whose leaves hold at most `leaf_size` fingerprints.

    Sizes are counted for `_BLOCK` bits at once; only what is still too large goes on to the next bits."""
    grown, base, rest = None, 0, fps
    while True:
        depths = range(base, base + _BLOCK + 1, _STEP)
        counts = rest.groupBy(_prefix(base + _BLOCK).alias("low")).count()
        at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _above("low", base + _BLOCK - d).alias("prefix")) for d in depths]))
        sizes = landed(counts.select(at.alias("n"), "count").groupBy("n.depth", "n.prefix").agg(F.sum("count").alias("size")), "trie-sizes")
        parents = sizes.where(f"size > {leaf_size}").select((F.col("depth") + _STEP).alias("depth"), F.col("prefix").alias("up"))
        below = sizes.withColumn("up", _above("prefix", _STEP)).join(parents, ["depth", "up"])
        nodes = below.select("depth", "prefix", "size")
        if base == 0:
            nodes = nodes.union(sizes.where("depth = 0").select("depth", "prefix", "size"))
        nodes = nodes.select("depth", "prefix", (F.col("size") <= leaf_size).alias("leaf"))
        grown = nodes if grown is None else grown.union(nodes)
        base += _BLOCK
        large = sizes.where((F.col("depth") == base) & (F.col("size") > leaf_size)).select("prefix")
        if base == 64 or large.isEmpty():
            return landed(grown, "trie-nodes")
        rest = landed(fps.withColumn("prefix", _prefix(base)).join(large, "prefix").select("fp"), "trie-rest")


def _above(prefix: str, bits: int):
    return F.col(prefix) if bits == 0 else F.lit(0).cast("long") if bits == 64 else F.shiftrightunsigned(prefix, bits)


def _node_pairs(nodes: DataFrame, deepest: int, bits: int) -> DataFrame:
    """Pairs of leaves (da, pa, db, pb) whose prefixes differ in at most `bits` bits where both reach."""

    def named(side: str):
        return [F.col(c).alias(c[0] + side) for c in ("depth", "prefix", "leaf")]

    root = nodes.where("depth = 0")
    pairs, done = root.select(*named("a"), F.lit(0).alias("db"), F.lit(0).cast("long").alias("pb"), F.col("leaf").alias("lb")), []
    for depth in range(0, deepest + 1, _STEP):
        done.append(pairs.where("la and lb").select("da", "pa", "db", "pb"))
        pairs = pairs.where("not (la and lb)")
        if depth == deepest:
            break
        for side in "ab":
            child = nodes.where(F.col("depth") == depth + _STEP).select(
                _above("prefix", _STEP).alias(f"p{side}"), *[F.col(c).alias("_" + c) for c in ("depth", "prefix", "leaf")]
            )
            grown = pairs.where(f"not l{side}").join(child, f"p{side}")
            grown = grown.withColumns({f"d{side}": F.col("_depth"), f"p{side}": F.col("_prefix"), f"l{side}": F.col("_leaf")})
            pairs = grown.select(pairs.columns).union(pairs.where(f"l{side}"))
        short = [F.expr(f"shiftrightunsigned(p{s}, d{s} - least(da, db))") for s in "ab"]
        near = pairs.where(F.bit_count(short[0].bitwiseXOR(short[1])) <= bits)
        # Nodes of one depth meet in both orders, of which one stays; what grows from it has one order too.
        pairs = landed(near.where("da <> db or pa <= pb"), "trie-pairs")
    all_ = done[0]
    for more in done[1:]:
        all_ = all_.union(more)
    return all_


def near_pairs(a: np.ndarray, b: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within `bits` bits between two sorted arrays of distinct 64-bit
    words, or within one if `b` is None, in blocks. The descent keeps a stack of bounded blocks
    of node pairs: (depth, low and high end in a, in b, bits spent)."""
    same = b is None
    b = a if same else b
    zeros_a, zeros_b = _Zeros(a), _Zeros(b)
    stack = [(0, *(np.array([x], np.int32) for x in (0, len(a), 0, len(b), 0)))] if len(a) and len(b) else []
    while stack:
        depth, al, ah, bl, bh, spent = stack.pop()
        small = (ah - al <= _LEAF) & (bh - bl <= _LEAF)
        if depth == 64:
            small[:] = True
        if small.any():
            yield from _compared(a, b, al[small], ah[small], bl[small], bh[small], bits, same)
            big = ~small
            al, ah, bl, bh, spent = al[big], ah[big], bl[big], bh[big], spent[big]
        if not len(al):
            continue
        am, bm = zeros_a.middle(al, ah, depth), zeros_b.middle(bl, bh, depth)
        children = [(al, am, bl, bm, spent), (am, ah, bm, bh, spent)]
        may = spent < bits
        if not may.all():
            al, ah, bl, bh, am, bm, spent = (x[may] for x in (al, ah, bl, bh, am, bm, spent))
        children.append((al, am, bm, bh, spent + 1))
        if same:
            other = (al != bl) | (ah != bh)
            al, ah, bl, bh, am, bm, spent = (x[other] for x in (al, ah, bl, bh, am, bm, spent))
        children.append((am, ah, bl, bm, spent + 1))
        al, ah, bl, bh, spent = (np.concatenate(x) for x in zip(*children))
        live = (ah > al) & (bh > bl)
        grown = [x[live] for x in (al, ah, bl, bh, spent)]
        for at in range(0, len(grown[0]), _CHUNK):
            stack.append((depth + 1, *(x[at : at + _CHUNK] for x in grown)))


class _Zeros:
    """For each bit from the left, how many of the sorted words before a position have a zero there."""

    def __init__(self, words: np.ndarray):
        self.words, self.counts = words, {}

    def middle(self, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
        """Where the bit turns to one within each range whose words agree in the bits before."""
        if depth not in self.counts:
            zero = (self.words >> np.uint64(63 - depth)) & np.uint64(1) == 0
            self.counts[depth] = np.append(0, np.cumsum(zero)).astype(np.int32)
        count = self.counts[depth]
        return low + count[high] - count[low]


def _compared(a, b, al, ah, bl, bh, bits, same) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of small ranges, one offset after another."""
    for x in range(int((ah - al).max())):
        i = al + np.int32(x)
        here = i < ah
        i, low, high = (i, bl, bh) if here.all() else (i[here], bl[here], bh[here])
        own = a[i]
        for y in range(int((high - low).max()) if len(low) else 0):
            j = low + np.int32(y)
            near = np.bitwise_count(own ^ b[np.minimum(j, len(b) - 1)]) <= bits
            near &= j < high
            if same:
                near &= i < j
            if near.any():
                yield i[near].astype(np.int64), j[near].astype(np.int64)


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The least position that each of `n` positions is linked with."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
    return label


def spanning(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of `n` positions, some that join what all of them join: n - 1 at most, each as it was given."""
    label, out = np.arange(n), []
    for i, j in pairs:
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            # Every group is hung below a lower one once, so that no pair closes a ring.
            high, first = np.unique(np.maximum(x, y), return_index=True)
            out.append((i[first], j[first]))
            label[high] = np.minimum(x, y)[first]
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
    ends = zip(*out) if out else ([np.zeros(0, np.int64)],) * 2
    return tuple(np.concatenate(end) for end in ends)


def _linked(bits: int, real: bool):
    def run(group: pa.Table) -> pa.Table:
        sides = [np.sort(np.frombuffer(x.values.to_numpy(zero_copy_only=False).astype("<i8").tobytes(), "<u8")) for x in group.column("fps")]
        both = np.concatenate(sides)
        if len(sides) == 1:
            pairs = near_pairs(both, None, bits)
        else:
            a, b = sides
            pairs = ((i, j + len(a)) for i, j in near_pairs(a, b, bits))
        if real:
            u, v = spanning(pairs, len(both))
        else:
            label = forest(pairs, len(both))
            u = np.flatnonzero(label != np.arange(len(label)))
            v = label[u]
        signed = both.view(np.int64)
        return pa.table({"u": signed[u], "v": signed[v]})

    return run


def links(fps: DataFrame, bits: int = 4, leaf_size: int = 32_768, real: bool = False) -> DataFrame:
    """Edges (u, v) that join exactly the distinct values of `fp` that chains of pairs within
    `bits` bits join: a spanning forest for each pair of leaves. If `real`, every edge is itself
    a pair within `bits` bits."""
    nodes = _grow(fps, leaf_size)
    depths = [d for (d,) in nodes.where("leaf").select("depth").distinct().collect()]  # 33 at most
    pairs = landed(_node_pairs(nodes, max(depths, default=0), bits).withColumn("pair", F.monotonically_increasing_id()), "leaf-pairs")
    own = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths] or [F.struct(F.lit(0).alias("depth"), _prefix(0).alias("prefix"))]))
    members = fps.select("fp", own.alias("n")).select("fp", "n.depth", "n.prefix").join(nodes.where("leaf"), ["depth", "prefix"])
    leaves = members.groupBy("depth", "prefix").agg(F.collect_list("fp").alias("fps"))  # at most leaf_size each
    a = pairs.select("pair", F.col("da").alias("depth"), F.col("pa").alias("prefix"))
    b = pairs.where("da <> db or pa <> pb").select("pair", F.col("db").alias("depth"), F.col("pb").alias("prefix"))
    n = max(fps.sparkSession.sparkContext.defaultParallelism, min(pairs.count() // 4, 100_000))
    sides = leaves.join(a.union(b), ["depth", "prefix"]).select("pair", "fps").repartition(n, "pair")
    return sides.groupBy("pair").applyInArrow(_linked(bits, real), "u bigint, v bigint")


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(id, fp, component_id) for every row: the least id that links of at most `bits` bits reach."""
    rows = landed(fingerprints(docs, key, text, words), "fingerprints")
    distinct = landed(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct.select("fp"), bits))
    member = roots.join(distinct.withColumnRenamed("fp", "vertex"), "vertex")
    linked = member.join(member.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    linked = landed(linked.select(F.col("vertex").alias("fp"), "component_id"), "linked-fingerprints")
    known = distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(known, "fp").select("id", "fp", "component_id")


def kept(rows: DataFrame, number: str, key: str, groups: DataFrame, nameless_apart: bool = False) -> DataFrame:
    """Of numbered rows, the one with the least (id, number) of each group of `groups` (row, root), without the number.

    Rows without an id come last, or count as a group of their own."""
    nameless = col(key).isNull()
    order = F.struct(nameless.alias("nameless"), col(key).alias("id"), col(number).alias("row"))
    placed = rows.select(order.alias("order"), col(number).alias("row")).join(groups, "row")
    by = ["root", "order.nameless"] if nameless_apart else ["root"]
    least = placed.groupBy(*by).agg(F.min("order").alias("least")).select(F.col("least.row").alias(number))
    return rows.join(least, number, "left_semi").drop(number)


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """Of each group the row with the least (id, place in the table), as it was; of its rows without an id, one stays too."""
    rows, number = numbered(docs)
    found = clusters(rows, number, text, words, bits).select(F.col("id").alias("row"), F.col("component_id").alias("root"))
    return kept(rows, number, key, landed(found, "clusters"), nameless_apart=True)
