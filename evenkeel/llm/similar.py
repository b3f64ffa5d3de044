"""Near copies by SimHash and exact Jaccard similarity of shingle sets.

Rows with equal shingle sets meet once. The binary trie of `simhash.py` finds pairs of fingerprints within `bits` bits; the leading
rows of both are compared, and the rows of one fingerprint with theirs. At a similarity of 0.8 fingerprints of 64 bits differ in about
10 bits and in up to 23, a budget at which a trie prunes nothing; so what is similar but further apart meets by the two steps below.

Sets that share one of `_MARKS` minimum hashes are compared with a leading row that has it first, as those of one fingerprint are. The
rows of one mark are dealt by hash into parts of about `part`, each led by its row of the fewest shingles that the sample below lacks,
which is near to the centre of its group; so a large group is linked by a few pairs for each of its rows, even where no single row is
near to all others. What is left meets by an exact prefix filter: in any common order of shingles, two sets of Jaccard similarity s have one
of their first n - ceil(s n) + 1 shingles in common. The order puts shingles first that are rare in a bounded sample of
documents, which changes the work, not the result. Of each shingle's list only pairs of sets that are not linked yet are
formed, and none within the label that most of the list has, so that a large group costs no pairs of its own. Sizes,
positions and counts of shingles by `_SKETCH` cells then drop only pairs that cannot reach the similarity; the rest is
decided by the sets themselves. Texts move once for each block of partners, and are cut into shingles where they meet.

Null texts count as empty; empty texts are one group. A text of fewer words than a shingle is its only shingle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import col, dropped, keyed, landed, numbered
from evenkeel.llm.components import components
from evenkeel.llm.simhash import links as near_fingerprints
from evenkeel.llm.simhash import majority_bits, shingle_hashes

_MARKS = 8
_SKETCH = 64
_ODD = np.random.default_rng(1).integers(0, 2**63, (2, _MARKS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Similar:
    """The order of shingles comes from one of `one_in` documents, of which the `frequent` most frequent shingles are held as
    such. The trie finds fingerprints within `bits` bits. Tables of at most `most_shipped` numbers travel to all tasks; larger ones are shuffled. Texts meet in blocks of about
    `block` shingles."""

    words: int = 5
    similarity: float = 0.8
    bits: int = 4
    one_in: int = 8
    frequent: int = 1 << 20
    most_shipped: int = 1 << 21
    part: int = 64
    block: int = 1 << 18


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def signature(hashes: np.ndarray) -> tuple:
    """(digest, n, sketch, marks) of a set of shingles."""
    n = len(hashes)
    fp = int(majority_bits(hashes, np.array([n], np.int64)).view(np.int64)[0])
    sketch = np.minimum(np.bincount((hashes >> np.uint64(58)).astype(np.int64), minlength=_SKETCH), 255).astype(np.uint8)
    marks = [int(((hashes ^ _ODD[0, k]) * _ODD[1, k]).min().view(np.int64)) for k in range(_MARKS)] if n else []
    return xxhash.xxh3_128_digest(hashes.tobytes()), n, sketch.tobytes(), [fp, *marks] if n else []


def prefix(hashes: np.ndarray, frequent: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The first shingles of a set, rare ones first: as many as two sets of the similarity must share one of. And
    how many of the set are not frequent: the fewer, the nearer it is to what many documents have in common."""
    n = len(hashes)
    if not n:
        return hashes, 0
    at = np.minimum(np.searchsorted(frequent, hashes), max(len(frequent) - 1, 0))
    known = counts[at] * (frequent[at] == hashes) if len(frequent) else np.zeros(n, np.int64)
    first = hashes[np.lexsort((hashes, known))[: n - math.ceil(similarity * n - 1e-9) + 1]]
    return first, int((known == 0).sum())


def _frequent(rows: DataFrame, rules: Similar) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that more than one document of the sample has, ascending, and in how many: at most `frequent` numbers."""
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(rules.one_in)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), rules.words).view(np.int64))], ["h"])

    counts = sample.mapInArrow(run, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = counts.orderBy(F.desc("n"), "h").limit(rules.frequent).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _signatures(rows: DataFrame, rules: Similar) -> DataFrame:
    """(row, digest, n, sketch, marks, prefix, rare) of every row."""
    sent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, rules))
    kinds = [("digest", pa.binary()), ("n", pa.int64()), ("sketch", pa.binary()), ("marks", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("rare", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = sent.value
        for batch in batches:
            found = []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), rules.words)
                first, rare = prefix(hashes, frequent, counts, rules.similarity)
                found.append((*signature(hashes), first.view(np.int64), rare))
            columns = [pa.array([f[k] for f in found], kind) for k, (_, kind) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *[c for c, _ in kinds]])

    return rows.mapInArrow(run, "row bigint, digest binary, n bigint, sketch binary, marks array<bigint>, prefix array<bigint>, rare bigint")


def _shipped(table: DataFrame, rules: Similar) -> DataFrame:
    """A landed table of numbers, to be broadcast if its counted rows allow it."""
    return F.broadcast(table) if table.count() <= rules.most_shipped else table


def _possible(pairs: DataFrame, sets: DataFrame, rules: Similar) -> DataFrame:
    """(u, v, nu) of the pairs whose sizes and counts by cells allow the similarity."""
    for side in "uv":
        pairs = pairs.join(sets.select(F.col("row").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
    apart = (1 - rules.similarity) / (1 + rules.similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [batch.column(c).to_numpy() for c in ("nu", "nv")]
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, _SKETCH) for c in ("su", "sv"))
            # Cells of more than 255 shingles count as 255, which only brings sets closer.
            differ = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)
            fit = (np.minimum(*n) >= rules.similarity * np.maximum(*n) - 1e-6) & (differ <= (n[0] + n[1]) * apart + 1e-6)
            yield batch.select(["u", "v", "nu"]).filter(pa.array(fit))

    return pairs.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u bigint, v bigint, nu bigint")


def _alike(rules: Similar):
    def run(group: pa.Table) -> pa.Table:
        """One text (`u` null) against those of a block."""
        u, texts = group.column("u").to_pylist(), group.column("text").to_pylist()
        one = shingle_set(texts[u.index(None)], rules.words)
        keep = []
        for row, text in zip(u, texts):
            if row is not None:
                other = shingle_set(text, rules.words)
                shared = len(np.intersect1d(one, other, assume_unique=True))
                if shared >= rules.similarity * (len(one) + len(other) - shared):
                    keep.append(row)
        return pa.table({"u": pa.array(keep, pa.int64()), "v": pa.array([group.column("v")[0].as_py()] * len(keep), pa.int64())})

    return run


def _linked(pairs: DataFrame, sets: DataFrame, rows: DataFrame, rules: Similar) -> DataFrame:
    """Those of the pairs (u, v) of rows whose shingle sets reach the similarity."""
    found = landed(pairs, "similar-pairs")
    pairs = landed(_possible(found, sets, rules), "possible-pairs")
    blocks = pairs.groupBy("v").agg(F.ceil(F.sum("nu") / rules.block).cast("int").alias("blocks"))
    blocks = landed(blocks, "similar-blocks")
    ends = landed(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), "similar-ends")
    texts = landed(rows.join(_shipped(ends, rules), "id", "left_semi"), "similar-texts")
    block = F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int").alias("block")
    many = pairs.select("u", "v").join(blocks, "v").select("u", "v", block).join(texts.withColumnRenamed("id", "u"), "u").select("u", "v", "block", "text")
    one = blocks.select("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(texts.withColumnRenamed("id", "v"), "v")
    both = many.union(one.select(F.lit(None).cast("long").alias("u"), "v", "block", "text"))
    links = landed(both.groupBy("v", "block").applyInArrow(_alike(rules), "u bigint, v bigint"), "similar-links")
    for done in (found, pairs, blocks, ends, texts):
        dropped(done)
    return links


def _candidates(sets: DataFrame, labels: DataFrame, rules: Similar) -> DataFrame:
    """(u, v): pairs of sets (row, n, prefix) with different labels that share a shingle of their prefixes early enough."""
    labelled = sets.select("row", "n", "prefix").join(_shipped(labels, rules), "row")
    lists = labelled.select("row", "n", "label", F.posexplode("prefix").alias("at", "h")).repartition("h")
    # All that follows is by shingle, on one shuffle of the lists.
    shares = lists.groupBy("h", "label").agg(F.count(F.lit(1)).alias("c"))
    shares = shares.groupBy("h").agg(F.max_by("label", "c").alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    some = lists.join(shares.select("h", "most").hint("merge"), "h")
    a = some.select("h", *[F.col(c).alias(c + "a") for c in ("row", "n", "label", "at")], (F.col("label") == F.col("most")).alias("major"))
    b = some.where("label <> most").select("h", *[F.col(c).alias(c + "b") for c in ("row", "n", "label", "at")])
    share = rules.similarity / (1 + rules.similarity)
    # From the first shared shingle on, at most so many can be shared; a pair stays if one of its shingles allows it.
    fits = f"labela <> labelb and (major or rowa < rowb) and least(na - ata, nb - atb) >= {share!r}D * (na + nb) - 1e-6D"
    pairs = a.join(b.hint("merge"), "h").where(fits)
    return pairs.select(F.greatest("rowa", "rowb").alias("u"), F.least("rowa", "rowb").alias("v")).distinct()


def _near(sets: DataFrame, rules: Similar) -> DataFrame:
    """(u, v): the leading rows of fingerprints of `sets` (row, rare, marks) that the trie finds within `bits` bits, as many pairs
    as join what all of them join."""
    fps = sets.groupBy(F.get("marks", F.lit(0)).alias("fp")).agg(F.min(F.struct("rare", "row")).getField("row").alias("row"))
    fps = landed(fps, "leading-rows")
    pairs = landed(near_fingerprints(fps.select("fp"), rules.bits, real=True), "near-fingerprints")
    for side in "uv":
        pairs = pairs.join(_shipped(fps.select(F.col("fp").alias(side), F.col("row").alias(f"row{side}")), rules), side)
    return pairs.select(F.greatest("rowu", "rowv").alias("u"), F.least("rowu", "rowv").alias("v"))


def _marked(sets: DataFrame, rules: Similar) -> DataFrame:
    """(u, v): every row of `sets` (row, rare, marks) with the leading row of its part of each of its marks."""
    marks = sets.select("row", "rare", F.posexplode("marks").alias("k", "mark"))
    sizes = marks.groupBy("k", "mark").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = landed(sizes.select("k", "mark", F.ceil(F.col("size") / rules.part).cast("int").alias("parts")), "mark-sizes")
    part = F.pmod(F.xxhash64("row", "k"), F.col("parts")).cast("int").alias("part")
    dealt = landed(marks.join(_shipped(sizes, rules), ["k", "mark"]).select("row", "rare", "k", "mark", part), "dealt-marks")
    lead = dealt.groupBy("k", "mark", "part").agg(F.min(F.struct("rare", "row")).getField("row").alias("v"))
    return dealt.join(lead, ["k", "mark", "part"]).where("row <> v").select(F.greatest("row", "v").alias("u"), F.least("row", "v").alias("v")).distinct()


def groups(rows: DataFrame, rules: Similar) -> DataFrame:
    """(row, root) for every row of `rows` (id, text), ids being distinct longs: the least id that chains of links reach."""
    signed = landed(_signatures(rows, rules), "signatures")
    vertex = landed(signed.groupBy("digest").agg(F.min("row").alias("vertex")), "distinct-sets")
    own = landed(vertex.select(F.col("vertex").alias("row")), "set-rows")
    sets = signed.join(_shipped(own, rules), "row", "left_semi").where("n > 0")
    small = landed(sets.select("row", "n", "sketch", "rare", "marks"), "sketches")
    first = _near(small, rules).union(_marked(small, rules)).distinct()
    links = _linked(first, small, rows, rules)
    dropped(first)
    label = components(links).select(F.col("vertex").alias("row"), F.col("root").alias("label"))
    labels = landed(own.join(label, "row", "left").select("row", F.coalesce("label", "row").alias("label")), "set-labels")
    more = _linked(_candidates(sets, labels, rules), small, rows, rules)
    root = landed(components(links.union(more)), "similar-roots")
    known = landed(vertex.join(root, "vertex", "left").select("digest", F.coalesce("root", "vertex").alias("root")), "set-roots")
    return signed.select("row", "digest").join(known, "digest").select("row", "root")


def one_per_group(docs: DataFrame, rules: Similar = Similar(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of the least (id, place in the table) of every group of near copies, as it was; rows without an id come last."""
    rows, number = numbered(docs)
    found = landed(groups(keyed(rows, number, text), rules), "similar-groups")
    order = F.struct(col(key).isNull().alias("nameless"), col(key).alias("id"), col(number).alias("row"))
    placed = rows.select(order.alias("order"), col(number).alias("row")).join(found, "row")
    least = placed.groupBy("root").agg(F.min("order").alias("least")).select("root", F.col("least.row").alias("kept"))
    gone = landed(found.join(least, "root").where("row <> kept").select(F.col("row").alias(number)), "near-copies")
    return rows.join(_shipped(gone, rules), number, "left_anti").drop(number)
