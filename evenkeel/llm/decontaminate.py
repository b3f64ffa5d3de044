"""Benchmark decontamination by SimHash windows and exact shingle similarity.

Every benchmark item of n tokens has a SimHash of its shingles, weighted by how often they occur,
and so has every window of n tokens in a document, or the whole of a document of fewer tokens. The 64 bits are split into blocks; two
fingerprints within the radius agree up to `radius // blocks` bits in one block at least, so a table per
block that lists all items near each block value finds them all. Candidates are verified
by the weighted Jaccard similarity of the shingles themselves.

A window that shares no shingle with an item has similarity zero, so only windows that hold an item's
shingle are fingerprinted. Documents never move: the job is one pass with no shuffle. Items travel to
the executors in blocks of about `items_per_pass` items and `chars_per_pass` characters, one pass per block.

Null and empty texts, of documents or items, match nothing. Items shorter than a shingle are
compared as a single shingle of their own length. Rows that share an id are separate rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import col, keyed
from evenkeel.llm.textwords import shingles, words

_ONE = np.uint64(1)


@dataclass(frozen=True)
class Decontamination:
    shingle: int = 5
    similarity: float = 0.8
    radius: int = 23
    blocks: int = 8
    items_per_pass: int = 20_000
    chars_per_pass: int = 16_000_000


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    return (((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & _ONE).astype(np.int8) * 2 - 1).astype(np.int32)


def packed(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=-1, dtype=np.uint64)


def tokens(text: str, start: np.ndarray, end: np.ndarray) -> list[str]:
    return [text[a:z].lower() for a, z in zip(start.tolist(), end.tolist())]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared weight over joint weight, a shingle weighing as often as it occurs."""
    shared = sum((a & b).values())
    joint = sum(a.values()) + sum(b.values()) - shared
    return shared / joint if joint else 0.0


class Items:
    """The benchmark's side: shingles, fingerprints, and the block tables."""

    def __init__(self, rows: list[tuple], rules: Decontamination):
        self.rules, self.ids, self.size, self.words, prints = rules, [], [], [], []
        by_size: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item, text in rows:
            start, end, numbers = words(text or "")
            if not len(numbers):
                continue
            width = min(rules.shingle, len(numbers))
            hashes = shingles(numbers, width)
            by_size.setdefault(width, []).append((hashes, len(self.ids)))
            self.ids.append(item)
            self.size.append(len(numbers))
            self.words.append(tokens(text, start, end))
            prints.append(packed(signs(hashes).sum(axis=0)))
        self.prints = np.array(prints, np.uint64)
        # For each shingle length: sorted shingles, and the items that have them.
        self.lookup = {}
        for width, found in by_size.items():
            hashes = np.concatenate([h for h, _ in found])
            owner = np.repeat([i for _, i in found], [len(h) for h, _ in found])
            pairs = np.unique(np.stack([hashes, owner.astype(np.uint64)]), axis=1)
            known = np.zeros(1 << 20, bool)
            known[pairs[0] & np.uint64((1 << 20) - 1)] = True
            self.lookup[width] = pairs[0], pairs[1].astype(np.int64), known
        self._index()

    def _index(self) -> None:
        """For each block and each of its values, the items whose block differs in few enough bits."""
        width, self.tables = 64 // self.rules.blocks, []
        allowed = self.rules.radius // self.rules.blocks
        values = np.arange(1 << width, dtype=np.uint64)
        for k in range(self.rules.blocks):
            own = (self.prints >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
            self.tables.append(np.bitwise_count(values[:, None] ^ own[None, :]) <= allowed)

    def within(self, prints: np.ndarray, item: int) -> np.ndarray:
        """Which fingerprints lie within the radius of an item: first the block tables, then all bits."""
        width = 64 // self.rules.blocks
        hit = np.zeros(len(prints), bool)
        for k, table in enumerate(self.tables):
            hit |= table[(prints >> np.uint64(k * width)) & np.uint64((1 << width) - 1), item]
        at = np.flatnonzero(hit)
        return at[np.bitwise_count(prints[at] ^ self.prints[item]) <= self.rules.radius]

    def matches(self, text: str) -> list[tuple]:
        """(item, first token, tokens, start, end, differing bits, similarity): the best window of each item found."""
        start, end, numbers = words(text)
        out, split = [], None
        for width, (hashes, owners, known) in self.lookup.items():
            own = shingles(numbers, width)
            maybe = np.flatnonzero(known[own & np.uint64((1 << 20) - 1)])
            low, high = (np.searchsorted(hashes, own[maybe], side) for side in ("left", "right"))
            hits = high > low
            if not hits.any():
                continue
            maybe, low, n = maybe[hits], low[hits], (high - low)[hits]
            at = np.repeat(maybe, n)
            items = owners[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            order = np.argsort(items, kind="stable")
            cuts = np.flatnonzero(np.diff(items[order])) + 1
            for part in np.split(order, cuts):
                item = int(items[part[0]])
                size = min(self.size[item], len(numbers))
                firsts = self._starts(at[part], size, width, len(numbers))
                if not len(firsts):
                    continue
                prints = self._window_prints(own, firsts, size - width + 1)
                near = self.within(prints, item)
                if not len(near):
                    continue
                split = split or tokens(text, start, end)
                best = self._verified(split, firsts[near], item, width)
                if best is not None:
                    sim, first = best
                    bits = int(np.bitwise_count(prints[np.searchsorted(firsts, first)] ^ self.prints[item]))
                    last = first + size - 1
                    out.append((self.ids[item], int(first), size, int(start[first]), int(end[last]), bits, sim))
        return out

    @staticmethod
    def _starts(at: np.ndarray, size: int, width: int, n: int) -> np.ndarray:
        """The windows of `size` tokens that hold a shingle at one of the places `at`."""
        change = np.zeros(n + 2, np.int64)
        np.add.at(change, np.maximum(at + width - size, 0), 1)
        np.add.at(change, at + 1, -1)
        return np.flatnonzero(np.cumsum(change)[: max(n - size + 1, 0)] > 0)

    @staticmethod
    def _window_prints(own: np.ndarray, firsts: np.ndarray, count: int) -> np.ndarray:
        """Fingerprints of windows of `count` shingles; running sums over each stretch of windows."""
        out = []
        for part in np.split(firsts, np.flatnonzero(np.diff(firsts) > 1) + 1):
            for k in range(0, len(part), 8192):
                low, high = part[k], part[min(k + 8192, len(part)) - 1] + count
                sums = np.cumsum(np.vstack([np.zeros((1, 64), np.int32), signs(own[low:high])]), axis=0)
                out.append(packed(sums[count:] - sums[:-count]))
        return np.concatenate(out)

    def _verified(self, tokens: list[str], firsts: np.ndarray, item: int, width: int) -> tuple[float, int] | None:
        """The best similarity that reaches the threshold, and where; the first of equals."""
        def grams(run):
            return Counter(zip(*(run[k:] for k in range(width))))

        own, best = grams(self.words[item]), None
        for first in firsts.tolist():
            sim = similarity(own, grams(tokens[first : first + self.size[item]]))
            if sim >= self.rules.similarity and (best is None or sim > best[0]):
                best = sim, first
        return best


MATCHES = "array<struct<item_id:{kind},first_token:int,n_tokens:int,start:int,end:int,bits:int,similarity:double>>"


def matches(docs: DataFrame, benchmark: DataFrame, rules: Decontamination, key: str = "doc_id", text: str = "text",
            item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, first_token, n_tokens, start, end, bits, similarity): the best window of every
    document row for every benchmark item that it holds; start and end count code points."""
    out = None
    for found in _passes(docs, benchmark, rules, key, text, item, item_text):
        rows = found.select("id", F.explode_outer("found").alias("m")).where("m is not null").select("id", "m.*")
        out = rows if out is None else out.union(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rules: Decontamination, text: str = "text",
          item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no benchmark item, as they were."""
    for shared, _ in _blocks(benchmark, rules, item, item_text):

        @F.pandas_udf("boolean")
        def free(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = Items(shared.value, rules)
            for texts in batches:
                yield pd.Series([not (t and known.matches(t)) for t in texts], dtype=bool)

        docs = docs.where(free(col(text).cast("string")))
    return docs


def _blocks(benchmark: DataFrame, rules: Decontamination, item: str, item_text: str):
    """The items in blocks of a bounded size, broadcast, with the type of their ids."""
    items = benchmark.select(col(item).alias("item"), col(item_text).cast("string").alias("text")).where("text is not null")
    n, chars = items.agg(F.count("text"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // rules.items_per_pass), -(-chars // rules.chars_per_pass))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        rows = [tuple(r) for r in part.collect()]
        yield benchmark.sparkSession.sparkContext.broadcast(rows), items.schema["item"].dataType


def _passes(docs, benchmark, rules, key, text, item, item_text) -> Iterator[DataFrame]:
    rows = keyed(docs, key, text)
    for shared, kind in _blocks(benchmark, rules, item, item_text):
        yield _pass(rows, shared, rules, kind)


def _pass(rows: DataFrame, shared, rules: Decontamination, kind) -> DataFrame:
    name = MATCHES.format(kind=kind.simpleString())
    fields = ("item_id", "first_token", "n_tokens", "start", "end", "bits", "similarity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        known = Items(shared.value, rules)
        type_ = pa.list_(pa.struct([pa.field("item_id", to_arrow_type(kind)), *[pa.field(f, pa.int32()) for f in fields[1:6]], pa.field("similarity", pa.float64())]))
        for batch in batches:
            found = [[dict(zip(fields, m)) for m in known.matches(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type_)], ["id", "found"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, found {name}")
