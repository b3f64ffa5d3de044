"""Alignment of two tokenizers' tokens of the same text by their bytes.

Tokenizer A is byte-level BPE over a space and the text, tokenizer B a SentencePiece model that adds the space
itself. Both split the same bytes, so each is an ascending array of byte ends. Where both have an end, a
group closes. While ends agree at the current index shift, probes of doubling width jump whole stretches of
one-to-one groups, and halving widths find where the stretch breaks; the irregular group there is walked
token by token until the ends meet again, which gives the new shift. Every step of such a walk is a
link, a pair of tokens whose bytes overlap; so is the pair that closes each group.

The number of documents that hold an id pair linked is counted over the whole corpus, from each document's
distinct pairs. A document's links then meet these counts in one pass without moving the links while there
are at most `most_shipped` distinct pairs; beyond that both sides are shuffled, salted by document.

Texts that are null or empty, and texts whose tokens do not give the bytes back (such as those with
U+2581), have no tokens: zeros, an empty digest, and no part in the counts. Special tokens' strings are plain
text. Rows that share an id or a text are separate rows and separate documents in the counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm import pieces
from evenkeel.llm.common import col, landed

#: The split of byte-level BPE before merging (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ID_BITS = 20
_IDS = (1 << _ID_BITS) - 1


@dataclass(frozen=True)
class AlignRules:
    """`block` characters of texts are encoded at a time; texts over `plain_limit` characters are split by the
    library that the vocabulary file belongs to, as the faster one keeps a stack for long runs."""

    block: int = 1_000_000
    plain_limit: int = 1_000_000
    most_shipped: int = 1 << 20
    salts: int = 32


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others are numbered from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokenizer:
    """Byte-level BPE from a `tokenizers` file. Ids come from tiktoken's engine, with the rank of a merge as its
    order, which gives the file's own ids."""

    def __init__(self, path: str, plain_limit: int):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split, model = spec["pre_tokenizer"], spec["model"]
        special = {t["content"] for t in spec["added_tokens"]}
        if spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("only byte-level BPE without a normalizer or added space is supported")
        letters = _byte_letters()
        known = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [model["vocab"]["".join(m)] for m in merges]
        if len(known) != 256 + len(order) or any(x >= y for x, y in zip(order, order[1:])) or (order and order[0] < 256):
            raise ValueError("ids must follow the order of merges")
        self.bytes = {i: b for b, i in known.items()}
        self._fast = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=known, special_tokens={})
        self._plain = Tokenizer.from_file(path)
        self._plain.encode_special_tokens = True
        self._limit = plain_limit

    def encode(self, texts: list[str]) -> list[list[int]]:
        def one(text: str) -> list[int]:
            if len(text) <= self._limit:
                return self._fast.encode_ordinary(text)
            return self._plain.encode(text, add_special_tokens=False).ids

        return [one(text) for text in texts]


class PieceTokenizer:
    """A SentencePiece model; it adds the space before the text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model, plain = pieces.model(path), SentencePieceProcessor(model_file=path)
        self.bytes = {
            i: bytes([int(piece[3:5], 16)]) if plain.is_byte(i) else piece.replace(pieces.SPACE, " ").encode()
            for i, piece in enumerate(map(plain.id_to_piece, range(plain.get_piece_size())))
        }

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids.tolist() for ids in self._model.encode(texts)]


def crossings(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions (i, j) of all overlapping tokens that do not end together, given the ascending ends of both
    sides; both close with the same end, or are empty."""
    at_a, at_b = [], []
    i = j = 0
    n = len(a)
    while i < n:
        width = 4
        while a[i : i + width] == b[j : j + width]:
            i += width
            j += width
            if i >= n:
                return at_a, at_b
            width *= 2
        while width > 1:
            width //= 2
            if a[i : i + width] == b[j : j + width]:
                i += width
                j += width
        x, y = a[i], b[j]
        while x != y:
            at_a.append(i)
            at_b.append(j)
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
    return at_a, at_b


class _Side:
    """Lengths and decimal digits of a vocabulary's ids, as arrays."""

    def __init__(self, tokens: dict[int, bytes]):
        n = max(tokens) + 1
        if n > _IDS:
            raise ValueError(f"ids of more than {_ID_BITS} bits are not supported")
        self.bytes = [tokens.get(i, b"") for i in range(n)]
        self.length = np.array([len(t) for t in self.bytes], np.int64)
        digits = [str(i).encode() for i in range(n)]
        width = len(digits[-1])
        self.places = np.array([len(d) for d in digits], np.int64)
        self.digits = np.frombuffer(b"".join(d.rjust(width, b"\0") for d in digits), np.uint8).reshape(n, width)


class Aligner:
    def __init__(self, byte_path: str, piece_path: str, rules: AlignRules = AlignRules()):
        self.a, self.b = ByteTokenizer(byte_path, rules.plain_limit), PieceTokenizer(piece_path)
        self._sides = _Side(self.a.bytes), _Side(self.b.bytes)

    def _tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both sides, none where one side does not give the bytes back."""
        out = []
        a, b = (side.bytes for side in self._sides)
        for text, x, y in zip(texts, self.a.encode([" " + t for t in texts]), self.b.encode(texts)):
            whole = b" " + text.encode()
            same = text and b"".join([a[i] for i in x]) == whole and b"".join([b[i] for i in y]) == whole
            out.append((x, y) if same else ([], []))
        return out

    def align(self, texts: list[str]) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray, np.ndarray]:
        """Columns with one value per text, and the distinct id pairs of all texts: pairs, how
        often each is linked, and the offsets of the texts in these two."""
        tokens = self._tokens(texts)
        ids, offsets, ends = [], [], []
        for side, lists in zip(self._sides, zip(*tokens)):
            flat = np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))
            ids.append(flat)
            offsets.append(np.cumsum([0, *map(len, lists)]))
            ends.append(np.cumsum(side.length[flat]))
        # One walk over all texts, end to end: both sides have an end where a text ends.
        x, y = (np.array(at, np.int64) for at in crossings(ends[0].tolist(), ends[1].tolist()))
        left = ends[0][x] < ends[1][y]
        last = [np.ones(len(i), bool) for i in ids]
        last[0][x[left]] = False
        last[1][y[~left]] = False
        close = [np.flatnonzero(own) for own in last]
        groups = np.searchsorted(close[0], offsets[0])
        inner = np.searchsorted(x, offsets[0])
        columns = {
            "n_a": np.diff(offsets[0]),
            "n_b": np.diff(offsets[1]),
            "n_groups": np.diff(groups),
            "n_links": np.diff(groups) + np.diff(inner),
            "groups_sha256": self._digests(ids, offsets, last, close),
        }
        at_a, at_b = np.concatenate([close[0], x]), np.concatenate([close[1], y])
        text = np.searchsorted(offsets[0], at_a, "right") - 1
        key = text << (2 * _ID_BITS) | ids[0][at_a] << _ID_BITS | ids[1][at_b]
        key, times = np.unique(key, return_counts=True)
        starts = np.searchsorted(key, np.arange(len(texts) + 1) << (2 * _ID_BITS))
        return columns, key & ((1 << 2 * _ID_BITS) - 1), times, starts

    def _digests(self, ids, offsets, last, close) -> list[str]:
        """SHA-256 of each text's groups: ids of A, a bar, ids of B, groups joined by semicolons."""
        before = np.append(0, close[1][:-1] + 1) if len(close[1]) else close[1]
        shift = before, close[0] + 1  # tokens of the other side that are written first, by group
        n = len(ids[0]) + len(ids[1])
        width = max(side.digits.shape[1] for side in self._sides)
        out, sizes = np.zeros((n, width + 1), np.uint8), np.zeros(n + 1, np.int64)
        for k, side in enumerate(self._sides):
            group = np.cumsum(last[k]) - last[k]
            at = np.arange(len(ids[k])) + shift[k][group]
            out[at, width - side.digits.shape[1] : width] = side.digits[ids[k]]
            out[at, width] = np.where(last[k], ord("|;"[k]), ord(","))
            sizes[at + 1] = side.places[ids[k]] + 1
        flat = out.ravel()
        joined = flat[flat != 0].tobytes()
        cuts = np.cumsum(sizes)[offsets[0] + offsets[1]].tolist()
        return [hashlib.sha256(joined[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(cuts, cuts[1:])]


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(byte_name: str, piece_name: str, rules: AlignRules) -> Aligner:
    key = byte_name, piece_name, rules
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(SparkFiles.get(byte_name), SparkFiles.get(piece_name), rules)
    return _ALIGNERS[key]


def _blocks(column: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """The texts in runs of rows of about `most` characters; (first row, texts)."""
    out, held, at = [], 0, 0
    for k, value in enumerate(column):
        out.append(value.as_py() or "")
        held += len(out[-1])
        if held > most:
            yield at, out
            out, held, at = [], 0, k + 1
    if out:
        yield at, out


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, byte_name: str, piece_name: str, rules: AlignRules = AlignRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) for every row: `pairs` holds
    the distinct linked ids, A's shifted left by 20 bits beside B's, `times` their links in the row.

    The names are those of tokenizer files that `pieces.ship` has sent out."""
    rows = docs.select(col(key).alias("id"), col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_name, piece_name, rules)
        for batch in batches:
            for at, texts in _blocks(batch.column(1), rules.block):
                columns, pairs, times, starts = aligner.align(texts)
                lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(x, pa.int64())) for x in (pairs, times)]
                plain = [pa.array(columns[c], pa.int64()) for c in _COUNTS]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *plain, pa.array(columns["groups_sha256"], pa.string()), *lists],
                    ["id", *_COUNTS, "groups_sha256", "pairs", "times"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    return rows.mapInArrow(run, f"id {kind}, {counts}, groups_sha256 string, pairs array<bigint>, times array<bigint>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): the number of rows of `aligned` that hold each pair, and whether no pair of its A id has more."""
    counts = landed(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pair-counts")
    first = F.shiftright("pair", _ID_BITS)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))
    # At most a row per id of A, of which there are 2^20 at most.
    return counts.withColumn("a", first).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(docs: DataFrame, byte_name: str, piece_name: str, rules: AlignRules = AlignRules(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row: `n_best`
    counts links to the B ids that go with their A id in most documents, ties included; `count_sum` adds up
    the numbers of documents over all links."""
    rows = landed(aligned(docs, byte_name, piece_name, rules, key, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    known = landed(pair_counts(rows), "scored-pairs")
    links = rows.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    if known.count() <= rules.most_shipped:
        joined = links.join(F.broadcast(known), "pair")  # at most `most_shipped` rows of 17 bytes
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(rules.salts - 1))).alias("salt")
        links = links.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(rules.salts)).cast("int"))
        joined = links.join(known.select("*", salts), ["pair", "salt"])
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (
        rows.drop("pairs", "times")
        .join(sums, "row", "left")
        .select("id", *_COUNTS, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
    )
