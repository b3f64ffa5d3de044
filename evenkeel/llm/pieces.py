"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding.

A text becomes one array of symbols. It is cut wherever no piece of the vocabulary holds the two
characters side by side, as no merge can cross such a place; what lies between two cuts is a
unit. Units that a worker hasn't met yet are laid end to end in flat arrays and merged in
rounds: look up the rank of every adjacent pair, take the least rank of each unit, merge all its
leftmost non-overlapping occurrences at once, compact, until no pair remains. Where a merge
brings forth a pair that would come before the unit's other merges, only the leftmost one is done
in that round, so that the result is that of merging one by one.

Nulls in: nulls out of `encode` and `decode`. An empty text has no ids; no ids decode to an empty text.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from evenkeel.llm.common import col, free_name

SPACE = "▁"
_NONE = np.int64(1) << 40


def _replace_each(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("one_per_byte", _replace_each)


class PieceModel:
    """A BPE model file with identity normalisation. `max_units` bounds the memory of a worker."""

    def __init__(self, path: str, max_units: int = 300_000):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        plain = model.trainer_spec.model_type == 2 and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        if not plain or not norm.add_dummy_prefix or model.trainer_spec.treat_whitespace_as_suffix or not norm.escape_whitespaces:
            raise ValueError("only BPE models with identity normalisation and a dummy prefix are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.max_units, self.known = max_units, {}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self._set_chars(ids)
        self._set_pairs(ids, np.array([p.score for p in model.pieces]))
        self._set_surfaces(model, kinds)
        self.run = self._safe_run(ids)

    def _set_chars(self, ids: dict[str, int]) -> None:
        """Dense numbers for the characters of the vocabulary, and which may stand side by side."""
        chars = sorted({c for piece in ids for c in piece})
        self.char = np.zeros(0x110000, np.int32)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for piece in ids:
            dense = self.char[[ord(c) for c in piece]]
            self.beside[dense[:-1], dense[1:]] = True
        self.char_id = np.full(len(chars) + 1, -1, np.int64)
        for number, c in enumerate(chars, 1):
            self.char_id[number] = ids.get(c, -1)

    def _set_pairs(self, ids: dict[str, int], score: np.ndarray) -> None:
        """All pairs of pieces whose concatenation is a piece, sorted by key, with rank and result."""
        pairs = [(ids[p[:k]], ids[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.n = len(score)
        key = left * self.n + right
        order = np.argsort(key)
        self.key, self.merged = key[order], merged[order]
        self.rank = np.unique(-score[self.merged], return_inverse=True)[1].astype(np.int64)

    def _set_surfaces(self, model, kinds) -> None:
        unk = (model.trainer_spec.unk_surface or " ⁇ ").encode()
        out = []
        for p in model.pieces:
            if p.type == kinds.BYTE:
                out.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.CONTROL:
                out.append(b"")
            else:
                out.append(unk if p.type == kinds.UNKNOWN else p.piece.replace(SPACE, " ").encode())
        self.length = np.array([len(x) for x in out], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.surface = np.frombuffer(b"".join(out), np.uint8)
        self.control = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.leads = np.array([p.type == kinds.NORMAL and p.piece.startswith(SPACE) for p in model.pieces])

    def _safe_run(self, ids: dict[str, int]) -> int:
        """The length at which a long run of spaces may be cut from the left, or 0. Pieces of
        spaces alone may tie in rank; then merging goes from the left, and full pieces come first."""
        runs = [len(p) for p in ids if set(p) == {SPACE}]
        if max(runs, default=1) < 2 or any(SPACE * 2 in p and set(p) != {SPACE} for p in ids):
            return 0
        m = max(runs)
        longest = self._merge([SPACE * k for k in range(1, 3 * m + 1)])
        full = longest[m - 1]
        return m if len(full) == 4 and all(longest[k - 1] == full + longest[k - m - 1] for k in range(m + 1, 3 * m + 1)) else 0

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; _NONE where there is no such piece."""
        if not len(self.key):
            return np.full(len(left), _NONE), np.full(len(left), -1)
        key = np.where((left >= 0) & (right >= 0), left * self.n + right, -1)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], _NONE), np.where(hit, self.merged[at], -1)

    def _merge(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as the bytes of 32-bit integers."""
        code = np.frombuffer("".join(units).encode("utf-32-le"), "<u4")
        sym = self.char_id[self.char[code]]
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        # Symbols that are no piece keep their character, as -2 - code point, and never merge.
        sym = np.where(sym < 0, -2 - code.astype(np.int64), sym)
        ended_sym, ended_unit = [], []
        while len(sym):
            same = np.append(unit[1:] == unit[:-1], False)
            rank, merged = self._look(sym, np.append(sym[1:], -1))
            rank = np.where(same, rank, _NONE)
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            width = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            open_ = np.repeat(least < _NONE, width)
            if not open_.all():
                ended_sym.append(sym[~open_])
                ended_unit.append(unit[~open_])
                sym, unit, rank, merged = sym[open_], unit[open_], rank[open_], merged[open_]
                if not len(sym):
                    break
                kept = least < _NONE
                least, width = least[kept], width[kept]
            take = rank == np.repeat(least, width)
            take = self._leftmost(take)
            take = self._alone_where_needed(take, sym, unit, merged, rank)
            sym = np.where(take, merged, sym)
            stays = ~np.append(False, take[:-1])
            sym, unit = sym[stays], unit[stays]
        sym, unit = np.concatenate(ended_sym), np.concatenate(ended_unit)
        order = np.argsort(unit, kind="stable")
        return self._to_bytes(sym[order], unit[order], len(units))

    @staticmethod
    def _leftmost(take: np.ndarray) -> np.ndarray:
        """Of neighbours that overlap, every second one from the left."""
        at = np.flatnonzero(take)
        starts = np.append(True, np.diff(at) > 1)
        since = np.arange(len(at)) - np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
        out = np.zeros_like(take)
        out[at[since % 2 == 0]] = True
        return out

    def _alone_where_needed(self, take, sym, unit, merged, rank) -> np.ndarray:
        """Leave only the leftmost merge of a unit if one of its merges makes a pair of the same or a better rank."""
        at = np.flatnonzero(take)
        u = unit[at]
        if len(u) == len(np.unique(u)):
            return take
        n = len(sym)
        new, own = merged[at], rank[at]
        before = np.maximum(at - 1, 0)
        left = np.where(take[np.maximum(at - 2, 0)] & (at >= 2), merged[np.maximum(at - 2, 0)], sym[before])
        has_left = (at >= 1) & (unit[before] == u)
        after = np.minimum(at + 2, n - 1)
        has_right = (at + 2 < n) & (unit[after] == u)
        bad = (has_left & (self._look(left, new)[0] <= own)) | (has_right & (self._look(new, sym[after])[0] <= own))
        if not bad.any():
            return take
        first = np.append(True, u[1:] != u[:-1])
        drop = at[np.isin(u, u[bad]) & ~first]
        out = take.copy()
        out[drop] = False
        return out

    def _to_bytes(self, sym: np.ndarray, unit: np.ndarray, n: int) -> list[bytes]:
        ids: np.ndarray | list = sym
        if (sym < 0).any():
            ids, owner = [], []
            for s, u in zip(sym.tolist(), unit.tolist()):
                got = [s] if s >= 0 else [self.unknown] if self.byte_ids is None else [self.byte_ids[b] for b in chr(-2 - s).encode()]
                ids += got
                owner += [u] * len(got)
            unit = np.array(owner)
        ends = np.searchsorted(unit, np.arange(n + 1)) * 4
        flat = np.asarray(ids, "<i4").tobytes()
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        dense = self.char[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        cuts = (np.flatnonzero(~self.beside[dense[:-1], dense[1:]]) + 1).tolist()
        if self.run and SPACE * (self.run + 1) in text:
            more = {at for m in re.finditer(f"{SPACE}{{{self.run + 1},}}", text) for at in range(m.start() + self.run, m.end(), self.run)}
            cuts = sorted(more.union(cuts))
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        block = [self.units(text) for text in texts]
        if len(self.known) > self.max_units:
            self.known.clear()
        new = list(set().union(*block).difference(self.known))
        self.known.update(zip(new, self._merge(new) if new else []))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, units)), "<i4") for units in block]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces join to characters, bytes that form none become U+FFFD each,
        control pieces vanish, and the dummy prefix goes."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n):
            raise ValueError("id out of range")
        parts = np.split(ids, np.flatnonzero(self.control[ids])) if self.control[ids].any() else [ids]
        texts = [t for t in (self._joined(part[~self.control[part]]) for part in parts) if t]
        first = ids[~self.control[ids]][:1]
        return "".join(texts)[int(len(first) and self.leads[first[0]]) :]

    def _joined(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - length), length)
        return self.surface[at].tobytes().decode("utf-8", "one_per_byte")


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def ship(spark: SparkSession, path: str) -> str:
    """Send the model file to all executors; the name to give to `encode` and `decode`."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _blocks(column: pa.Array, most: int) -> Iterator[tuple[int, list]]:
    """The values of a column in runs of rows that hold about `most` characters or ids; (first row, values)."""
    out, held, at = [], 0, 0
    for k, value in enumerate(column):
        value = value.as_py() if pa.types.is_string(column.type) else value.values.to_numpy() if value.is_valid else None
        out.append(value)
        held += 0 if value is None else len(value)
        if held > most:
            yield at, out
            out, held, at = [], 0, k + 1
    if out:
        yield at, out


def _listed(ids: list[np.ndarray | None]) -> pa.Array:
    """Arrays of ids as one column; nulls stay null."""
    ends = np.cumsum([0, *(0 if x is None else len(x) for x in ids)])
    starts = pa.array(ends.astype(np.int32), mask=np.array([*(x is None for x in ids), False]))
    flat = [x for x in ids if x is not None]
    return pa.ListArray.from_arrays(starts, pa.array(np.concatenate(flat) if flat else np.array([], np.int32), pa.int32()))


def encode(docs: DataFrame, name: str, keep: Sequence[str] = ("doc_id",), text: str = "text", decoded: bool = False) -> DataFrame:
    """The columns `keep` and `ids` for every row, and `decoded`, the text of these ids, if asked
    for in the same pass. The new names get a mark if `keep` has them already."""
    rows = docs.select(*map(col, keep), col(text).cast("string").alias("_text"))
    new = [free_name(docs.select(*map(col, keep)), n) for n in ("ids", "decoded")[: 1 + decoded]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(SparkFiles.get(name))
        for batch in batches:
            for at, texts in _blocks(batch.columns[-1], 1_000_000):
                ids = pieces.encode([t or "" for t in texts])
                ids = [None if t is None else x for t, x in zip(texts, ids)]
                out = [*batch.slice(at, len(texts)).columns[:-1], _listed(ids)]
                if decoded:
                    out.append(pa.array([None if x is None else pieces.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [*keep, *new])

    schema = StructType([rows.schema[c] for c in keep] + [StructField(new[0], ArrayType(IntegerType()))])
    return rows.mapInArrow(run, schema.add(new[1], "string") if decoded else schema)


def decode(rows: DataFrame, name: str, key: str = "id", ids: str = "ids") -> DataFrame:
    """(id, text) for every row with an array of ids."""
    rows = rows.select(col(key).alias("id"), col(ids).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(SparkFiles.get(name))
        for batch in batches:
            for at, arrays in _blocks(batch.column(1), 1_000_000):
                texts = pa.array([None if x is None else pieces.decode(x) for x in arrays], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(arrays)), texts], ["id", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string")
