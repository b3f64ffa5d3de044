"""Secret scanning: fixed patterns, and character Markov models of random strings and ordinary text.

What the patterns find is the labelled sample of random strings; the text outside is the sample of
ordinary identifiers. Transition counts of both are summed over the whole corpus, in arrays of one size per
task. A token of at least `min_chars` characters that no pattern covers is a secret too if its
log-likelihood ratio, random against ordinary, reaches `min_ratio`.

Null and empty texts hold no secrets. Rows that share an id are separate rows. Offsets count code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenkeel.llm.common import col, keyed

# The patterns that the scan must report, and the kinds in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")

_TOKEN = r"[A-Za-z0-9+/_=-]{%d,}"
_HINTS = ("passw", "secret", "token", "api_key", "apikey")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(_ALPHABET) + 1
_CLASS = np.zeros(0x110000, np.uint8)
_CLASS[[ord(c) for c in _ALPHABET]] = np.arange(1, _N)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


@dataclass(frozen=True)
class SecretRules:
    min_chars: int = 20
    min_ratio: float = 14.0
    #: The share of random strings that are uniform over the alphabet instead of like the samples.
    uniform: float = 0.3
    #: How many observed characters the back-off of the ordinary model weighs.
    backoff: float = 20.0


def patterns(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of what the patterns find, by start, then kind."""
    out = []
    low = text.lower()
    if any(hint in low for hint in _HINTS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def transitions(text: str) -> np.ndarray:
    """How often each character of the alphabet follows each; 0 stands for all others."""
    cls = _CLASS[np.frombuffer(text.encode("utf-32-le"), "<u4")].astype(np.int32)
    return np.bincount(cls[:-1] * _N + cls[1:], minlength=_N * _N)


class Models:
    """The log-likelihood ratio of each transition."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray, rules: SecretRules):
        def inner(counts: np.ndarray) -> np.ndarray:
            return counts.reshape(_N, _N)[1:, 1:]

        def rows(counts: np.ndarray) -> np.ndarray:
            return counts / counts.sum(axis=1, keepdims=True)

        # Transitions that ordinary text lacks get the share of their second character in it.
        single = inner(ordinary).sum(axis=0) + 0.5
        usual = rows(inner(ordinary) + rules.backoff * single / single.sum())
        self.rules, self.token = rules, re.compile(_TOKEN % rules.min_chars)
        self.usual, self.sampled = np.log(usual), np.log(rows(inner(random) + 0.1))

    def score(self, token: str) -> float:
        """The log-likelihood ratio of a token. A random string is like the samples or uniform over
        the alphabet, which samples rarely show all of."""
        cls = _CLASS[np.frombuffer(token.encode("utf-32-le"), "<u4")].astype(np.int32) - 1
        pairs = cls[:-1], cls[1:]
        share, even = self.rules.uniform, len(cls[1:]) * np.log(_N - 1)
        drawn = np.logaddexp(np.log(1 - share) + self.sampled[pairs].sum(), np.log(share) - even)
        return float(drawn - self.usual[pairs].sum())

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of all secrets, by start, then kind."""
        found = [(a, kind, z) for a, kind, z, _ in patterns(text)]
        more, k, reach = [], 0, 0
        for m in self.token.finditer(text):
            while k < len(found) and found[k][0] < m.end():
                reach, k = max(reach, found[k][2]), k + 1
            if reach <= m.start() and self.score(m.group()) >= self.rules.min_ratio:
                more.append((m.start(), 3, m.end()))
        return sorted(found + more)


def fit(docs: DataFrame, rules: SecretRules, key: str = "doc_id", text: str = "text") -> Models:
    """Count the transitions of both samples over all rows of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, _N * _N), np.int64)
        for batch in batches:
            for value in batch.column(0):
                whole = value.as_py()
                if not whole:
                    continue
                counts[1] += transitions(whole)
                reach = 0
                for start, _, end, first in patterns(whole):
                    counts[0] += transitions(whole[first:end])
                    if end > reach:
                        counts[1] -= transitions(whole[max(start, reach) : end])
                        reach = end
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts.ravel()[at])], ["cell", "n"])

    rows = keyed(docs, key, text).select("text").mapInArrow(run, "cell bigint, n bigint")
    counts = np.zeros(2 * _N * _N)
    for cell, n in rows.groupBy("cell").agg(F.sum("n")).collect():  # 2 * 68 * 68 rows at most
        counts[cell] = n
    return Models(counts[: _N * _N], counts[_N * _N :], rules)


def scan(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans) for every row: array<struct<kind, start, end>>."""
    rows = keyed(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[kind], "start": a, "end": z} for a, kind, z in models.spans(v.as_py())] for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPANS)], ["id", "spans"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every stretch of secrets replaced by one mask."""
    out, at, reach = [], 0, -1
    for start, _, end in spans:
        if start > reach:
            out += [text[at:start], mask]
        reach = at = max(reach, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, models: Models, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """All rows and columns of `docs`, secrets in `text` masked; null texts stay null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else masked(t, models.spans(t), mask) for t in texts], dtype=object)

    return docs.select(*[run(col(c).cast("string")).alias(c) if c == text else col(c) for c in docs.columns])
