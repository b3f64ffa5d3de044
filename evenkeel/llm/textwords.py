"""Words of many texts as flat numpy arrays: where they stand, and a 64-bit number for each."""

from __future__ import annotations

import re

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Tokens are runs of letters and digits; everything else parts them.
_BREAK = re.compile(r"[\W_]")
_STEP = np.uint64(0xD6E8FEB86659FD93)
_WORDLIKE = None


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _wordlike() -> np.ndarray:
    """For every code point, whether it belongs to a token; what lower-casing makes of it."""
    global _WORDLIKE
    if _WORDLIKE is None:
        points = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
        lower = [c.lower() for c in points]
        _WORDLIKE = (
            np.array([c.isalnum() for c in points]),
            np.array([ord(low) if len(low) == 1 else ord(c) for c, low in zip(points, lower)], np.uint32),
        )
    return _WORDLIKE


def words(text: str, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number) of every token of a text, in code points; the number depends on the
    lower-cased token only. Long texts are taken in pieces, cut where a token ends."""
    parts, at = [], 0
    for part in _pieces(text, piece):
        start, end, number = _words(part)
        parts.append((start + at, end + at, number))
        at += len(part)
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else _words(text)


def _words(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    alnum, lower = _wordlike()
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    inside = alnum[code]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return start, end, np.array([], np.uint64)
    # A polynomial in an odd base: terms from the left, shifted back to the start of each token.
    power = _powers(len(code))
    terms = np.where(inside, lower[code].astype(np.uint64) + np.uint64(1), np.uint64(0)) * power[0][: len(code)]
    total = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
    number = (total[end] - total[start]) * power[1][start]
    return start, end, mixed(number ^ (end - start).astype(np.uint64))


_POWERS = (np.array([], np.uint64), np.array([], np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        size = max(1 << 17, 1 << n.bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS = tuple(np.cumprod(np.append(np.uint64(1), np.full(size - 1, b)), dtype=np.uint64) for b in (_BASE, inverse))
    return _POWERS


def shingles(numbers: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of `size` words."""
    n = len(numbers) - size + 1
    if n <= 0:
        return np.array([], np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * _STEP + numbers[k : k + n]
    return mixed(out)


def grams(text: str, size: int, piece: int = 1 << 20) -> np.ndarray:
    """A number for each run of `size` characters, lower-cased, within tokens that are given a
    mark at either end."""
    return np.concatenate([_grams(part, size) for part in _pieces(text, piece)]) if text else np.array([], np.uint64)


def _pieces(text: str, piece: int) -> list[str]:
    out, at = [], 0
    while at < len(text):
        cut = _BREAK.search(text, at + piece) if len(text) - at > piece else None
        end = cut.start() if cut else len(text)
        out.append(text[at:end])
        at = end
    return out


def _grams(text: str, size: int) -> np.ndarray:
    alnum, lower = _wordlike()
    code = np.frombuffer(f" {text} ".encode("utf-32-le"), "<u4")
    inside = alnum[code]
    if len(code) < size:
        return np.array([], np.uint64)
    code = np.where(inside, lower[code], 0).astype(np.uint64)
    n = len(code) - size + 1
    whole = np.ones(n, bool)
    for k in range(1, size - 1):
        whole &= inside[k : k + n]
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _STEP + code[k : k + n]
    return mixed(out[whole])
