"""Comparison of two sequences: edit runs, matched share, common subsequences. Small helpers inside Arrow UDFs."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPCODES = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in ("i1", "i2", "j1", "j2")]]))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of characters, with one bit per character of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def char_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence by the sum of lengths; two empty texts are alike. Null counts as empty."""
    return pd.Series([1.0 if not x and not y else 2 * common_length(x, y) / (len(x) + len(y)) for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])


def likeness(candidate: Column, ours: Column, theirs: Column) -> Column:
    """How like both sides a candidate is: the mean of its character ratios with them."""
    return (char_ratio(candidate, ours) + char_ratio(candidate, theirs)) / 2


def matches(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in memory linear in the lengths: common ends first, then by halves.

    The first half of ``a`` is compared with all beginnings of ``b``, the second with all ends, and ``b`` is cut where
    both together match most.
    """
    codes = {v: i for i, v in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([codes[v] for v in a], np.int64), np.array([codes[v] for v in b], np.int64)
    out: list[tuple[int, int]] = []
    waiting = [(0, len(x), 0, len(y))]
    while waiting:
        i, m, j, n = waiting.pop()
        while i < m and j < n and x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and x[m - 1] == y[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        if m - i == 1:
            at = np.flatnonzero(y[j:n] == x[i])
            if len(at):
                out.append((i, j + int(at[0])))
            continue
        half = (i + m) // 2
        both = _lengths(x[i:half], y[j:n]) + _lengths(x[half:m][::-1], y[j:n][::-1])[::-1]
        cut = j + int(both.argmax())
        waiting += [(i, half, j, cut), (half, m, cut, n)]
    return sorted(out)


def _lengths(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``p`` and each beginning of ``q``."""
    row = np.zeros(len(q) + 1, np.int32)
    for c in p:
        row[1:] = np.maximum(row[1:], row[:-1] + (q == c))
        row = np.maximum.accumulate(row)
    return row


def edit_runs(a: list, b: list) -> list[dict]:
    """equal, replace, delete and insert runs that turn ``a`` into ``b``."""
    out: list[dict] = []
    i = j = 0
    for x, y in [*matches(a, b), (len(a), len(b))]:
        if i < x or j < y:
            tag = "replace" if i < x and j < y else "delete" if i < x else "insert"
            out.append({"tag": tag, "i1": i, "i2": x, "j1": j, "j2": y})
        if x < len(a):
            if out and out[-1]["tag"] == "equal" and out[-1]["i2"] == x and out[-1]["j2"] == y:
                out[-1]["i2"], out[-1]["j2"] = x + 1, y + 1
            else:
                out.append({"tag": "equal", "i1": x, "i2": x + 1, "j1": y, "j2": y + 1})
        i, j = x + 1, y + 1
    return out


@F.pandas_udf(OPCODES)
def opcodes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit runs between two arrays of lines; null counts as empty."""
    return pd.Series([edit_runs([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def line_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched elements of two arrays by the sum of their sizes; two empty ones are alike. Null counts as empty."""

    def one(x: list, y: list) -> float:
        return 2 * len(matches(x, y)) / (len(x) + len(y)) if x or y else 1.0

    return pd.Series([one([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def transplanted(result: pd.Series, side: pd.Series, wanted: pd.Series) -> pd.Series:
    """The lines of a result with the runs of wanted lines of a side put where the side has them: behind the line before the run, if the result has that once, else ahead of the line after it; a run with neither stays out. Arrays of lines; null counts as empty."""

    def one(lines: list, source: list, want: set) -> list:
        out, i = list(lines), 0
        while i < len(source):
            j = i
            while j < len(source) and source[j] in want:
                j += 1
            if j > i:
                if i and out.count(source[i - 1]) == 1:
                    at = out.index(source[i - 1]) + 1
                elif j < len(source) and out.count(source[j]) == 1:
                    at = out.index(source[j])
                else:
                    at = None
                if at is not None:
                    out[at:at] = source[i:j]
            i = j + 1
        return out

    plain = lambda x: [] if x is None else list(x)
    return pd.Series([one(plain(r), plain(s), set(plain(w))) for r, s, w in zip(result, side, wanted, strict=True)])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def increasing(xs: pd.Series) -> pd.Series:
    """A longest strictly increasing subsequence of an array of numbers, by patience piles."""

    def one(x: list) -> list[int]:
        tops: list[int] = []
        at: list[int] = []
        back: list[int] = []
        for i, v in enumerate(x):
            k = bisect_left(tops, v)
            back.append(at[k - 1] if k else -1)
            tops[k : k + 1] = [v]
            at[k : k + 1] = [i]
        out: list[int] = []
        i = at[-1] if at else -1
        while i >= 0:
            out.append(int(x[i]))
            i = back[i]
        return out[::-1]

    return pd.Series([one([] if x is None else list(x)) for x in xs])
