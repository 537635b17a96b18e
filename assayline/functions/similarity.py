"""Similarity of two texts: the few functions that Spark has no expression for (Arrow batches in, Arrow batches out)."""

from __future__ import annotations

from bisect import bisect_right
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Cells of a window that is searched plainly, and places of common runs that are listed, for each character.
_SMALL, _HITS = 1 << 12, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _powers(n: int) -> np.ndarray:
    powers = np.full(n, _BASE, dtype=np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def _prefix(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=out[1:])
    return out


def _longest_match(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Longest common block, first in `a`, then first in `b`: binary search on its size over window hashes."""
    powers = _powers(max(len(a), len(b)) + 1)
    pa, pb = _prefix(a, powers), _prefix(b, powers)
    top = max(len(a), len(b))

    def scaled(prefix, size):
        raw = prefix[size:] - prefix[:-size]
        start = top - size
        return raw * powers[start - np.arange(len(raw))]

    def find(size):
        wa, wb = scaled(pa, size), scaled(pb, size)
        hits = np.flatnonzero(np.isin(wa, wb))
        for i in hits:
            for j in np.flatnonzero(wb == wa[i]):
                if np.array_equal(a[i:i + size], b[j:j + size]):
                    return int(i), int(j)
        return None

    low, high, best = 0, min(len(a), len(b)), (0, 0)
    while low < high:
        mid = (low + high + 1) // 2
        hit = find(mid)
        if hit is None:
            high = mid - 1
        else:
            low, best = mid, hit
    return best[0], best[1], low


def _symbols(codes: np.ndarray) -> np.ndarray:
    """Small numbers in place of code points, equal for equal ones."""
    top = int(codes.max(initial=0)) + 1
    if top > 1 << 16:
        return np.unique(codes, return_inverse=True)[1].astype(np.uint64)
    there = np.zeros(top, dtype=np.uint64)
    there[codes] = 1
    return (np.cumsum(there) - there)[codes]


def _grams(symbols: np.ndarray, width: int, bits: int) -> np.ndarray:
    """The runs of `width` symbols, each packed into one number."""
    out = np.zeros(max(len(symbols) - width + 1, 0), dtype=np.uint64)
    for k in range(width if len(out) else 0):
        out = (out << np.uint64(bits)) | symbols[k:k + len(out)]
    return out


def _common_runs(ga: np.ndarray, gb: np.ndarray, width: int) -> list[tuple[int, int, int]] | None:
    """All maximal common runs of `width` symbols or more as (-size, i, j), the longest first, then by i and j.

    None if there are too many places to list.
    """
    order = np.argsort(gb)
    held = gb[order]
    ends = np.flatnonzero(held[1:] != held[:-1]) + 1
    starts, ends = np.concatenate([[0], ends]), np.concatenate([ends, [len(held)]])
    kinds, counts = held[starts], ends - starts
    kind = np.minimum(np.searchsorted(kinds, ga), len(kinds) - 1)
    found = np.flatnonzero(kinds[kind] == ga)
    at, times = starts[kind[found]], counts[kind[found]]
    hits = int(times.sum())
    if hits > _HITS * (len(ga) + len(gb)):
        return None
    if not hits:
        return []
    i = np.repeat(found, times)
    j = order[np.arange(hits) + np.repeat(at - (np.cumsum(times) - times), times)]
    span = len(ga) + 1  # a free place after each diagonal, so that runs of neighbours do not touch
    places = np.sort((j - i + len(ga)) * span + i)
    ends = np.flatnonzero(places[1:] != places[:-1] + 1) + 1
    first, ends = np.concatenate([[0], ends]), np.concatenate([ends, [hits]])
    sizes = ends - first + (width - 1)
    diagonal, i = np.divmod(places[first], span)
    j = diagonal - len(ga) + i
    ranked = np.lexsort((j, i, -sizes))
    return list(zip((-sizes[ranked]).tolist(), i[ranked].tolist(), j[ranked].tolist()))


def _small_match(a: str, b: str) -> tuple[int, int, int]:
    """Longest common block, first in `a`, then first in `b`, by plain searches."""
    best, size = 0, 0
    for i in range(len(a)):
        while i + size < len(a) and a[i:i + size + 1] in b:
            best, size = i, size + 1
    return best, b.find(a[best:best + size]), size


def _small_chars(a: str, b: str) -> int:
    total, todo = 0, [(a, b)]
    while todo:
        a, b = todo.pop()
        i, j, size = _small_match(a, b)
        if size:
            total += size
            if i and j:
                todo.append((a[:i], b[:j]))
            if i + size < len(a) and j + size < len(b):
                todo.append((a[i + size:], b[j + size:]))
    return total


def _taken_runs(runs: list[tuple[int, int, int]], width: int, n: int, m: int) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Characters of the blocks of `width` or more that the recursion takes out of `runs`, and the windows that are left.

    The longest run that lies within one window is the longest match of that window; one that a block taken before has cut
    is put back as its parts. Windows follow each other in both texts, so they are kept in one order.
    """
    total, starts, windows, cut, k = 0, [0], [(0, n, 0, m)], [], 0
    while k < len(runs) or cut:
        if cut and (k == len(runs) or cut[0] < runs[k]):
            run = heappop(cut)
        else:
            run, k = runs[k], k + 1
        size, i, j = -run[0], run[1], run[2]
        at = bisect_right(starts, i) - 1
        alo, ahi, blo, bhi = windows[at]
        if i + size <= ahi and blo <= j and j + size <= bhi:
            total += size
            windows[at:at + 1] = (alo, i, blo, j), (i + size, ahi, j + size, bhi)
            starts[at:at + 1] = alo, i + size
            continue
        while at < len(windows) and starts[at] < i + size and windows[at][2] < j + size:
            alo, ahi, blo, bhi = windows[at]
            skip = max(0, alo - i, blo - j)
            left = min(size, ahi - i, bhi - j) - skip
            if left >= width:
                heappush(cut, (-left, i + skip, j + skip))
            at += 1
    return total, windows


def matching_chars(a: str, b: str) -> int:
    """Characters in matching blocks: take the longest common block, go on left and right of it.

    All common runs of a few characters are listed at once and taken by length; what is left between them is looked at for
    shorter ones. Where the runs are too many to list, one block is found by the hashed search. Whole texts are compared,
    none is cut.
    """
    symbols = _symbols(np.concatenate([_codes(a), _codes(b)]))
    bits = max(int(symbols.max(initial=0)).bit_length(), 4)
    ca, cb = symbols[:len(a)], symbols[len(a):]
    total, todo = 0, [(0, len(a), 0, len(b), 64 // bits)]
    while todo:
        alo, ahi, blo, bhi, width = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        if (ahi - alo) * (bhi - blo) <= _SMALL:
            total += _small_chars(a[alo:ahi], b[blo:bhi])
            continue
        pa, pb = ca[alo:ahi], cb[blo:bhi]
        runs = [] if min(len(pa), len(pb)) < width else _common_runs(_grams(pa, width, bits), _grams(pb, width, bits), width)
        if runs is not None:
            taken, windows = _taken_runs(runs, width, len(pa), len(pb))
            total += taken
            if width > 1:
                todo.extend((alo + w, alo + x, blo + y, blo + z, width // 2) for w, x, y, z in windows if w < x and y < z)
            continue
        i, j, size = _longest_match(pa, pb)
        if size:
            total += size
            todo.append((alo, alo + i, blo, blo + j, width))
            todo.append((alo + i + size, ahi, blo + j + size, bhi, width))
    return total


def sequence_ratio_of(a: str, b: str) -> float:
    if a == b:
        return 1.0
    return 2.0 * matching_chars(a, b) / (len(a) + len(b))


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro-Winkler over UTF-8 bytes; prefix weight 0.1 on at most 4 bytes, for Jaro above 0.7."""
    s, t = a.encode(), b.encode()
    if not s or not t:
        return 0.0
    reach = max(max(len(s), len(t)) // 2 - 1, 0)
    taken = [False] * len(t)
    left = []
    for i, ch in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not taken[j] and t[j] == ch:
                taken[j] = True
                left.append(ch)
                break
    if not left:
        return 0.0
    right = [ch for j, ch in enumerate(t) if taken[j]]
    m = len(left)
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(s) + m / len(t) + (m - swaps) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(s[:4], t[:4])) if x != y), min(4, len(s), len(t)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler_bound(a: Column, b: Column) -> Column:
    """What the Jaro-Winkler similarity of two texts cannot pass, from built-in functions: bytes that both have, counted with
    repeats, are the most that can match, none of them swapped, after a prefix of full weight."""
    def of(both: Column) -> Column:
        left, right = both["left"], both["right"]
        shared = F.aggregate(F.array_distinct(left), F.lit(0), lambda n, x: n + F.least(
            F.size(F.filter(left, lambda y: y == x)), F.size(F.filter(right, lambda y: y == x))))
        jaro = (shared / F.size(left) + shared / F.size(right) + 1) / 3
        return F.when((F.size(left) == 0) | (F.size(right) == 0) | (shared == 0), 0.0).otherwise(jaro + 0.4 * (1 - jaro))

    one = F.struct(F.regexp_extract_all(F.hex(a), F.lit("(..)")).alias("left"), F.regexp_extract_all(F.hex(b), F.lit("(..)")).alias("right"))
    return F.transform(F.array(one), of)[0]


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio without the popularity heuristic; NULL if a side is NULL."""
    return pd.Series([None if x is None or y is None else sequence_ratio_of(x, y) for x, y in zip(a, b)], dtype="float64")


@pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """NULL if a side is NULL. Names repeat, so each pair is worked out once per batch."""
    known: dict[tuple[str, str], float] = {}

    def score(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if (x, y) not in known:
            known[x, y] = jaro_winkler_of(x, y)
        return known[x, y]

    return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")
