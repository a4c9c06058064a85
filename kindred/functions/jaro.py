"""Jaro-Winkler over whole batches: characters of all pairs as arrays, matches as bit masks.

A batch is first reduced to its distinct pairs. Pairs are taken by the length of their shorter and longer string (up to 8, 16, 32 or
64 characters), so that one step of a loop over positions works on all pairs of a class at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

BOOST_FROM, SCALE, PREFIX = 0.7, 0.1, 4
#: Characters that a mask of 64 bits holds; longer strings are compared one pair at a time.
LONGEST = 64
_CLASSES = (8, 16, 32, LONGEST)
#: Pairs of a class in one step.
AT_ONCE = 1 << 15
_NO_CHARACTER = 0xFFFFFFFF
_ONE = np.uint64(1)


def jaro_winkler(a: str, b: str) -> float:
    """Similarity in [0, 1]; 0 if either side is empty; the prefix boost applies from a Jaro similarity of 0.7 on."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    reach = max(len(long) // 2 - 1, 0)
    taken = [False] * len(long)
    mine = []
    for i, ch in enumerate(short):
        for j in range(max(0, i - reach), min(len(long), i + reach + 1)):
            if not taken[j] and long[j] == ch:
                taken[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [ch for ch, t in zip(long, taken) if t]
    half = sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    if jaro < BOOST_FROM:
        return jaro
    same = 0
    for x, y in zip(a[:PREFIX], b[:PREFIX]):
        if x != y:
            break
        same += 1
    return jaro + SCALE * same * (1 - jaro)


def _codes(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Code points of each string in a row of `width`, filled up with what is no character."""
    at = np.arange(width)[None, :]
    inside = at < lengths[:, None]
    return np.where(inside, flat[np.where(inside, starts[:, None] + at, 0)], np.uint32(_NO_CHARACTER))


def _class(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, swapped: np.ndarray) -> np.ndarray:
    """Similarities of rows of a (the shorter ones) and b; swapped: whether a is the second string of its pair."""
    n = len(a)
    columns_b = np.ascontiguousarray(b.T)
    reach = np.maximum(lb // 2 - 1, 0)
    taken = np.zeros(n, np.uint64)
    hits = np.zeros((a.shape[1], n), bool)
    for i in range(int(la.max())):
        at = a[:, i]
        low, high = np.maximum(i - reach, 0), np.minimum(lb - 1, i + reach)
        equal = np.packbits(b == at[:, None], axis=1, bitorder="little").view(f"<u{b.shape[1] // 8}").ravel().astype(np.uint64)
        size = np.maximum(high - low + 1, 0).astype(np.uint64)
        window = np.where(size >= 64, ~np.uint64(0), (_ONE << np.minimum(size, np.uint64(63))) - _ONE) << low.astype(np.uint64)
        free = equal & window & ~taken
        first = free & (~free + _ONE)
        taken |= first
        hits[i] = first != 0
    m = hits.sum(0)
    # The k-th match of a against the k-th taken character of b: positions of matches, in order, for each row.
    apart = np.zeros(n, np.int64)
    rank = np.cumsum(hits, 0, dtype=np.int8)
    seen = np.zeros((int(m.max()) if n else 0, n), np.uint32)
    for i in range(hits.shape[0]):
        r = np.flatnonzero(hits[i])
        seen[rank[i, r] - 1, r] = a[r, i]
    k = np.zeros(n, np.int64)
    for j in range(b.shape[1]):
        r = np.flatnonzero((taken >> np.uint64(j)) & _ONE)
        apart[r] += seen[k[r], r] != columns_b[j, r]
        k[r] += 1
    some = np.maximum(m, 1)
    one, two = np.where(swapped, lb, la), np.where(swapped, la, lb)
    jaro = (m / one + m / two + (m - apart / 2) / some) / 3
    same, going = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(min(PREFIX, a.shape[1])):
        going &= a[:, i] == b[:, i]
        same += going
    out = np.where(jaro < BOOST_FROM, jaro, jaro + SCALE * same * (1 - jaro))
    return np.where(m == 0, 0.0, out)


def of_arrays(a: pa.Array, b: pa.Array) -> np.ndarray:
    """jaro_winkler of each pair of two string arrays, bit by bit the same; null counts as empty."""
    n = len(a)
    if not n:
        return np.zeros(0)
    coded = pa.concat_arrays([x.cast(pa.large_string()).fill_null("") for x in (a, b)]).dictionary_encode()
    code, names = np.asarray(coded.indices).astype(np.int64), coded.dictionary
    pair, distinct = pd.factorize(code[:n] * len(names) + code[n:])
    one, two = np.divmod(distinct, len(names))
    length = np.asarray(pc.utf8_length(names)).astype(np.int64)
    starts = np.cumsum(length) - length
    flat = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.scalar("", pa.large_string()))[0].as_py().encode("utf-32-le"), "<u4")
    out = np.where((one == two) & (length[one] > 0), 1.0, 0.0)
    kind = np.searchsorted(_CLASSES, length)
    swapped = length[one] > length[two]
    short, long = np.where(swapped, two, one), np.where(swapped, one, two)
    key = np.where((one == two) | (length[short] == 0), -1, kind[short] * 8 + kind[long])
    for k in np.unique(key[key >= 0]).tolist():
        todo = np.flatnonzero(key == k)
        if k % 8 == len(_CLASSES):
            out[todo] = [jaro_winkler(names[x].as_py(), names[y].as_py()) for x, y in zip(one[todo].tolist(), two[todo].tolist())]
            continue
        for at in range(0, len(todo), AT_ONCE):
            r = todo[at : at + AT_ONCE]
            x, y = short[r], long[r]
            out[r] = _class(_codes(flat, starts[x], length[x], _CLASSES[k // 8]), _codes(flat, starts[y], length[y], _CLASSES[k % 8]), length[x], length[y], swapped[r])
    return out[pair]


def of_pairs(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """of_arrays() of Python strings."""
    return of_arrays(pa.array(a, pa.large_string()), pa.array(b, pa.large_string()))


def of_lists(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For two list arrays: similarities of every element of a[k] with every one of b[k], row by row, and the rows' numbers of elements in a and b, and where each row begins.

    Null lists are empty, null elements are empty strings.
    """
    size_a, size_b = (np.asarray(pc.fill_null(pc.list_value_length(x), 0)).astype(np.int64) for x in (a, b))
    at_a, at_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    both = size_a * size_b
    starts = np.cumsum(both) - both
    row = np.repeat(np.arange(len(a)), both)
    place = np.arange(len(row)) - starts[row]
    left, right = at_a[row] + place // size_b[row], at_b[row] + place % size_b[row]
    return of_arrays(a.flatten().take(pa.array(left)), b.flatten().take(pa.array(right))), size_a, size_b, starts


def best_of_each(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the best similarity of every element of a[k] with any of b[k], 0 where there is none; the row k of each; elements of each row)."""
    scores, size_a, size_b, _ = of_lists(a, b)
    rows = np.repeat(np.arange(len(a)), size_a)
    size = size_b[rows]
    best = np.zeros(len(rows))
    some = np.flatnonzero(size)
    if len(some):
        best[some] = np.maximum.reduceat(scores, np.cumsum(size[some]) - size[some])
    return best, rows, size_a
