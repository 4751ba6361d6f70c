"""Longest-previous-factor arrays over strings on end.

The factor of a position is the longest stretch that starts there and also starts at an earlier
position; it ends with its string. Suffixes are put in order by prefix doubling, whose ranks also give the
longest common prefix of any two suffixes. In suffix order, the best earlier match of a suffix is its
previous or its next smaller position, so the factor's length is the greater of the two common prefixes.
Smaller positions are found for all suffixes at once: a pointer that ends at a larger position goes on from where that one points to.
"""

from __future__ import annotations

import numpy as np


def _places(values: np.ndarray) -> np.ndarray:
    """How many values are less than each."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    out = np.empty(len(values), np.uint32)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(values)), 0))
    return out


def doubled(data: np.ndarray, left: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 8, 16, 32, ... bytes, and their first 8 bytes; left: the bytes up to the end of each one's string.

    A rank is the number of suffixes before its class, so a class of one keeps its rank from round to round. Behind its string a
    suffix is as if filled up with something less than any byte.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").reshape(-1).astype(np.uint64)
    short = np.flatnonzero(left < 8)
    eight[short] &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - left[short].astype(np.uint64)))
    rank = _places(eight)
    if len(short):  # a zero byte comes after the end
        rank = _places(rank.astype(np.uint64) << np.uint64(4) | np.minimum(left, 8).astype(np.uint64))
    ranks, depth, longest = [rank], 8, int(left.max(initial=0))
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while depth < longest and len(tied):
        ahead = np.zeros(len(tied), np.uint64)
        on = left[tied] > depth
        ahead[on] = rank[tied[on] + depth].astype(np.uint64) + np.uint64(1)
        both = rank[tied].astype(np.uint64) << np.uint64(32) | ahead
        order = np.argsort(both)
        tied, both = tied[order], both[order]
        here = np.arange(len(tied))
        new, fresh = np.ones(len(tied), bool), np.ones(len(tied), bool)
        new[1:] = both[1:] >> np.uint64(32) != both[:-1] >> np.uint64(32)
        fresh[1:] = both[1:] != both[:-1]
        start = np.maximum.accumulate(np.where(fresh, here, 0))
        rank = rank.copy()
        rank[tied] += (start - np.maximum.accumulate(np.where(new, here, 0))).astype(np.uint32)
        ranks.append(rank)
        depth *= 2
        tied = tied[~(fresh & np.append(fresh[1:], True))]
    return ranks, eight


def common(ranks: list[np.ndarray], eight: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The longest common prefix of suffixes x and y, within their strings."""
    x, y = x.copy(), y.copy()
    most = np.minimum(left[x], left[y])
    out = np.zeros(len(x), np.int64)
    n = len(left)
    for k in range(len(ranks) - 1, -1, -1):
        step = 8 << k
        for _ in range(2 if k == len(ranks) - 1 else 1):  # all distinct, or as deep as the longest string: once is enough, twice does no harm
            same = (out < most) & (ranks[k][x] == ranks[k][y])
            out[same] += step
            x[same] = np.minimum(x[same] + step, n - 1)
            y[same] = np.minimum(y[same] + step, n - 1)
    rest = np.flatnonzero(out < most)
    differ = eight[x[rest]] ^ eight[y[rest]]
    for byte in range(8):
        differ_here = (differ >> np.uint64(56 - 8 * byte)) == 0
        out[rest[differ_here]] += 1
    return np.minimum(out, most)


def smaller(position: np.ndarray, between: np.ndarray) -> np.ndarray:
    """For each element of a sequence the least of between on the way back to the nearest element of smaller position, 0 without one.

    between[i] belongs to elements i - 1 and i; 0 there is a wall.
    """
    n = len(position)
    to = np.arange(n) - 1
    reach = between.copy()
    live = np.flatnonzero((to >= 0) & (reach > 0))
    reach[(to < 0)] = 0
    while len(live):
        live = live[position[to[live]] > position[live]]
        # Where the one pointed at has come to, all at once, so every pointer skips larger positions only.
        via = to[live]
        go, least = to[via], np.minimum(reach[live], reach[via])
        to[live], reach[live] = go, least
        live = live[least > 0]
    return reach


def previous_factors(data: np.ndarray, first: np.ndarray, at_least: int = 1) -> np.ndarray:
    """The length of the factor of every position of the strings on end (first: where they start, one more than strings); 0 for those under at_least."""
    n = len(data)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    size = np.diff(first)
    left = np.repeat(first[1:], size) - np.arange(n)
    ranks, eight = doubled(data, left)
    order = np.argsort(ranks[-1], kind="stable")
    lcp = np.zeros(n + 1, np.int64)
    # Neighbours that differ in the most bytes, up to at_least, that one round of ranks spans needn't be looked at.
    deep = ranks[min(len(ranks) - 1, max(at_least // 8, 1).bit_length() - 1)] if at_least >= 8 else None
    near = np.arange(n - 1) if deep is None else np.flatnonzero(deep[order[:-1]] == deep[order[1:]])
    lcp[1 + near] = common(ranks, eight, left, order[near], order[near + 1])
    lcp[lcp < at_least] = 0
    inside = np.flatnonzero((lcp[:-1] > 0) | (lcp[1:] > 0))
    place, before, after = order[inside], lcp[inside], lcp[inside + 1]
    back = smaller(place, before)
    ahead = smaller(place[::-1], after[::-1])[::-1]
    out[place] = np.maximum(back, ahead)
    return out
