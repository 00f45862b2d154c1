"""Links of a given Jaccard similarity among sets of hashes, exact: no pair that has it is left out, no other is taken.

A set of n tokens that is similar to another by a share t has ceil(t * n) tokens in common with it at least, so the two
share one of the first n - ceil(t * n) + 1 tokens of each, in any one order of tokens. The order is rare tokens first, so
that sets which share a common passage only do not meet.
"""

from __future__ import annotations

import numpy as np

from .common import ranges

#: For shares that are no binary fractions: 4 of 5 tokens are a share of 0.8.
SLACK = 1e-9


def alike(a: np.ndarray, b: np.ndarray, share: float) -> bool:
    """Whether two sets are similar by share at least."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= share * (len(a) + len(b) - both) - SLACK


def spanning_links(sets: list[np.ndarray], share: float, known: np.ndarray | None = None) -> tuple[list[int], list[int]]:
    """Pairs of rows, each similar by share at least, that join all rows which such pairs join; sets without repeats or empty ones.

    known: for each row, a row that stands for those it is joined with already, as by links of the caller, which are left out.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    known = np.arange(m) if known is None else known
    if (known == known[0]).all():
        return [], []
    values, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(values))
    row = np.repeat(np.arange(m), sizes)
    token = rank[token]
    token = token[np.lexsort((token, row))]
    starts = np.cumsum(sizes) - sizes
    heads = sizes - np.ceil(share * sizes - SLACK).astype(np.int64) + 1
    at = ranges(starts, heads)
    at = at[np.argsort(token[at], kind="stable")]
    keys, rows = token[at], row[at]
    marked, waiting = np.zeros(len(values), bool), np.ones(m, bool)
    joined: dict[int, list[int]] = {}
    for i, c in enumerate(known.tolist()):
        joined.setdefault(c, []).append(i)

    def take(found: list[int]) -> list[int]:
        """The rows that wait among those known to be joined with the found ones, which wait no more."""
        out = []
        for i in found:
            if waiting[i]:
                out += joined[known[i]]
                waiting[joined[known[i]]] = False
        return out

    indexed = left = m
    a: list[int] = []
    b: list[int] = []
    for first in range(m):
        if not waiting[first]:
            continue
        queue = take([first])
        left -= len(queue)
        while queue and left:
            if left < indexed // 2:
                open_ = waiting[rows]
                keys, rows, indexed = keys[open_], rows[open_], left
            i = queue.pop()
            own = token[starts[i] : starts[i] + sizes[i]]
            head = own[: heads[i]]
            lo = np.searchsorted(keys, head)
            other = rows[ranges(lo, np.searchsorted(keys, head, side="right") - lo)]
            other = np.unique(other[waiting[other]])
            other = other[(sizes[other] >= share * sizes[i] - SLACK) & (share * sizes[other] <= sizes[i] + SLACK)]
            if not len(other):
                continue
            marked[own] = True
            n = sizes[other]
            both = np.add.reduceat(marked[token[ranges(starts[other], n)]].astype(np.int64), np.cumsum(n) - n)
            marked[own] = False
            near = other[both >= share * (n + sizes[i] - both) - SLACK].tolist()
            more = take(near)
            left -= len(more)
            a += [i] * len(near)
            b += near
            queue += more
    return a, b
