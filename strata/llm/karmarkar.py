"""Multiway largest differencing (Karmarkar-Karp): deal weights to ``k`` windows with nearly equal sums."""

from __future__ import annotations

import heapq

import numpy as np


def deal(weights: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k - 1) of every weight.

    Every weight starts as a partial partition of its own: itself in one window, nothing in the other k - 1. The two
    partial partitions with the largest imbalance (largest less smallest sum) are merged, the fullest windows of one
    with the emptiest of the other, until one is left. A partial partition is kept as its non-empty sums in descending
    order with a chain of items for each; common sums are not subtracted, only the imbalance orders the heap.
    """
    n = len(weights)
    if n == 0 or k <= 1:
        return np.zeros(n, np.int64)
    after = np.full(n, -1, np.int64)  # next item of the same window
    last = np.arange(n)  # by first item of a chain: its last item
    heap = [(-int(w), i) for i, w in enumerate(weights)]
    parts = {i: (np.array([int(w)], np.int64), np.array([i], np.int64)) for i, w in enumerate(weights)}
    heapq.heapify(heap)
    name = n
    while len(heap) > 1:
        _, one = heapq.heappop(heap)
        _, two = heapq.heappop(heap)
        (a, heads), (b, others) = parts.pop(one), parts.pop(two)
        sums, firsts = a.copy(), heads
        alone = min(len(b), k - len(a))  # the fullest windows of b meet empty ones of a
        met = np.arange(alone, len(b))
        at = k - 1 - met
        sums[at] += b[met]
        after[last[heads[at]]] = others[met]
        last[heads[at]] = last[others[met]]
        sums, firsts = np.concatenate([sums, b[:alone]]), np.concatenate([firsts, others[:alone]])
        order = np.argsort(-sums, kind="stable")
        sums, firsts = sums[order], firsts[order]
        parts[name] = (sums, firsts)
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), name))
        name += 1
    (sums, firsts) = parts[heap[0][1]]
    window = np.zeros(n, np.int64)
    for w, item in enumerate(firsts):
        while item >= 0:
            window[item] = w
            item = after[item]
    return window
