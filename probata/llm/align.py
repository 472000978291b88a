"""Banded alignment of two word sequences, by bit vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def bag_bound(a: Sequence, b: Sequence) -> int:
    """No alignment of ``a`` and ``b`` takes fewer edits than this: the longer length less the words in common."""
    return max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values())


def banded_distance(a: Sequence, b: Sequence, most: int) -> int | None:
    """Edits (insert, delete, replace a word) that turn ``a`` into ``b``, or None if they are more than ``most``.

    Only the diagonals within ``most`` of the main one are kept, as the vertical differences of one column in the
    bits of an integer; the window slides down by a row per column.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    lo, n, m = 0, len(a), len(b)
    while lo < m and a[lo] == b[lo]:
        lo += 1
    while m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b, n, m = a[lo:n], b[lo:m], n - lo, m - lo
    if not m:
        return n if n <= most else None
    most = min(most, n)
    width = 2 * most + 2
    full, top = (1 << width) - 1, 1 << width - 1
    places: dict = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    up, down = full ^ (full >> most + 1), 0
    cost, last = most, top >> 1
    for j, w in enumerate(b):
        first = most + 1 - width + j  # row of the window's lowest bit
        hit = places.get(w, 0)
        hit = (hit << -first if first < 0 else hit >> first) & full
        same = ((((hit & up) + up) ^ up) | hit | down) & full
        right = down | full & ~(same | up)
        left = same & up
        if j < n - most:  # down the lowest diagonal
            cost += not same & top
        else:  # then along the last row
            cost += bool(right & last)
            cost -= bool(left & last)
            last >>= 1
        if cost > 2 * most + 1 and j < n - most:
            return None
        low = same >> 1
        up = left | full & ~(low | right)
        down = low & right
    return cost if cost <= most else None
