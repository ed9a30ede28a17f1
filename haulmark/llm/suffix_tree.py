"""Suffix trees of integer sequences, with constant-time longest common extensions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_END = -1  # below every symbol, and nowhere else in a sequence


class SuffixTree:
    """Ukkonen's tree of a sequence of symbols of 0 or more, and look-ups in it.

    ``extension(i, j)`` is the length of the longest common prefix of the suffixes at ``i`` and
    ``j``: the string depth of the lowest common ancestor of two leaves.  The Euler tour is kept
    as one entry per descent, the depth of the parent; the least entry between two leaves is the
    depth of their ancestor, and a sparse table of minima over powers of two answers that in
    constant time, for whole arrays of pairs at once.
    """

    def __init__(self, symbols: Sequence[int]):
        self.size = len(symbols)
        self._build([*symbols, _END])
        leaves, place, parent_depth = self._tour(ascending=True)
        self.rank = leaves
        self._place = place
        self._minima = _sparse_table(parent_depth)

    def _build(self, s: list[int]) -> None:
        children: list[dict[int, int]] = [{}]
        start, end, link = [0], [0], [0]
        n = len(s)
        node = edge = length = open_suffixes = 0
        for i, c in enumerate(s):
            unlinked = 0
            open_suffixes += 1
            while open_suffixes:
                if not length:
                    edge = i
                first = s[edge]
                below = children[node].get(first)
                if below is None:
                    children[node][first] = len(start)
                    children.append({})
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = node
                else:
                    span = (end[below] if end[below] <= i else i + 1) - start[below]
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if s[start[below] + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(start)
                    children[node][first] = middle
                    start += (start[below], i)
                    end += (start[below] + length, n)
                    link += (0, 0)
                    start[below] += length
                    children.append({c: middle + 1, s[start[below]]: below})
                    children.append({})
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_suffixes + 1
        self._children, self._start, self._end = children, start, end

    def _tour(self, ascending: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rank of every suffix among the leaves, its place in the tour, and the tour's depths."""
        children, start, end = self._children, self._start, self._end
        total = self.size + 1
        rank, place = [0] * total, [0] * total
        depths: list[int] = []
        seen = 0
        todo = [(0, 0, 0)]
        while todo:
            node, above, depth = todo.pop()
            depths.append(above)
            below = children[node]
            if not below and node:
                suffix = total - depth
                rank[suffix] = seen
                place[suffix] = len(depths) - 1
                seen += 1
                continue
            # The stack reverses: the end of the sequence has to come first in both orders.
            order = sorted(below, reverse=ascending)
            if not ascending and order and order[0] == _END:
                order = [*order[1:], _END]
            for symbol in order:
                child = below[symbol]
                todo.append((child, depth, depth + end[child] - start[child]))
        return np.array(rank), np.array(place), np.array(depths, dtype=np.int32)

    def reversed_rank(self) -> np.ndarray:
        """Ranks of the suffixes where larger symbols come first; the end still comes first."""
        return self._tour(ascending=False)[0]

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefix of the suffixes at i and j (different places, 0 to size)."""
        a, b = self._place[i], self._place[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self._minima[level, low], self._minima[level, high - (1 << level)])


def _sparse_table(values: np.ndarray) -> np.ndarray:
    levels = max(1, len(values).bit_length())
    table = np.empty((levels, len(values)), dtype=values.dtype)
    table[0] = values
    for k in range(1, levels):
        half = 1 << (k - 1)
        table[k] = table[k - 1]
        table[k, : len(values) - half] = np.minimum(table[k - 1, : len(values) - half], table[k - 1, half:])
    return table
