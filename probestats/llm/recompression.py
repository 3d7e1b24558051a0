"""Recompression: a run-length grammar over many sequences at once, and longest common extensions on it.

Blocks of one symbol and pairs of symbols are replaced in turn, everywhere alike, until each sequence is one symbol. Equal
symbols of a level stand for equal words, so two places are compared by climbing while the symbols that start (or
end) there are equal and going down again from the first that differ: a few steps a level, for all queries together.
"""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """The levels of a concatenation of sequences; ``walls`` are places whose symbols occur nowhere else and are never paired.

    All levels lie one after the other in flat arrays: ``symbol``, ``up`` (the place above, -1 at the top) and ``down``
    (the first place below). Even levels lie under blocks, odd ones under pairs.
    """

    def __init__(self, symbols: np.ndarray, walls: np.ndarray):
        n_names = int(symbols.max()) + 1 if len(symbols) else 0
        names, wall = symbols.astype(np.int64), np.zeros(len(symbols), bool)
        wall[walls] = True
        down = np.zeros(len(symbols), np.int64)  # never followed on the ground
        self._symbol, self._up, self._down, self._offset = [names], [], [down], [0]
        level = 0
        while len(names) > 1 and bool((~wall[1:] & ~wall[:-1]).any()):
            first, above, n_names = self._blocks(names, n_names) if level % 2 == 0 else self._pairs(names, wall, n_names, level)
            start = self._offset[-1]
            self._offset.append(start + len(names))
            ups = np.zeros(len(names), np.int64)
            ups[first[1:]] = 1
            self._up.append(np.cumsum(ups) + self._offset[-1])
            self._down.append(first + start)
            self._symbol.append(above)
            names, wall, level = above, wall[first], level + 1
        self._up.append(np.full(len(names), -1, np.int64))
        self.symbol, self.up = np.concatenate(self._symbol), np.concatenate(self._up).astype(np.int32)
        # one place more, so that the last place below ``k`` is always ``down[k + 1] - 1``: levels follow each other
        self.down = np.append(np.concatenate(self._down), self._offset[-1]).astype(np.int32)
        del self._symbol, self._up, self._down

    @staticmethod
    def _blocks(names: np.ndarray, n_names: int) -> tuple[np.ndarray, np.ndarray, int]:
        first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        size = np.diff(np.r_[first, len(names)])
        above = names[first]
        many = np.flatnonzero(size > 1)
        if len(many):
            found, which = np.unique(above[many] * np.int64(size.max() + 1) + size[many], return_inverse=True)
            above[many] = n_names + which
            n_names += len(found)
        return first, above, n_names

    @staticmethod
    def _pairs(names: np.ndarray, wall: np.ndarray, n_names: int, level: int) -> tuple[np.ndarray, np.ndarray, int]:
        mixed = (names.astype(np.uint64) + np.uint64(level)) * _MIX
        left = ((mixed ^ (mixed >> np.uint64(29))) * _MIX) >> np.uint64(63) == 1
        free = ~wall[:-1] & ~wall[1:]
        ways = [free & left[:-1] & ~left[1:], free & ~left[:-1] & left[1:]]
        opens = max(ways, key=np.count_nonzero)  # of the two ways to deal the symbols, that with more pairs
        first = np.flatnonzero(np.r_[True, ~opens])
        above = names[first]
        at = np.flatnonzero(opens)
        if len(at):
            found, which = np.unique(names[at] * np.int64(n_names) + names[at + 1], return_inverse=True)
            above[np.searchsorted(first, at)] = n_names + which
            n_names += len(found)
        return first, above, n_names

    def extend(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """For each pair of ground places i < j, how many symbols from there are equal, to the right (``step`` 1) or left (-1).

        Each pair must meet a wall in that direction.
        """
        a, b = i.astype(np.int64), j.astype(np.int64)
        level, climbing = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        symbol, up, down = self.symbol, self.up, self.down
        while len(live):
            equal = symbol[a] == symbol[b]
            climbing &= equal
            # equal places go up where symbols that start (end) here are equal above as well, otherwise on
            pa, pb = up[a], up[b]
            has = equal & (pa >= 0)
            pa0, pb0 = np.where(has, pa, 0), np.where(has, pb, 0)
            if step > 0:
                edge_a, edge_b = down[pa0] == a, down[pb0] == b
                left_a, left_b = down[pa0 + 1] - a, down[pb0 + 1] - b
            else:
                edge_a, edge_b = down[pa0 + 1] - 1 == a, down[pb0 + 1] - 1 == b
                left_a, left_b = a - down[pa0] + 1, b - down[pb0] + 1
            rise = climbing & has & edge_a & edge_b & (symbol[pa0] == symbol[pb0])
            # under blocks as far as both blocks reach, under pairs one symbol
            on = np.where(has & (level % 2 == 0), np.minimum(left_a, left_b), 1)
            sink = ~equal & (level > 0)
            done = ~equal & (level == 0)
            if done.any():
                out[live[done]] = (a[done] - i[live[done]]) * step
            below_a = down[a] if step > 0 else down[a + 1] - 1
            below_b = down[b] if step > 0 else down[b + 1] - 1
            a = np.where(rise, pa0, np.where(equal, a + step * on, np.where(sink, below_a, a)))
            b = np.where(rise, pb0, np.where(equal, b + step * on, np.where(sink, below_b, b)))
            level = level + rise - sink
            go = ~done
            live, a, b, level, climbing = live[go], a[go], b[go], level[go], climbing[go]
        return out
