"""Reproducible random draws.

A draw is a hash of the seed and the identity of what is drawn, so it does not depend on row order,
partitioning or retries, and any engine with md5 gives the same one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F


CELL_DIGITS = 4


def draw_key(seed: int, *parts: Column) -> Column:
    """Uniform text of hex digits: sorting by it shuffles the rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw_cell(key: Column) -> Column:
    """The first digits of a draw key: 65,536 equally likely cells that sort like the keys."""
    return F.substring(key, 1, CELL_DIGITS)


def draw32(seed: int, *parts: Column) -> Column:
    """Uniform integer in [0, 2**32)."""
    return F.conv(F.substring(draw_key(seed, *parts), 1, 8), 16, 10).cast("bigint")


def drawn32(*parts: object) -> int:
    """``draw32`` of seed and parts, outside of a query."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


#: Times that a permuted number may lie outside before it is an error; each time is one in sqrt(n).
WALKS = 64


def permuted(x: Column, n: Column, seed: int, *key: Column) -> Column:
    """Place of ``x`` in a permutation of 0 .. n - 1 that seed and key choose.

    The numbers stand on a grid of a rows and b columns, the smallest near-square one that holds n. Four times, rows
    or columns are shifted by a draw that the other coordinate decides, which moves every place to another one. A number
    that comes to lie beyond n is moved on until it does not (cycle walking). So a prefix of a permutation costs as many
    draws as it has numbers, whatever n.
    """
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)

    def draw(turn: int, other: Column) -> Column:
        return draw32(seed, *key, F.lit(turn), other)

    def moved(number: Column) -> Column:
        column = number % b
        first = (F.floor(number / b).cast("bigint") + draw(0, column)) % a
        return _named(first, lambda row: _named((column + draw(1, row)) % b, lambda col: _named((row + draw(2, col)) % a, lambda r: r * b + (col + draw(3, r)) % b)))

    def walked(once: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(WALKS))
        outside = F.raise_error(F.lit("a permuted number stays outside")).cast("bigint")
        return F.aggregate(steps, once, lambda at, _: F.when(at < n, at).otherwise(moved(at)), lambda at: F.when(at < n, at).otherwise(outside))

    return _named(moved(x), lambda once: F.when(once < n, once).otherwise(walked(once)))


def place(x: int, n: int, *key: object) -> int:
    """``permuted`` of ``x`` under a key that begins with the seed, outside of a query."""
    a = math.ceil(math.sqrt(n))
    b = math.ceil(n / a)
    for _ in range(WALKS):
        row, column = divmod(x, b)
        for turn in (0, 2):
            row = (row + drawn32(*key, turn, column)) % a
            column = (column + drawn32(*key, turn + 1, row)) % b
        x = row * b + column
        if x < n:
            return x
    raise ValueError("a permuted number stays outside")


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value.cast("bigint")), lambda v: use(v).cast("bigint")), F.lit(0))
