"""Keyed permutations of positions, computed without sorting.

A position below n is a place (l, r) in a grid of a x b, the smallest about square one that holds n.
Rounds add a function of one half to the other, modulo its side, which can be undone, so they permute
the grid; a position that lands outside of n goes through the rounds again until it is inside. From
inside it can meet each of the fewer than b + 1 places outside once at most, so that ends.

All is whole-number arithmetic below 2**62, so the same permutation can be written in any SQL.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
#: A prime: 2**31 - 1. Positions are below its square.
PRIME = 2_147_483_647
#: Fixed multipliers of keys and rounds.
_KEY, _ROUND, _MIX = 1_000_003, 7_919, 48_271


def _grid(n: int) -> tuple[int, int]:
    a = max(1, int(n**0.5))
    return a, -(-n // a)


def permuted(at: Column, n: int, key: Column) -> Column:
    """Where a position (from 0, below n) goes in the permutation of a key (0 and more); -1 without a position or key.

    Arrays are turned in the tasks: as one expression a round would be written into the next several times, and lambdas,
    which would bind it, are interpreted for each row.
    """
    if n > PRIME * PRIME:
        raise ValueError("too many positions")
    a, b = _grid(max(n, 1))
    rounds, prime, by_key, by_round, mix = ROUNDS, PRIME, _KEY, _ROUND, _MIX

    def turned(x: np.ndarray, k: np.ndarray) -> np.ndarray:
        half = list(divmod(x, b))
        for i in range(rounds):
            rk = (k % prime * by_key + (i + 1) * by_round) % prime
            m = (half[1 - i % 2] + rk) % prime
            m = (m * m % prime * mix + rk) % prime
            half[i % 2] = (half[i % 2] + m * m % prime) % (b if i % 2 else a)
        return half[0] * b + half[1]

    @F.pandas_udf("long")
    def walked(x: pd.Series, k: pd.Series) -> pd.Series:
        x, k = x.to_numpy("i8"), k.to_numpy("i8")
        x = turned(x, k)
        out = np.flatnonzero(x >= n)
        while len(out) and n > 0:
            x[out] = turned(x[out], k[out])
            out = out[x[out] >= n]
        return pd.Series(x)

    at, key = at.cast("long"), key.cast("long")
    whole = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    # Never null for a position, which a join on it need not ask.
    return F.coalesce(F.when(at.isNotNull() & key.isNotNull(), walked(whole(at), whole(key))), F.lit(-1).cast("long"))


def permuted_sql(source: str, at: str, n: str, key: str) -> tuple[str, str]:
    """The same in SQL: the two members of a recursive table walk(key, pos, n, a, b, place, turns); its rows of turns > 0 and place < n are the result."""
    a = f"greatest(1, CAST(floor(sqrt({n})) AS BIGINT))"
    first = f"SELECT {key} AS key, {at} AS pos, {n} AS n, {a} AS a, ({n} + {a} - 1) // {a} AS b, {at} AS place, 0 AS turns FROM {source}"
    step = "SELECT key, pos, n, a, b, place // b AS l, place % b AS r, turns FROM walk WHERE turns = 0 OR place >= n"
    for i in range(ROUNDS):
        k = f"(((key % {PRIME}) * {_KEY} + {(i + 1) * _ROUND}) % {PRIME})"
        side, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        x = f"(({other} + {k}) % {PRIME})"
        y = f"(({x} * {x} % {PRIME} * {_MIX} + {k}) % {PRIME})"
        new = f"({side} + {y} * {y} % {PRIME}) % {size} AS {side}"
        step = f"SELECT key, pos, n, a, b, {new + ', r' if side == 'l' else 'l, ' + new}, turns FROM ({step})"
    return first, f"SELECT key, pos, n, a, b, l * b + r AS place, turns + 1 AS turns FROM ({step})"
