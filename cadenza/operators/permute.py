"""Keyed permutations and draws in plain arithmetic and md5, so that any engine can repeat them; no sort, no random stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multipliers of two linear congruential steps modulo 2**31.
FIRST, SECOND, MODULUS, ROUNDS = 1103515245, 69069, 1 << 31, 4


def _mixed(x: Column, key: Column) -> Column:
    """28 bits of two linear congruential steps; products stay below 2**62."""
    h = (x * F.lit(FIRST) + key) % F.lit(MODULUS)
    return F.floor((h * F.lit(SECOND) + key) % F.lit(MODULUS) / F.lit(8))


def _rounds(x: Column, side: Column, key: Column) -> Column:
    """A Feistel network on pairs below ``side``: a bijection of the numbers below its square."""
    left, right = F.floor(x / side), x % side
    for i in range(ROUNDS):
        left, right = right, (left + _mixed(right, (key + F.lit(i * 7919)) % F.lit(MODULUS))) % side
    return left * side + right


def permuted(i: Column, n: Column, key: Column) -> Column:
    """Where the row with number ``i`` (0 to n - 1) goes in the permutation of n numbers that ``key`` (at least 0) names.

    Numbers that the network sends to n or beyond walk on along their cycle until they are below it; few do, as the
    network's square is less than 2 * sqrt(n) + 1 beyond n.
    """
    i, n, key = i.cast("long"), n.cast("long"), key.cast("long") % F.lit(MODULUS)
    side = F.ceil(F.sqrt(n.cast("double")))
    first = _rounds(i, side, key)
    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), side * side - n + 1), first, lambda x, _: F.when(x < n, x).otherwise(_rounds(x, side, key)))
    return F.when(first < n, first).otherwise(walk)


def drawn(seed: int, *keys: Column, part: int = 0) -> Column:
    """A whole number below 2**32 that depends on the seed and the keys alone; ``part`` 0 to 3 gives independent ones."""
    said = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(said, 8 * part + 1, 8), 16, 10).cast("long")


def rounds_sql(x: str, side: str, key: str) -> str:
    """``_rounds`` as SQL whose ``//`` divides whole numbers; for queries that check it."""
    left, right = f"({x} // {side})", f"({x} % {side})"
    for i in range(ROUNDS):
        k = f"(({key} + {i * 7919}) % {MODULUS})"
        mixed = f"((((({right} * {FIRST} + {k}) % {MODULUS}) * {SECOND} + {k}) % {MODULUS}) // 8)"
        left, right = right, f"(({left} + {mixed}) % {side})"
    return f"({left} * {side} + {right})"
