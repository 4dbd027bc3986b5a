"""Portable pseudo-random draws: BIGINT arithmetic that any SQL engine repeats exactly.

Every operand is reduced modulo P before it is multiplied by a constant below 2^31, so no
product reaches 2^63 and ANSI overflow checks never fire.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

P = 2147483647  # 2^31 - 1


def draw(seed: int, a: Column | str, b: Column | str) -> Column:
    """A draw in 0..P-1 for the pair (a, b)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x = (F.lit((seed * 16807 + 12345) % P) + (F.pmod(a, F.lit(P)) * 69621) % P) % P
    x = ((x * 48271) % P + F.pmod(b, F.lit(P))) % P
    x = ((x * 48271) % P + 11) % P
    return (x * 69621 + 7) % P


def draw_sql(seed: int, a: str, b: str) -> str:
    """The same draw as a DuckDB expression."""
    x = f"(({(seed * 16807 + 12345) % P}::BIGINT + (({a}) % {P} * 69621) % {P}) % {P})"
    x = f"(({x} * 48271 % {P} + ({b}) % {P}) % {P})"
    x = f"(({x} * 48271 % {P} + 11) % {P})"
    return f"(({x} * 69621 + 7) % {P})"


def edge_key(*cols: Column | str) -> Column:
    """A stable 60-bit id from natural key columns: no global numbering is needed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 15), 16, 10).cast("long")


def affine_permutation(x: Column, n: int, seed: int, rounds: int = 4) -> Column:
    """A bijection of 0..2^k-1 (n = 2^k) by odd multiplications and xor-shifts."""
    bits = max(1, n.bit_length() - 1)
    mask = (1 << bits) - 1
    half = max(1, bits // 2)
    for r in range(rounds):
        odd = ((seed * 2654435761 + r * 40503 + 1) | 1) & 0x3FFFFFFF & mask | 1
        add = (seed * 97 + r * 7919) & mask
        x = (x * F.lit(odd) + F.lit(add)).bitwiseAND(F.lit(mask))
        x = x.bitwiseXOR(F.shiftright(x, half))
    return x
