"""Reproducible draws.

A cell draw is a 64-bit integer that depends only on (seed, label, row id):

    draw = xxhash64(key(seed, label), row)

so a value never changes with partitioning, filters, retries or the presence
of other columns. A cell that needs several independent draws takes them from
numbered slots, and array elements from a slot plus their index. Everything
stays inside whole-stage codegen: a draw is one hash of two longs.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42
DRAW_BITS = 52
DRAW_SPAN = 1 << DRAW_BITS


def draw_key(label: str, seed: int = DEFAULT_SEED) -> int:
    """63-bit key of a labelled column, worked out once on the driver."""
    digest = hashlib.md5(f"{seed}|{label}".encode()).hexdigest()
    return int(digest[:16], 16) >> 1


def cell_draw(row: Column, label: str, seed: int = DEFAULT_SEED) -> Column:
    return F.xxhash64(F.lit(draw_key(label, seed)).cast("bigint"), row.cast("bigint"))


def slot(draw: Column, n: int) -> Column:
    """Independent draw number ``n`` of the same cell."""
    return F.xxhash64(F.lit(n).cast("bigint"), draw)


def element(draw: Column, n: int, index: Column) -> Column:
    """Draw for element ``index`` of slot ``n``, for arrays of varying length."""
    return F.xxhash64(F.lit(n).cast("bigint"), draw, index.cast("bigint"))


def bits(draw: Column) -> Column:
    """The upper 52 bits as a non-negative integer; exact in a double."""
    return F.shiftrightunsigned(draw, 64 - DRAW_BITS)


def below(draw: Column, n: int | Column) -> Column:
    """Uniform integer in [0, n)."""
    bound = n if isinstance(n, Column) else F.lit(n).cast("bigint")
    return bits(draw) % bound


def unit(draw: Column) -> Column:
    """Uniform double in [0, 1)."""
    return bits(draw) / F.lit(float(DRAW_SPAN))


def int_div(left: Column, right: int) -> Column:
    return F.call_function("div", left, F.lit(right).cast("bigint"))


def digits(draw: Column, radices: list[int]) -> list[Column]:
    """Split one draw into several small uniform integers (mixed radix)."""
    out, used = [], 1
    for radix in radices:
        rest = bits(draw) if used == 1 else int_div(bits(draw), used)
        out.append(rest % F.lit(radix).cast("bigint"))
        used *= radix
        if used > DRAW_SPAN:
            raise ValueError("one draw holds 52 bits; use another slot")
    return out
