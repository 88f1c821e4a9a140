"""DuckDB spellings of the draw contract, for the oracle queries only.

The hash is the published 64-bit xxHash of one long; DuckDB has no such
function, so it is written out in 128-bit arithmetic.
"""

from __future__ import annotations

from rowloom.draws import DEFAULT_SEED, draw_key

# The five primes of the 64-bit xxHash.
P1 = 11400714785074694791
P2 = 14029467366897019727
P3 = 1609587929392839161
P4 = 9650029242287828579
P5 = 2870177450012600261
MOD = 1 << 64
SPARK_SEED = 42


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _hash_int(x: int, seed: int) -> int:
    rot = lambda v, k: ((v << k) | (v >> (64 - k))) % MOD
    z = ((seed + P5 + 8) % MOD) ^ (rot(x * P2 % MOD, 31) * P1 % MOD)
    z = (rot(z, 27) * P1 + P4) % MOD
    z = (z ^ (z >> 33)) * P2 % MOD
    z = (z ^ (z >> 29)) * P3 % MOD
    return z ^ (z >> 32)


def _hash(x: str, start: str) -> str:
    """xxHash64 of the UHUGEINT expression ``x``; ``start`` is seed + P5 + 8 mod 2^64."""
    mixed = f"(({x})*{_u(P2)}%{_u(MOD)}*{_u(1 << 31)}%{_u(MOD - 1)}*{_u(P1)}%{_u(MOD)})"
    z = f"(xor({start},{mixed})*{_u(1 << 27)}%{_u(MOD - 1)}*{_u(P1)}+{_u(P4)})%{_u(MOD)}"
    z = f"list_transform([{z}],lambda z1: xor(z1,z1>>33)*{_u(P2)}%{_u(MOD)})[1]"
    z = f"list_transform([{z}],lambda z2: xor(z2,z2>>29)*{_u(P3)}%{_u(MOD)})[1]"
    return f"list_transform([{z}],lambda z3: xor(z3,z3>>32))[1]"


def _keyed(key: int, x: str) -> str:
    return _hash(x, _u((_hash_int(key, SPARK_SEED) + P5 + 8) % MOD))


def cell(label: str, row: str, seed: int = DEFAULT_SEED) -> str:
    """Draw of a cell, from a non-negative row id."""
    return _keyed(draw_key(label, seed), f"({row})::UHUGEINT")


def slot(draw: str, n: int) -> str:
    return _keyed(n, draw)


def element(draw: str, n: int, index: str) -> str:
    return _hash(f"({index})::UHUGEINT", f"(({_keyed(n, draw)})+{_u((P5 + 8) % MOD)})%{_u(MOD)}")


def bits(draw: str) -> str:
    return f"(({draw})>>12)::BIGINT"


def unit(draw: str) -> str:
    return f"({bits(draw)}::DOUBLE/4503599627370496.0)"


def hex64(draw: str) -> str:
    return f"lpad(lower(to_hex(({draw})::UBIGINT)),16,'0')"


def words(values: list[str]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(draw: str, values: list[str]) -> str:
    return f"{words(values)}[1+{bits(draw)}%{len(values)}]"


def rows(table: str, key: str, label: str, extra: str = "") -> str:
    """A derived table (id, d, extra...) of row ids and cell draws."""
    return f"(SELECT {key} AS id, {cell(label, key)} AS d{', ' + extra if extra else ''} FROM {table}) src"
