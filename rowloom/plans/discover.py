"""Keys and references read from the data, where no catalogue names them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.session import freed_shuffles

SKETCH_LOG = 12  # sketches of 4096 registers
SKETCH_ERROR = 0.017  # their relative standard deviation
MARGIN = 1 + 10 * SKETCH_ERROR  # a sketch further off than this is not expected
AT_ONCE = 8  # column combinations looked at in one pass; with more, Spark no longer compiles the pass as one
SAMPLE_PARTS = 64
PASS_ROWS = 1 << 25  # digests shuffled in one pass, if one combination does not have more alone


def _digest(columns: Sequence[str]) -> list[Column]:
    """128 bits of a combination of values."""
    named = [F.col(f"`{c}`") for c in columns]
    return [F.xxhash64(F.lit(salt), *named) for salt in ("low", "high")]


def _passes(candidates: Sequence[tuple[str, ...]], rows: int) -> list[Sequence[tuple[str, ...]]]:
    """The candidates dealt to passes that shuffle about ``rows`` digests for each of them."""
    n = max(1, min(AT_ONCE, PASS_ROWS // max(1, rows)))
    return [candidates[at:at + n] for at in range(0, len(candidates), n)]


def _fewer_digests(df: DataFrame, candidates: Sequence[tuple[str, ...]], rows: int) -> list[tuple[str, ...]]:
    """Candidates with fewer 64-bit digests than there are rows: all with two rows of the same values, and one in which digests meet by chance."""
    found = []
    for some in _passes(candidates, rows):
        digests = F.array(*[F.struct(F.lit(n).alias("n"), _digest(c)[0].alias("low")) for n, c in enumerate(some)])
        counts = {r["n"]: r["count"] for r in df.select(F.inline(digests)).distinct().groupBy("n").count().collect()}
        found += [c for n, c in enumerate(some) if counts.get(n, 0) < rows]
    return found


def _repeated(df: DataFrame, candidates: Sequence[tuple[str, ...]], parts: int, rows: int) -> set[tuple[str, ...]]:
    """Candidates with two rows of the same values, among one in ``parts`` of the values of the ``rows`` rows.

    Rows are taken by a hash of the candidate's own values, so two equal rows are taken both or
    neither. The candidates of a pass share one shuffle of digests.
    """
    found = set()
    for some in _passes(candidates, rows // parts):
        # what is not taken is left before the second half of its digest is made
        digests = [F.when(F.pmod(low, F.lit(parts)) == 0, F.struct(F.lit(n).alias("n"), low.alias("low"), high.alias("high"))) for n, (low, high) in enumerate(map(_digest, some))]
        taken = df.select(F.inline(F.array(*digests))).where("n is not null")
        twice = taken.groupBy("n", "low", "high").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("n").distinct()
        found |= {some[r["n"]] for r in twice.collect()}
    return found


def discover_unique_keys(df: DataFrame, most: int = 3, columns: Sequence[str] | None = None) -> list[tuple[str, ...]]:
    """The minimal combinations of at most ``most`` columns without nulls that no two rows share, in column order.

    The lattice is searched level by level. No superset of a key is looked at; a combination
    whose columns have too few values together, by sketches, is left out before it is counted
    at all. What is left is first held against a part of the values, then against all rows: by
    digests of 64 bits, and of 128 where these are fewer than the rows. A pass shuffles PASS_ROWS
    digests or those of one combination, and its shuffle files go when it ends. A table without
    rows has every column without nulls as a key. Complex columns take no part.
    """
    with freed_shuffles(df.sparkSession):
        return _unique_keys(df, most, columns)


def _unique_keys(df: DataFrame, most: int, columns: Sequence[str] | None) -> list[tuple[str, ...]]:
    simple = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType))]
    columns = [c for c in (columns or simple) if c in simple]
    if not columns:
        return []
    sketch = lambda *cs: F.hll_sketch_estimate(F.hll_sketch_agg(_digest(cs)[0], F.lit(SKETCH_LOG)))
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(columns)], *[sketch(c).alias(f"d{k}") for k, c in enumerate(columns)],
    ).first()
    rows = facts["rows"]
    whole = [k for k in range(len(columns)) if facts[f"n{k}"] == rows]
    distinct = {k: facts[f"d{k}"] for k in whole}
    keys: list[tuple[int, ...]] = []
    for size in range(1, most + 1):
        level = [c for c in combinations(whole, size) if not any(set(k) <= set(c) for k in keys)]
        level = [c for c in level if reduce(lambda n, k: n * max(1, distinct[k]) * MARGIN, c, 1.0) >= rows]
        named = {tuple(columns[k] for k in c): c for c in level}
        for refuted in _repeated(df, list(named), SAMPLE_PARTS, rows):
            del named[refuted]
        for refuted in _repeated(df, _fewer_digests(df, list(named), rows), 1, rows):
            del named[refuted]
        keys += named.values()
    return [tuple(columns[k] for k in key) for key in keys]


# -- references ------------------------------------------------------------------------------


def _family(kind: T.DataType) -> str | None:
    """Values of one family can be equal to each other."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(kind, T.DateType):
        return "date"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "moment"
    return None


def _values(name: str, df: DataFrame) -> DataFrame | None:
    """(column, low, high): digests of the distinct values of every comparable column."""
    cells = []
    for field in df.schema.fields:
        family = _family(field.dataType)
        if family:
            value = F.col(f"`{field.name}`").cast("string")
            cells.append(F.when(value.isNotNull(), F.struct(F.lit(f"{name}.{field.name}").alias("column"), *[
                F.xxhash64(F.lit(salt), F.lit(family), value).alias(salt) for salt in ("low", "high")
            ])))
    if not cells:
        return None
    return df.select(F.inline(F.array_compact(F.array(*cells)))).distinct()


def discover_references(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(child, parent, n_values): every ``table.column`` whose values all stand in another column.

    One shuffle brings the columns of each value together, distinct before it is sent; the sets of
    columns that occur are counted, and a column is contained in another if as many of its
    values lie in sets with the other as it has at all. Nulls do not count; a column without values
    is no child. Only whole numbers, texts, dates and timestamps are compared, each among themselves.
    """
    parts = [v for v in (_values(name, df) for name, df in tables.items()) if v is not None]
    if not parts:
        raise ValueError("no table has a comparable column")
    where = reduce(DataFrame.unionAll, parts).groupBy("low", "high").agg(F.sort_array(F.collect_set("column")).alias("columns"))
    sets = where.groupBy("columns").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select(F.explode("columns").alias("child"), "columns", "n").select("child", F.explode("columns").alias("parent"), "n")
    shared = pairs.groupBy("child", "parent").agg(F.sum("n").alias("n_values"))
    own = shared.where("child = parent").select("child", F.col("n_values").alias("n_own"))
    contained = shared.where("child <> parent").join(own, "child").where("n_values = n_own")
    return contained.select("child", "parent", "n_values")
