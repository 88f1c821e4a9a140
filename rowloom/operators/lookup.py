"""Lookups of other tables' rows, as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.draws import below, cell_draw, int_div
from rowloom.functions.random_values import pick
from rowloom.operators.row_index import index_size, with_row_index, with_running_total
from rowloom.operators.sizes import is_small
from rowloom.operators.skew import join_unique

POSITION = "_position"
MAX_LITERALS = 1_000


def lookup_one(df: DataFrame, ref: DataFrame, on: Sequence[str], value: str, strict: bool = True) -> DataFrame:
    """Add ``value`` of the one reference row matching ``on``; strict raises unless there is exactly one."""
    unique = ref.groupBy(*on).agg(F.count(F.lit(1)).alias("_matches"), F.min(value).alias(value))
    # The raw table bounds the grouped one, and its check stops early.
    joined = join_unique(df, unique, on, "left", small=is_small(ref))
    matches = F.coalesce(F.col("_matches"), F.lit(0))
    if strict:
        refused = F.raise_error(F.concat(F.lit(f"lookup of {value} found "), matches.cast("string"), F.lit(" rows")))
        checked = F.when(matches == 1, F.col(value)).otherwise(refused.cast(unique.schema[value].dataType))
    else:
        checked = F.when(matches == 1, F.col(value))
    return joined.withColumn(value, checked).drop("_matches")


def lookup_scalar(one_row: DataFrame) -> Column:
    """A one-row, one-column frame as a value usable in any expression."""
    return one_row.scalar()


def lookup_by_position(df: DataFrame, position: Column, ref: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Add the columns of the ``position``-th reference row in the given order."""
    small = is_small(ref)
    indexed = with_row_index(ref, order_by, POSITION, small)
    return join_unique(df.withColumn(POSITION, position.cast("bigint")), indexed, [POSITION], "left", small).drop(POSITION)


def fk_sample(df: DataFrame, row: Column, parent: DataFrame, key: Sequence[str], label: str, seed: int = 42) -> DataFrame:
    """Add a uniformly drawn key of ``parent`` to each row; every key exists by construction."""
    keys = parent.select(*key)
    return lookup_by_position(df, below(cell_draw(row, label, seed), index_size(keys)), keys, list(key))


def semi_lookup(df: DataFrame, ref: DataFrame, on: Sequence[str], present: bool = True) -> DataFrame:
    """Rows whose key is in the reference table, or is not."""
    return join_unique(df, ref.select(*on).distinct(), on, "left_semi" if present else "left_anti")


def dictionary_pick(df: DataFrame, draw: Column, words: DataFrame, value: str, order_by: Sequence[str], name: str) -> DataFrame:
    """Add a uniformly drawn entry of a word table; repeated words count as often as they occur.

    Up to MAX_LITERALS entries become a literal array; longer tables are joined by position.
    """
    order = [f"_order_{i}" for i in range(len(order_by))]
    listed = words.select(F.col(value).alias(name), *[F.col(c).alias(o) for c, o in zip(order_by, order)])
    if is_small(listed, MAX_LITERALS):
        entries = [r[0] for r in listed.orderBy(*order).select(name).take(MAX_LITERALS)]
        return df.withColumn(name, pick(draw, entries).cast(listed.schema[name].dataType))
    return lookup_by_position(df, below(draw, index_size(listed)), listed, order).drop(*order)


def weighted_choice(
    df: DataFrame, draw: Column, items: DataFrame, value: str, weight: str, order_by: Sequence[str], name: str
) -> DataFrame:
    """Add a drawn item of a table with whole-number weights, which must be unique by ``order_by``.

    The draw picks one unit of the total weight; the item owning that unit is found by an
    equality join on a coarse bucket of the running total, then a range condition inside it.
    Items of weight zero are never drawn; null and negative weights raise, as does a total of zero.
    """
    order = [f"_order_{i}" for i in range(len(order_by))]
    listed = items.select(
        F.col(value).alias(name), _checked_weight(F.col(weight)).alias("_weight"),
        *[F.col(c).alias(o) for c, o in zip(order_by, order)],
    )
    if is_small(listed, MAX_LITERALS):
        rows = listed.orderBy(*order).select(name, "_weight").take(MAX_LITERALS)
        if not any(w for _, w in rows):
            raise ValueError("the weights add up to nothing")
        chosen = _unit_choice(draw, [r[0] for r in rows], [r[1] for r in rows])
        return df.withColumn(name, chosen.cast(listed.schema[name].dataType))
    small = is_small(listed)
    total = listed.agg(F.sum("_weight")).first()[0]
    if not total:
        raise ValueError("the weights add up to nothing")
    runs = with_running_total(listed.filter("_weight > 0"), order, "_weight", "_end", small)
    width = max(1, total // max(1, index_size(listed)))
    start = F.col("_end") - F.col("_weight")
    spans = runs.select(
        name, start.alias("_start"), F.col("_end"),
        F.explode(F.sequence(int_div(start, width), int_div(F.col("_end") - 1, width))).alias("_bucket"),
    )
    drawn = df.withColumn("_unit", below(draw, total)).withColumn("_bucket", int_div(F.col("_unit"), width))
    right = F.broadcast(spans) if is_small(spans) else spans
    inside = (F.col("_unit") >= F.col("_start")) & (F.col("_unit") < F.col("_end"))
    return (
        drawn.alias("l").join(right.alias("r"), (F.col("l._bucket") == F.col("r._bucket")) & inside)
        .select(*[F.col(f"l.{c}") for c in df.columns], F.col(f"r.{name}"))
    )


def _checked_weight(weight: Column) -> Column:
    whole = weight.cast("bigint")
    bad = F.raise_error(F.concat(F.lit("not a weight: "), F.coalesce(weight.cast("string"), F.lit("null")))).cast("bigint")
    return F.when(whole >= 0, whole).otherwise(bad)


def _unit_choice(draw: Column, values: list, weights: list[int]) -> Column:
    """The item owning unit number ``draw mod total``."""
    total, ends, running = sum(weights), [], 0
    for w in weights:
        running += w
        ends.append(running)
    unit = below(draw, total)
    at = F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e <= unit)) + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), at)


def cross_product(spark: SparkSession, *lists: tuple[DataFrame, str]) -> DataFrame:
    """All combinations of the columns' values, the first list outermost.

    Combinations are numbered and each number is split into one position per
    list, so the product is a set of lookups over an evenly split range.
    """
    from rowloom.plans.generate import row_index

    sizes = [index_size(frame) for frame, _ in lists]
    total = 1
    for size in sizes:
        total *= size
    out, stride = row_index(spark, total), total
    for (frame, column), size in zip(lists, sizes):
        stride //= max(1, size)
        position = int_div(F.col("row_number"), stride) % size
        out = lookup_by_position(out, position, frame.select(column), [column])
    return out.drop("row_number")

