"""Table generation: a distributed row index and one projection over it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.draws import below, cell_draw
from rowloom.operators.lookup import lookup_by_position
from rowloom.operators.row_index import index_size
from rowloom.plans.columns import DRAW, ROW, column_for
from rowloom.plans.spec import ColumnSpec, TableSpec

ROWS_PER_TASK = 2_000_000


def row_index(spark: SparkSession, rows: int, partitions: int | None = None, start: int = 0) -> DataFrame:
    """Row numbers start .. start + rows - 1, split evenly over tasks."""
    if partitions is None:
        partitions = max(1, min(rows, max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))))
    return spark.range(start, start + rows, 1, partitions).withColumnRenamed("id", ROW)


def high_water_mark(target: DataFrame, key: str) -> Column:
    """Highest key in use, as an uncorrelated scalar subquery; 0 for an empty table."""
    return target.agg(F.coalesce(F.max(key), F.lit(0)).cast("bigint")).scalar()


def project(
    spec: TableSpec,
    index: DataFrame,
    targets: Mapping[str, DataFrame] | None = None,
    parents: Mapping[str, TableSpec] | None = None,
    parent_tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """The spec's columns over any frame that carries ``row_number``.

    A foreign key to a spec in ``parents`` is computed from the parent's own
    key formula at a random parent row, without a join. A foreign key to an
    existing table in ``parent_tables`` is a positional lookup.
    """
    row, out = F.col(ROW), index.select(ROW)
    ready: dict[str, Column] = {}
    for column in spec.columns:
        label = f"{spec.qualified_name}.{column.name}"
        if column.kind in ("foreign_key", "expression"):
            # These may look at the columns before them, so those come first.
            out, ready = out.withColumns(ready) if ready else out, {}
        if column.kind == "foreign_key":
            out = _with_foreign_key(out, column, label, spec.seed, parents or {}, parent_tables or {})
        elif column.kind == "expression":
            drawn = out.withColumn(DRAW, cell_draw(row, label, spec.seed))
            out = drawn.withColumn(column.name, column_for(column, row, label, spec.seed)).drop(DRAW)
        else:
            ready[column.name] = column_for(column, row, label, spec.seed, _high_water(spec, column, targets or {}))
    return out.withColumns(ready) if ready else out


def _high_water(spec: TableSpec, column: ColumnSpec, targets: Mapping[str, DataFrame]) -> Column | None:
    if column.kind != "identity" or column.identity.type != "database_sequence":
        return None
    target = targets.get(column.identity.sequence or spec.name)
    return high_water_mark(target, column.name) if target is not None else None


def _with_foreign_key(
    out: DataFrame, column: ColumnSpec, label: str, seed: int, parents: Mapping[str, TableSpec],
    parent_tables: Mapping[str, DataFrame],
) -> DataFrame:
    ref, draw = column.foreign_key, cell_draw(F.col(ROW), label, seed)
    if ref.table in parents:
        return out.withColumn(column.name, formula_key(parents[ref.table], ref.column, draw, parents))
    if ref.table not in parent_tables:
        raise ValueError(f"{label}: no parent table {ref.table}")
    parent = parent_tables[ref.table].select(F.col(ref.column).alias(column.name))
    size = index_size(parent)
    if size == 0:
        raise ValueError(f"{label}: parent table {ref.table} is empty")
    return lookup_by_position(out, below(draw, size), parent, [column.name])


def formula_key(parent: TableSpec, key: str, draw: Column, parents: Mapping[str, TableSpec]) -> Column:
    """The parent's key at a random parent row, from the parent's closed form."""
    column = parent.column(key)
    position = below(draw, parent.row_count)
    label = f"{parent.qualified_name}.{key}"
    if column.kind == "foreign_key":
        up = column.foreign_key
        return formula_key(parents[up.table], up.column, cell_draw(position, label, parent.seed), parents)
    if column.kind == "expression" or (column.kind == "identity" and column.identity.type == "database_sequence"):
        raise ValueError(f"{label}: not a closed form, pass the parent as a table")
    return column_for(column, position, label, parent.seed)


def visible(spec: TableSpec, df: DataFrame) -> DataFrame:
    return df.select(*[c.name for c in spec.visible_columns()])


def generate(
    spark: SparkSession,
    spec: TableSpec,
    rows: int | None = None,
    partitions: int | None = None,
    targets: Mapping[str, DataFrame] | None = None,
    parents: Mapping[str, TableSpec] | None = None,
    parent_tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Rows of a table spec; visible columns only."""
    index = row_index(spark, spec.row_count if rows is None else rows, partitions)
    return visible(spec, project(spec, index, targets, parents, parent_tables))


def parallel_load(spark: SparkSession, spec: TableSpec, streams: int, **options) -> DataFrame:
    """``streams`` times the spec's rows, one task per stream; row numbers run on across streams."""
    return generate(spark, spec, rows=spec.row_count * streams, partitions=streams, **options)


def preview(df: DataFrame, rows: int = 100, transpose: bool = False) -> DataFrame:
    """The first rows; transposed to (record, key, value) with all values as text."""
    head = df.limit(rows)
    if not transpose:
        return head
    # The limit leaves at most ``rows`` rows, so numbering them in one task is bounded.
    numbered = head.select(F.monotonically_increasing_id().alias("record"), *[F.col(c).cast("string") for c in head.columns])
    return numbered.unpivot(["record"], list(head.columns), "key", "value")
