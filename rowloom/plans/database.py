"""Several related tables, parents before children."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession

from rowloom.plans.generate import generate
from rowloom.plans.spec import TableSpec


def spec_edges(specs: Sequence[TableSpec]) -> list[tuple[str, str]]:
    """Child -> parent pairs named by the specs' foreign keys."""
    return sorted({(s.name, c.foreign_key.table) for s in specs for c in s.columns if c.kind == "foreign_key"})


def spec_order(specs: Sequence[TableSpec]) -> list[str]:
    """Loading order of specs; cycles and self references raise."""
    graph: dict[str, set[str]] = {s.name: set() for s in specs}
    for child, parent in spec_edges(specs):
        if child == parent:
            raise ValueError(f"self reference: {child}")
        if parent in graph:
            graph[child].add(parent)
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as error:
        raise ValueError(f"cycle: {' -> '.join(error.args[1])}") from error


def _closed_form(spec: TableSpec, key: str, specs: Mapping[str, TableSpec]) -> bool:
    column = spec.column(key)
    if column.kind == "foreign_key":
        up = column.foreign_key
        return up.table in specs and _closed_form(specs[up.table], up.column, specs)
    return column.kind != "expression" and not (column.kind == "identity" and column.identity.type == "database_sequence")


def generate_database(
    spark: SparkSession,
    specs: Sequence[TableSpec],
    existing: Mapping[str, DataFrame] | None = None,
    targets: Mapping[str, DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """All tables of the specs, in loading order.

    A key with a closed form is drawn by formula, so children need no join
    with their parents; other keys, and keys of ``existing`` tables, are looked
    up by position.
    """
    by_name, made = {s.name: s for s in specs}, {}
    for name in spec_order(specs):
        spec, formulas, tables = by_name[name], {}, dict(existing or {})
        for column in spec.columns:
            if column.kind == "foreign_key" and column.foreign_key.table in by_name:
                ref = column.foreign_key
                if _closed_form(by_name[ref.table], ref.column, by_name):
                    formulas.update({n: s for n, s in by_name.items() if n not in tables})
                else:
                    tables[ref.table] = made[ref.table]
        formulas = {n: s for n, s in formulas.items() if n not in tables}
        made[name] = generate(spark, spec, targets=targets, parents=formulas, parent_tables=tables)
    return made
