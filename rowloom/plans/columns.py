"""One Column per column spec: a closed form over the row number."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.draws import cell_draw
from rowloom.functions import random_values as rv
from rowloom.functions import temporal
from rowloom.functions.registry import build_call
from rowloom.plans.spec import LONG_MAX, ColumnSpec, Identity, Range

ROW = "row_number"
DRAW = "draw"


def uuid_key(row: Column, label: str, seed: int) -> Column:
    return rv.uuid4(cell_draw(row, label, seed))


def sequence(row: Column, start: int | None = None, stop: int | None = None, step: int | None = None) -> Column:
    """start, start + step, ... starting over when the next value would pass ``stop``."""
    start = 1 if start is None else start
    step = max(1, step or 1)
    if stop is None or stop >= LONG_MAX:
        return F.lit(start).cast("bigint") + row * F.lit(step).cast("bigint")
    cycle = max(1, (stop - start) // step + 1)
    return F.lit(start).cast("bigint") + (row % F.lit(cycle).cast("bigint")) * F.lit(step).cast("bigint")


def identity_column(row: Column, identity: Identity, label: str, seed: int, high_water: Column | None = None) -> Column:
    if identity.type == "uuid":
        return uuid_key(row, label, seed)
    if identity.type == "unordered":
        return rv.row_id_unordered(row)
    if identity.type == "ordered":
        return rv.row_id_ordered(row)
    if identity.type == "database_sequence":
        if high_water is None:
            raise ValueError(f"{label}: a database sequence needs the table it continues")
        return high_water + row * F.lit(max(1, identity.step or 1)).cast("bigint") + 1
    return sequence(row, identity.start, identity.stop, identity.step)


def range_column(row: Column, spec: Range) -> Column:
    if spec.type == "date":
        start = dt.date.fromisoformat(spec.start) if spec.start else dt.date.today()
        stop = dt.date.fromisoformat(spec.stop) if spec.stop else None
        return temporal.date_range(row, start, stop, spec.step, spec.unit or "DAYS")
    if spec.type == "time":
        now = dt.datetime.now().time().replace(microsecond=0).isoformat()
        start = temporal.parse_time(spec.start or now)
        stop = temporal.parse_time(spec.stop) if spec.stop else None
        return temporal.time_text(temporal.time_range(row, start, stop, spec.step, spec.unit or "SECONDS"))
    start = dt.datetime.fromisoformat(spec.start) if spec.start else dt.datetime.now()
    stop = dt.datetime.fromisoformat(spec.stop) if spec.stop else None
    return temporal.datetime_range(row, start, stop, spec.step, spec.unit or "DAYS")


def column_for(spec: ColumnSpec, row: Column, label: str, seed: int, high_water: Column | None = None) -> Column:
    """The generator of one column, apart from foreign keys, which need their parent.

    An expression sees the row number as ``row_number`` and its own cell draw
    as ``draw``; both must be in scope where the Column is used.
    """
    draw = cell_draw(row, label, seed)
    kind = spec.kind
    if kind == "range":
        return range_column(row, spec.range)
    if kind == "identity":
        return identity_column(row, spec.identity, label, seed, high_water)
    if kind == "constant":
        return F.lit(spec.constant)
    if kind == "expression":
        return F.expr(spec.expression)
    if kind == "call":
        return build_call(draw, spec.call.name, *spec.call.args)
    if kind == "value_set":
        values = list(spec.value_set.values)
        return rv.weighted_pick(draw, values, spec.value_set.weights) if spec.value_set.weights else rv.pick(draw, values)
    raise ValueError(f"{label}: a foreign key is filled from its parent table")
