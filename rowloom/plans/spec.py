"""Table specs: what to generate for each column, editable as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

from rowloom.functions.scalar import count_of

IDENTITY_TYPES = ("sequence", "database_sequence", "ordered", "unordered", "uuid")
RANGE_TYPES = ("date", "time", "datetime")
ROW_COUNT = re.compile(r"^\+?[0-9_]+[kKmMgG]?$")
LONG_MAX = 2**63 - 1


@dataclass(frozen=True)
class Identity:
    """A key generator."""

    type: str
    start: int | None = None
    stop: int | None = None
    step: int | None = None
    sequence: str | None = None  # table whose highest key a database sequence continues
    batch_size: int | None = None

    def __post_init__(self):
        if self.type not in IDENTITY_TYPES:
            raise ValueError(f"unknown identity type {self.type}")


@dataclass(frozen=True)
class Range:
    """Dates, times or timestamps stepping with the row number."""

    type: str
    start: str | None = None
    stop: str | None = None
    step: int | None = None
    unit: str | None = None

    def __post_init__(self):
        if self.type not in RANGE_TYPES:
            raise ValueError(f"unknown range type {self.type}")


@dataclass(frozen=True)
class ValueSet:
    values: tuple = ()
    weights: tuple[float, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(self.values))
        object.__setattr__(self, "weights", tuple(self.weights))
        if not self.values:
            raise ValueError("a value set needs values")
        if self.weights and len(self.weights) != len(self.values):
            raise ValueError("values and weights differ in length")


@dataclass(frozen=True)
class Call:
    """A named random function with literal arguments."""

    name: str
    args: tuple = ()

    def __post_init__(self):
        object.__setattr__(self, "args", tuple(self.args))


@dataclass(frozen=True)
class ForeignKey:
    """The column takes keys of another table."""

    table: str
    column: str


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str = "string"
    constant: str | None = None
    expression: str | None = None
    call: Call | None = None
    range: Range | None = None
    identity: Identity | None = None
    value_set: ValueSet | None = None
    hidden: bool | None = None
    foreign_key: ForeignKey | None = None

    @property
    def visible(self) -> bool:
        return not self.hidden

    @property
    def kind(self) -> str:
        """Which generator wins when several are given."""
        if self.range is not None:
            return "range"
        if self.identity is not None:
            return "identity"
        if self.constant:
            return "constant"
        if self.expression:
            return "expression"
        if self.call is not None:
            return "call"
        if self.value_set is not None:
            return "value_set"
        if self.foreign_key is not None:
            return "foreign_key"
        raise ValueError(f"column {self.name} has no generator")


_PARTS = {"range": Range, "identity": Identity, "call": Call, "value_set": ValueSet, "foreign_key": ForeignKey}


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    rows: str | int = 0
    schema: str | None = None
    seed: int = field(default=42)

    def __post_init__(self):
        object.__setattr__(self, "columns", tuple(self.columns))
        if not self.columns:
            raise ValueError("a table needs columns")
        names = [c.name for c in self.columns]
        if len(set(names)) != len(names):
            raise ValueError(f"duplicate column in {self.name}")
        if not ROW_COUNT.match(str(self.rows)):
            raise ValueError(f"not a row count: {self.rows}")

    @property
    def qualified_name(self) -> str:
        return f"{self.schema}.{self.name}" if self.schema else self.name

    @property
    def row_count(self) -> int:
        return count_of(self.rows)

    def column(self, name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.name == name)

    def visible_columns(self) -> list[ColumnSpec]:
        return [c for c in self.columns if c.visible]

    def with_rows(self, rows: str | int) -> TableSpec:
        return replace(self, rows=rows)

    def with_column(self, column: ColumnSpec) -> TableSpec:
        """Replace the column of the same name."""
        return replace(self, columns=tuple(column if c.name == column.name else c for c in self.columns))

    def to_json(self) -> str:
        def trimmed(value: Any):
            if isinstance(value, dict):
                return {k: trimmed(v) for k, v in value.items() if v is not None and v != ()}
            return [trimmed(v) for v in value] if isinstance(value, (list, tuple)) else value

        return json.dumps(trimmed(asdict(self)), indent=2)

    @classmethod
    def from_json(cls, text: str, expect: str | None = None) -> TableSpec:
        """Read a spec back; ``expect`` is the qualified name it must carry."""
        data = json.loads(text)
        known = {f.name for f in fields(ColumnSpec)}
        columns = []
        for item in data.pop("columns", []):
            strange = set(item) - known
            if strange:
                raise ValueError(f"unknown column attributes {sorted(strange)}")
            columns.append(ColumnSpec(**{k: _PARTS[k](**v) if k in _PARTS else v for k, v in item.items()}))
        spec = cls(columns=tuple(columns), **data)
        if expect is not None and spec.qualified_name != expect:
            raise ValueError(f"spec is for {spec.qualified_name}, not {expect}")
        return spec
