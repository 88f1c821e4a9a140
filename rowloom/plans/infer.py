"""From a schema and its keys to a default table spec."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.plans.spec import Call, ColumnSpec, ForeignKey, Identity, TableSpec

MAX_TEXT = 512
KEY_BATCH = 512

# Column names with a generator of their own.
NAMED_TEXT = {
    "email": "randomEmail", "city": "randomCity", "name": "randomFullName", "country": "randomCountry",
    "phone": "randomPhoneNumber", "state": "randomState", "zip": "randomZipCode", "currency": "randomCurrency",
}
# Column defaults that name a key generator.
ROW_ID_DEFAULTS = ("unique_rowid()", "unordered_unique_rowid()")
UUID_DEFAULTS = ("gen_random_uuid()", "uuid_generate_v4()")

WHOLE_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
WHOLE_BOUNDS = {T.ByteType: 2**7, T.ShortType: 2**15}


@dataclass(frozen=True)
class ForeignKeySpec:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class KeySpec:
    """Keys and column defaults, which a Spark schema does not carry."""

    primary_key: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKeySpec, ...] = ()
    defaults: Mapping[str, str] = field(default_factory=dict)
    generated: frozenset[str] = frozenset()


def _sql_type(f: T.StructField) -> str:
    """Declared type of a column Spark keeps as text: ``uuid``, ``json`` or ``time``."""
    return str(f.metadata.get("sql_type", "")).lower()


def _is_other(f: T.StructField) -> bool:
    kinds = (T.StructType, T.VariantType, T.MapType, T.ArrayType)
    return isinstance(f.dataType, kinds) or _sql_type(f) in ("uuid", "json", "jsonb")


def _length(f: T.StructField, lengths: Mapping[str, int]) -> int:
    declared = getattr(f.dataType, "length", None) or f.metadata.get("length") or lengths.get(f.name)
    return max(1, min(MAX_TEXT, int(declared or MAX_TEXT)))


def default_call(f: T.StructField, lengths: Mapping[str, int] | None = None) -> Call:
    """Default generator by type, and by exact column name for text."""
    kind, lengths = f.dataType, lengths or {}
    if _is_other(f):
        return Call("randomJson", (1, 1))
    if isinstance(kind, T.BooleanType):
        return Call("randomBoolean")
    if isinstance(kind, T.LongType):
        return Call("randomLong")
    if isinstance(kind, WHOLE_TYPES):
        bound = WHOLE_BOUNDS.get(type(kind))
        return Call("randomInt", (0, bound) if bound else ())
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Call("randomDouble", (0.0, 3.4028234663852886e38) if isinstance(kind, T.FloatType) else ())
    if isinstance(kind, T.DecimalType):
        return Call("randomBigDecimal", (0, 10 ** (kind.precision - kind.scale), kind.scale))
    if isinstance(kind, T.DateType):
        return Call("randomDate")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Call("randomDateTime")
    if _sql_type(f) == "time" or kind.typeName().startswith("time("):
        return Call("randomTime")
    if isinstance(kind, T.BinaryType):
        return Call("randomBytesBase64", (_length(f, lengths),))
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        named = NAMED_TEXT.get(f.name)
        return Call(named) if named else Call("randomString", (_length(f, lengths),))
    raise ValueError(f"no default generator for {f.name} {kind.simpleString()}")


def key_identity(f: T.StructField, keys: KeySpec) -> Identity | None:
    """Identity of a primary-key column; None keeps its default generator."""
    if _is_other(f):
        return Identity("uuid")
    if not isinstance(f.dataType, WHOLE_TYPES):
        return None
    default = keys.defaults.get(f.name, "").lower()
    if default in ROW_ID_DEFAULTS:
        return Identity("unordered", batch_size=KEY_BATCH)
    if default in UUID_DEFAULTS:
        return Identity("uuid")
    if f.name in keys.generated:
        return Identity("unordered", batch_size=KEY_BATCH)
    return Identity("sequence", start=1, step=1)


def infer_spec(
    name: str,
    source: DataFrame | T.StructType,
    keys: KeySpec | None = None,
    enums: Mapping[str, Sequence[str]] | None = None,
    lengths: Mapping[str, int] | None = None,
    rows: str | int = 0,
    schema: str | None = None,
) -> TableSpec:
    """Columns get default generators; foreign keys then lose theirs, primary keys get an identity."""
    keys, enums = keys or KeySpec(), enums or {}
    struct = source.schema if isinstance(source, DataFrame) else source
    parents = {c: ForeignKey(k.parent, p) for k in keys.foreign_keys for c, p in zip(k.columns, k.parent_columns)}
    columns = []
    for f in struct.fields:
        spec = ColumnSpec(f.name, f.dataType.simpleString())
        if f.name in parents:
            columns.append(replace(spec, foreign_key=parents[f.name]))
            continue
        call = Call("selectRandom", tuple(enums[f.name])) if enums.get(f.name) else default_call(f, lengths)
        spec = replace(spec, call=call)
        if f.name in keys.primary_key:
            identity = key_identity(f, keys)
            if identity is not None:
                spec = replace(spec, call=None, identity=identity)
        columns.append(spec)
    return TableSpec(name, tuple(columns), rows, schema)


def text_lengths(df: DataFrame) -> dict[str, int]:
    """Longest value of each text column, in one pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return {}
    row = df.agg(*[F.max(F.length(n)).alias(str(i)) for i, n in enumerate(names)]).first()
    return {n: row[str(i)] or 0 for i, n in enumerate(names)}


def enum_values(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, list[str]]:
    """Values of the columns that have at most ``limit`` of them, and at least one.

    Distinct values of all columns are counted exactly in one pass. Only the values of the
    columns within the limit come to the driver, so a column of many values beside them
    neither fills it nor pushes others out.
    """
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]))
    distinct = df.select(named.alias("pair")).select("pair.name", "pair.value").dropna().distinct()
    few = [r["name"] for r in distinct.groupBy("name").count().filter(F.col("count") <= limit).collect()]
    if not few:
        return {}
    found: dict[str, list[str]] = {}
    for row in distinct.filter(F.col("name").isin(few)).orderBy("name", "value").collect():
        found.setdefault(row["name"], []).append(row["value"])
    return found


def infer_from_data(name: str, df: DataFrame, limit: int, keys: KeySpec | None = None, rows: str | int = 0) -> TableSpec:
    """Inference that also looks at the rows: text lengths, and value sets of at most ``limit`` values."""
    lengths = text_lengths(df)
    enums = enum_values(df, list(lengths), limit) if lengths else {}
    return infer_spec(name, df, keys, enums, lengths, rows)


COLUMN_SCHEMA = (
    "table_name string, column_name string, position int, data_type string, nullable boolean, length int, "
    "precision int, scale int, column_default string, comment string"
)


def list_columns(spark: SparkSession, name: str, source: DataFrame | T.StructType, keys: KeySpec | None = None) -> DataFrame:
    """One row of ten attributes per column."""
    struct, keys = source.schema if isinstance(source, DataFrame) else source, keys or KeySpec()
    found = []
    for i, f in enumerate(struct.fields, 1):
        length = getattr(f.dataType, "length", None) or f.metadata.get("length")
        found.append((
            name, f.name, i, f.dataType.simpleString(), f.nullable, length, getattr(f.dataType, "precision", None),
            getattr(f.dataType, "scale", None), keys.defaults.get(f.name), f.metadata.get("comment"),
        ))
    return spark.createDataFrame(found, COLUMN_SCHEMA)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of the session catalogue."""
    listed = [(t.namespace[0] if t.namespace else None, t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(listed, "schema string, name string, type string, temporary boolean")


def list_keys(spark: SparkSession, keys: Mapping[str, KeySpec]) -> DataFrame:
    """Primary and foreign keys of several tables, one row per key column."""
    found = []
    for table, k in keys.items():
        found += [(table, "primary", i, c, None, None) for i, c in enumerate(k.primary_key, 1)]
        for fk in k.foreign_keys:
            found += [(table, "foreign", i, c, fk.parent, p) for i, (c, p) in enumerate(zip(fk.columns, fk.parent_columns), 1)]
    return spark.createDataFrame(
        found, "table_name string, kind string, position int, column_name string, parent string, parent_column string"
    )
