"""Delimited text in and out, and the load options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rowloom.operators.skew import join_unique

# Load options with a reader option of their own.
READER_OPTIONS = {
    "delimiter": "sep", "fields_terminated_by": "sep", "fields_enclosed_by": "quote", "fields_escaped_by": "escape",
    "rows_terminated_by": "lineSep", "records_terminated_by": "lineSep", "comment": "comment", "nullif": "nullValue",
}
OTHER_OPTIONS = (
    "schema", "schema_uri", "skip", "row_limit", "decompress", "strict_validation", "allow_quoted_null",
    "data_as_json_records", "data_as_binary_records",
)


def csv_line(columns: Sequence[str], delimiter: str = ",", quote: str = "") -> Column:
    """A row as raw text: quote + value + quote, nothing escaped, nulls spelled out."""
    parts = [F.concat(F.lit(quote), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(quote)) for c in columns]
    return F.concat_ws(delimiter, *parts)


def write_csv(
    df: DataFrame, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, gzip: bool = False,
    raw: bool = False, as_strings: bool = False, mode: str = "errorifexists",
) -> None:
    """CSV files, one per task. ``raw`` writes lines without any escaping."""
    if as_strings:
        df = df.select(*[F.col(c).cast("string") for c in df.columns])
    options = {"header": str(header).lower(), "compression": "gzip" if gzip else "none"}
    if raw:
        line = csv_line(df.columns, delimiter, "" if quote == '"' else quote).alias(delimiter.join(df.columns))
        df.select(line).write.mode(mode).options(**options, sep="\x01", quote="", escapeQuotes="false", emptyValue="").csv(path)
        return
    df.write.mode(mode).options(**options, sep=delimiter, quote=quote, escape=quote, nullValue="null").csv(path)


def read_csv_rows(
    spark: SparkSession, path: str | Sequence[str], schema: StructType, delimiter: str = ",", **options
) -> DataFrame:
    """Rows of one or more CSV files with a header, fields trimmed, columns checked against the header."""
    reader = spark.read.schema(schema).options(
        header="true", sep=delimiter, escape='"', ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true",
        enforceSchema="false", **options,
    )
    return reader.csv([path] if isinstance(path, str) else list(path))


def check_width(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Refuse a frame whose columns do not match the table's in number and name."""
    if len(df.columns) != len(columns):
        raise ValueError(f"{len(df.columns)} columns in the stream, {len(columns)} in the table")
    strange = [c for c, want in zip(df.columns, columns) if c.lower() != want.lower()]
    if strange:
        raise ValueError(f"columns not in the table: {strange}")
    return df


def header_columns(spark: SparkSession, path: str, delimiter: str = ",") -> list[str]:
    """Column names in the first line of a file."""
    return spark.read.options(header="true", sep=delimiter).csv(path).columns


def load(spark: SparkSession, path: str | Sequence[str], options: Mapping[str, str], schema: StructType | None = None) -> DataFrame:
    """Read files by load options.

    ``skip`` drops that many lines at the head of every file. Files are
    decompressed by extension. Binary records need the avro module.
    """
    options = {k.lower(): v for k, v in options.items()}
    unknown = [k for k in options if k not in READER_OPTIONS and k not in OTHER_OPTIONS]
    if unknown:
        raise ValueError(f"unknown load options {unknown}")
    paths = [path] if isinstance(path, str) else list(path)
    schema = schema or (StructType.fromDDL(options["schema"]) if "schema" in options else None)
    if schema is None and "schema_uri" in options:
        schema = StructType.fromDDL(" ".join(r[0] for r in spark.read.text(options["schema_uri"]).collect()))
    if schema is None:
        raise ValueError("a schema is needed")
    mode = "FAILFAST" if _on(options.get("strict_validation")) else "PERMISSIVE"
    if _on(options.get("data_as_binary_records")):
        df = spark.read.format("avro").load(paths)
    elif _on(options.get("data_as_json_records")):
        df = spark.read.schema(schema).option("mode", mode).json(paths)
    else:
        reader = {READER_OPTIONS[k]: v for k, v in options.items() if k in READER_OPTIONS}
        skip = int(options.get("skip", 0))
        df = _read_delimited(spark, paths, schema, {**reader, "mode": mode}, skip)
    if _on(options.get("allow_quoted_null")) and "nullif" in options:
        token = options["nullif"]
        text = [f.name for f in schema.fields if isinstance(f.dataType, StringType)]
        df = df.select(*[F.nullif(F.trim(c), F.lit(token)).alias(c) if c in text else F.col(c) for c in df.columns])
    return df.limit(int(options["row_limit"])) if "row_limit" in options else df


def _on(value) -> bool:
    return value is not None and str(value).lower() not in ("false", "0", "no")


def _read_delimited(spark: SparkSession, paths: list[str], schema: StructType, reader: dict, skip: int) -> DataFrame:
    if skip <= 1:
        return spark.read.schema(schema).options(**reader, header=str(skip == 1).lower()).csv(paths)
    return skip_lines(spark, paths, skip, reader.pop("lineSep", None)).select(
        F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), reader).alias("row")
    ).select("row.*")


def skip_lines(spark: SparkSession, paths: list[str], skip: int, line_sep: str | None = None) -> DataFrame:
    """Text lines without the first ``skip`` of each file.

    Lines of a file's first block are numbered consecutively inside their task,
    so the block's lowest number tells which lines to drop. One small row per
    file is joined back.
    """
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    lines = reader.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    firsts = lines.filter("block = 0").groupBy("file").agg(F.min("at").alias("first"))
    numbered = join_unique(lines, firsts, ["file"])
    return numbered.filter((F.col("block") > 0) | (F.col("at") >= F.col("first") + skip)).select("value")


def copy_from(
    spark: SparkSession, path: str | Sequence[str], target_path: str, schema: StructType, delimiter: str = ",", header: bool = True
) -> DataFrame:
    """Append CSV files to a parquet table; returns the table."""
    reader = spark.read.schema(schema).options(sep=delimiter, header=str(header).lower(), escape='"', nullValue="null")
    reader.csv([path] if isinstance(path, str) else list(path)).write.mode("append").parquet(target_path)
    return spark.read.schema(schema).parquet(target_path)


def insert(df: DataFrame, target_path: str) -> None:
    """Append rows to a parquet table."""
    df.write.mode("append").parquet(target_path)


def with_corrupt_column(schema: StructType, name: str = "_corrupt_record") -> StructType:
    """Schema for a permissive read that keeps lines it could not parse."""
    return StructType([*schema.fields, StructField(name, StringType())])
