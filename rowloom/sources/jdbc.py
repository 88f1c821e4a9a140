"""JDBC sink: batched or single-row statements over a bounded number of connections."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowloom.operators.ingest import STATEMENT_ROWS


def jdbc_options(url: str, table: str, method: str = "batch", batch_rows: int = STATEMENT_ROWS, **options: str) -> dict[str, str]:
    if method not in ("batch", "singleton"):
        raise ValueError(f"unknown method {method}")
    size = 1 if method == "singleton" else batch_rows
    return {"url": url, "dbtable": table, "batchsize": str(size), **options}


def write_jdbc(
    df: DataFrame, url: str, table: str, method: str = "batch", connections: int = 8, batch_rows: int = STATEMENT_ROWS, **options: str
) -> None:
    """Append to a database table; every task holds one connection."""
    settings = jdbc_options(url, table, method, batch_rows, **options)
    df.repartition(connections).write.format("jdbc").options(**settings).mode("append").save()
