"""Session settings and scratch folders shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the results depend on; all of them can be set on a running session.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.chunkBase64String.enabled": "false",
}

# Wide generated projections exceed the size the JVM compiles to machine code;
# with this limit Spark splits them into methods it does compile.
SPEED_SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}

# Makes Spark delete the shuffle files of a query when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_SCRATCH: dict[str, str] = {}


def apply_settings(spark: SparkSession) -> SparkSession:
    for key, value in {**RESULT_SETTINGS, **SPEED_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "rowloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RESULT_SETTINGS, **SPEED_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return apply_settings(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder; anything else is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="rowloom-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/rowloom-{uuid.uuid4().hex}/{name}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that are made and run in here leave no shuffle files behind; else they stay until the driver collects its garbage."""
    before = spark.conf.get(FREE_SHUFFLES)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def reliable_checkpoint(df):
    """Cut lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
