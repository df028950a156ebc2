"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the jobs rely on; shuffle width and memory stay with the cluster."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 << 20))
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own: a machine-local
    path would be invisible to the other executors of a cluster.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return f"{named.rstrip('/')}/rosterlake/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rosterlake-"))
    return scratch_root(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other job uses, so nothing is ever overwritten while it is being read."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write parquet and read it back: lineage ends here and Catalyst sees the real size."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


# Intermediate tables of the scope at work. Threads see it if they run in a copy of the context.
_SCOPE: ContextVar[list[str] | None] = ContextVar("rosterlake_scratch", default=None)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table. It stays until its scope ends, or else with the application."""
    path = scratch_path(df.sparkSession, name)
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return write_table(df, path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables of the block at its end. Nothing that reads them may leave it."""
    paths: list[str] = []
    token = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
