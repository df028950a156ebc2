"""The warehouse's tables as plain Parquet folders, one folder per load.

A load writes every table into a folder of its own; whoever names the folder reads that load. After
that, rows are appended, or the partitions that a batch touches are overwritten (dynamic partition
overwrite). Tables of employees are partitioned by blocks of employee ids, so that a batch rewrites
the blocks of its employees and nothing else; versions are partitioned by their current flag as well,
so that expired ones are added and never rewritten.

There is no coordination between writers: writers of one folder must not overlap, and a frame read
before an overwrite has to be read again after it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.schemas import OLAP, OLTP, TABLES
from rosterlake.session import write_table

LAYERS = {"OLTP": tuple(OLTP), "OLAP": tuple(OLAP)}
#: Ids of a block. INT ids bound the number of blocks at 32,768.
BLOCK_IDS = 65_536
_BLOCK, _WRITER = "id_block", "written_by"
#: What partitions current versions, which replace one another, and rows of the load.
_CURRENT, _LOAD = "current", "load"
_PROGRESS = "batch STRING, step STRING"


class Tables:
    """The tables of one folder."""

    def __init__(self, spark: SparkSession, root: str, block_ids: int = BLOCK_IDS):
        self.spark, self.root, self.block_ids = spark, root.rstrip("/"), block_ids
        self.changes = 0  # writes through this object

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    # --- layout ------------------------------------------------------------------------

    def block_of(self, column: str) -> Column:
        return F.expr(f"CAST({column} AS BIGINT) div {self.block_ids}")

    def _partitions(self, name: str) -> list[str]:
        table = TABLES.get(name)
        return list(table.partition_by) if table else []

    def _laid_out(self, name: str, rows: DataFrame, writer: str) -> DataFrame:
        """Declared columns and types, and the partition columns."""
        table = TABLES.get(name)
        if not table:
            return rows
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])
        if _BLOCK in table.partition_by:
            rows = rows.withColumn(_BLOCK, self.block_of("employee_id"))
        if _WRITER in table.partition_by:
            rows = rows.withColumn(_WRITER, F.when(F.col("is_current") == 1, _CURRENT).otherwise(writer))
        return rows

    def _write(self, name: str, rows: DataFrame, mode: str, writer: str, **options: str) -> None:
        self.changes += 1
        partitions = self._partitions(name)
        laid_out = self._laid_out(name, rows, writer)
        if partitions:  # whole partitions to a task, large ones split by adaptive execution
            # The writer sorts by the partitions anyway; the key keeps alike rows together, which pack better.
            laid_out = laid_out.hint("rebalance", *partitions).sortWithinPartitions(*partitions, *TABLES[name].primary_key)
        laid_out.write.mode(mode).options(**options).partitionBy(*partitions).parquet(self.folder(name))

    # --- writing -----------------------------------------------------------------------

    def reload(self, name: str, rows: DataFrame) -> DataFrame:
        """Empty the table and fill it with rows that do not come from it."""
        self._write(name, rows, "overwrite", _LOAD, partitionOverwriteMode="static")
        return self.read(name, rows.schema)

    def append(self, name: str, rows: DataFrame) -> None:
        self._write(name, rows, "append", uuid.uuid4().hex[:12])

    def replace_touched(self, name: str, rows: DataFrame, batch: str) -> None:
        """Overwrite the partitions that the rows fall into. Rows of the same batch overwrite
        themselves, so that a batch that is written again changes nothing."""
        self._write(name, rows, "overwrite", batch, partitionOverwriteMode="dynamic")

    def stage(self, batch: str, name: str, rows: DataFrame) -> DataFrame:
        """Rows of a batch outside the tables, so that what they were computed from can change."""
        return write_table(rows, f"{self.root}/batches/{batch}/{name}", mode="overwrite")

    # --- reading -----------------------------------------------------------------------

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """All rows; filters on the employee's block and the current flag reach the folders."""
        stored, names = self._stored(name, schema)
        reader = self.spark.read.schema(stored) if stored else self.spark.read
        rows = reader.parquet(self.folder(name))
        return rows.select(*names) if names else rows

    def _stored(self, name: str, schema: T.StructType | None = None):
        table = TABLES.get(name)
        declared = table.schema if table else schema
        if declared is None:
            return None, None
        extra = {_BLOCK: T.LongType(), _WRITER: T.StringType()}
        added = [T.StructField(c, extra[c]) for c in self._partitions(name) if c in extra]
        return T.StructType([*declared.fields, *added]), declared.fieldNames()

    def read_blocks(self, name: str, blocks: list[int]) -> DataFrame:
        """Rows of the given blocks of employees; the other folders are not opened."""
        stored, names = self._stored(name)
        rows = self.spark.read.schema(stored).parquet(self.folder(name))
        return rows.filter(F.col(_BLOCK).isin(blocks)).select(*names)

    def blocks(self, rows: DataFrame, column: str = "employee_id") -> list[int]:
        """The blocks of the rows' employees: as many as the table has folders, at most."""
        found = rows.select(self.block_of(column).alias("b")).filter("b IS NOT NULL").distinct()
        return sorted(r["b"] for r in found.collect())

    def tables(self, names=None) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in (TABLES if names is None else names)}

    # --- the highest id, from the files' footers -----------------------------------------

    def highest(self, name: str, column: str) -> DataFrame:
        """One row, ``highest``: the largest value of a column, NULL for an empty table.

        Parquet footers hold it: the reader that can answer aggregates from them runs in a session of its
        own, and no row is read.
        """
        session = self.spark.newSession()
        session.conf.set("spark.sql.sources.useV1SourceList", "")
        session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        stored, _ = self._stored(name)
        rows = session.read.schema(stored).parquet(self.folder(name))
        return rows.agg(F.max(column).alias("highest"))

    def next_id(self, name: str, column: str) -> int:
        """The highest id and 1, or 1 for an empty table."""
        return (self.highest(name, column).first()["highest"] or 0) + 1

    # --- progress of batches that may be delivered again ----------------------------------

    def reached(self, batch: str, step: str) -> bool:
        return not self._progress().filter((F.col("batch") == batch) & (F.col("step") == step)).isEmpty()

    def mark(self, batch: str, step: str) -> None:
        self.spark.createDataFrame([(batch, step)], _PROGRESS).write.mode("append").parquet(self.folder("progress"))

    def _progress(self) -> DataFrame:
        # An empty write, so that the folder exists before the first batch.
        self.spark.createDataFrame([], _PROGRESS).write.mode("ignore").parquet(self.folder("progress"))
        return self.spark.read.schema(_PROGRESS).parquet(self.folder("progress"))
