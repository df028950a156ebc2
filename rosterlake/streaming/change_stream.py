"""Role changes as a stream of files: one batch of the warehouse per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rosterlake.plans.operations import Workforce
from rosterlake.sources.tables import Tables

ROLE_CHANGES = (
    "change_id LONG, ts TIMESTAMP_NTZ, change_date DATE, employee_id INT, "
    "new_department_id INT, new_job_id LONG, new_monthly_income DECIMAL(10,2)"
)


def apply_batch(store: Tables, batch: DataFrame, batch_id: int) -> None:
    """Apply one micro-batch. One that is delivered again after a failure changes nothing."""
    Workforce(store).update_roles(batch, batch=f"role-changes-{batch_id}")


def follow_role_changes(
    spark: SparkSession, folder: str, store_root: str, checkpoint: str, once: bool = False
) -> StreamingQuery:
    """Apply the change files of a folder as they arrive, or those there are (``once``)."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        apply_batch(Tables(batch.sparkSession, store_root), batch, batch_id)

    feed = spark.readStream.schema(ROLE_CHANGES).parquet(folder)
    writer = feed.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
