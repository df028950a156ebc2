"""Staging files: headed CSV with a declared schema, strict or with a quarantine for bad rows."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.schemas import STAGING, STAGING_TABLE
from rosterlake.session import materialise, scratch_scope
from rosterlake.sources.tables import Tables

log = logging.getLogger(__name__)

# Names keep their padding: cleansing is a later step and must see what was delivered.
_FORMAT = {
    "header": True,
    "dateFormat": "yyyy-MM-dd",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "escape": '"',
}
RAW_LINE = "raw_line"
QUARANTINE = "staging_quarantine"


def write_staging_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(**_FORMAT).csv(path)


def read_staging_csv(spark: SparkSession, path: str, schema: T.StructType = STAGING) -> DataFrame:
    """The file's rows; one that does not fit the schema ends the job that meets it."""
    reader = spark.read.schema(schema).options(mode="FAILFAST", enforceSchema=False, **_FORMAT)
    return reader.csv(path)


@dataclass(frozen=True)
class StagedFile:
    """``rows`` fit the schema; ``quarantine`` has the lines that do not, with the file they stand in."""

    rows: DataFrame
    quarantine: DataFrame


def split_staging_csv(spark: SparkSession, path: str, schema: T.StructType = STAGING) -> StagedFile:
    """Both kinds of rows of the file, from one pass over it.

    A line is bad if a value does not have its column's type or the number of fields differs. The
    parsed rows are written once, so that both results see the same lines, and so that the parser
    is not asked for the bad lines alone.
    """
    with_line = T.StructType([*schema.fields, T.StructField(RAW_LINE, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW_LINE, "enforceSchema": True, **_FORMAT}
    read = spark.read.schema(with_line).options(**options).csv(path)
    parsed = materialise(read.withColumn("file_name", F.input_file_name()), "parsed-csv")
    fits = F.col(RAW_LINE).isNull()
    return StagedFile(
        parsed.filter(fits).select(*schema.fieldNames()), parsed.filter(~fits).select("file_name", RAW_LINE)
    )


def load_csv_to_staging(
    spark: SparkSession,
    path: str,
    store: Tables,
    schema: T.StructType = STAGING,
    quarantine: bool = False,
) -> bool:
    """Replace the staging table by the file. False if the rows cannot be loaded: the table then
    stays as it is. With ``quarantine``, bad lines go to a second table and the others are loaded."""
    with scratch_scope(spark):
        try:
            if quarantine:
                staged = split_staging_csv(spark, path, schema)
                store.reload(QUARANTINE, staged.quarantine)
                rows = staged.rows
            else:  # written aside first: a bad row must not leave an empty table
                rows = materialise(read_staging_csv(spark, path, schema), "staging-file")
            store.reload(STAGING_TABLE, rows)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                raise FileNotFoundError(path) from error
            raise
        except (PySparkException, Py4JJavaError):
            log.exception("staging load of %s failed", path)
            return False
    return True
