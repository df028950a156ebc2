"""Which layer answers a query: the star schema, unless operational fields are needed.

A field is operational if a table of the operational layer has it and no table of the star schema.
Texts in bulk are judged by their words, as column expressions; one text that is about to run is
judged by its parsed plan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.schemas import OLAP, OLTP

STAR, OPERATIONAL = "OLAP", "OLTP"
DEFAULT = "default"
_STAR_FIELDS = {c.lower() for table in OLAP.values() for c in table.columns}
#: Fields and tables that only the operational layer has.
FIELDS = tuple(sorted({c.lower() for table in OLTP.values() for c in table.columns} - _STAR_FIELDS))
TABLES = tuple(sorted(set(OLTP) - set(OLAP)))

# What is not a name in use: literals, comments, the name that AS gives.
_LITERAL = r"'(?:[^']|'')*'|--[^\n]*|/\*(?s:.*?)\*/"
_NAMED = r"\bas\s+`?[a-z_][a-z0-9_]*`?"
_NAME = r"[a-z_][a-z0-9_]*"
#: Queries that the text names itself: WITH name AS (...).
_OWN = r"([a-z_][a-z0-9_]*)\s+as\s*\("


def layer_of(names: Iterable[str], tables: Iterable[str]) -> tuple[str, str]:
    """(layer, reason) from the fields and tables that a query uses."""
    needed = sorted({n.lower() for n in names} & set(FIELDS))
    if needed:
        return OPERATIONAL, f"needs {', '.join(needed)}"
    read = sorted({t.lower() for t in tables} & set(TABLES))
    return (OPERATIONAL, f"reads {', '.join(read)}") if read else (STAR, DEFAULT)


def routed(queries: DataFrame, column: str = "sql_text") -> DataFrame:
    """The rows with ``layer`` and ``reason``; null and empty texts go to the star schema."""
    plain = F.regexp_replace(F.lower(F.coalesce(F.col(column), F.lit(""))), _LITERAL, " ")
    names = F.regexp_extract_all(F.regexp_replace(plain, _NAMED, " "), F.lit(_NAME), F.lit(0))
    own = F.regexp_extract_all(plain, F.lit(_OWN), F.lit(1))

    def used(known: tuple[str, ...], found: Column) -> Column:
        return F.array_intersect(F.array(*map(F.lit, known)), found)

    marked = queries.withColumn("__needed", used(FIELDS, names)).withColumn(
        "__read", F.array_except(used(TABLES, names), own)
    )
    needed, read = F.col("__needed"), F.col("__read")
    reason = (
        F.when(F.size(needed) > 0, F.concat(F.lit("needs "), F.array_join(needed, ", ")))
        .when(F.size(read) > 0, F.concat(F.lit("reads "), F.array_join(read, ", ")))
        .otherwise(DEFAULT)
    )
    layer = F.when(F.size(needed) + F.size(read) > 0, OPERATIONAL).otherwise(STAR)
    return marked.withColumn("layer", layer).withColumn("reason", reason).drop("__needed", "__read")
