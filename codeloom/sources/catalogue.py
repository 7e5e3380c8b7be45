"""The catalogue's tables as the engine reads them: current rows, and the reference graph derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import current_rows, table

#: Which edge a use of a name makes.
EDGE_KINDS = {"call": "calls", "import": "imports", "type_usage": "uses", "member_access": "uses"}


def symbols(spark, d: str, *columns: str) -> DataFrame:
    """The current row of each symbol id (insert or replace by id)."""
    return current_rows(table(spark, d, "symbols"), "id", list(columns))


def files(spark, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "files"), "path", list(columns))


def identifiers(spark, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "identifiers"), "id", list(columns))


def type_arguments(spark, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "type_arguments"), "id", list(columns))


def source_regions(spark, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "source_regions"), "id", list(columns))


def tool_calls(spark, d: str, *columns: str) -> DataFrame:
    return current_rows(table(spark, d, "tool_calls"), "id", list(columns), "called_at")


def edge_kind(kind):
    out = F.lit("references")
    for use, edge in EDGE_KINDS.items():
        out = F.when(kind == use, F.lit(edge)).otherwise(out)
    return out


def edges(spark, d: str) -> DataFrame:
    """Resolved uses as edges (id, from_id, to_id, kind, file_path, line_number, confidence); edges with a missing end are dropped."""
    uses = identifiers(spark, d, "kind", "file_path", "start_line", "containing_symbol_id", "target_symbol_id", "confidence")
    ids = symbols(spark, d).select("id")
    out = uses.select("id", F.col("containing_symbol_id").alias("from_id"), F.col("target_symbol_id").alias("to_id"), edge_kind(F.col("kind")).alias("kind"), "file_path", F.col("start_line").alias("line_number"), "confidence")
    out = out.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return out.select("id", "from_id", "to_id", "kind", "file_path", "line_number", "confidence")
