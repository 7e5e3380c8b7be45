"""References to records that do not exist."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.sources.tables import blank, current_rows


@dataclass(frozen=True)
class Reference:
    """``child.field`` names a row of ``parent`` by ``parent_key``."""

    child: str
    field: str
    parent: str
    parent_key: str = "id"
    child_key: str = "id"


#: The references that the catalogue's tables hold.
CATALOGUE = (
    Reference("symbols", "file_path", "files", "path"),
    Reference("source_regions", "containing_symbol_id", "symbols"),
    Reference("type_arguments", "target_symbol_id", "symbols"),
    Reference("type_arguments", "identifier_id", "identifiers"),
)


def month_number(seconds: Column) -> Column:
    """Months since the year 0 of unix seconds in UTC, whatever the session's zone."""
    day = F.date_from_unix_date(F.floor(seconds / F.lit(86400)).cast("int"))
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def month_label(month: Column) -> Column:
    return F.when(month.isNotNull(), F.format_string("%04d-%02d", F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int")))


def _children(tables: dict[str, DataFrame], references, period: str) -> DataFrame:
    """Long form of the current rows' references: one row per reference that is neither null nor blank."""
    by_child: dict[tuple[str, str], list[Reference]] = {}
    for r in references:
        by_child.setdefault((r.child, r.child_key), []).append(r)
    parts = []
    for (child, key), refs in by_child.items():
        fields = list(dict.fromkeys(r.field for r in refs))
        now = current_rows(tables[child], key, fields, period)
        each = F.array(*[F.struct(F.lit(r.field).alias("ref_field"), F.lit(f"{r.parent}.{r.parent_key}").alias("parent"), F.col(r.field).cast("string").alias("ref_key")) for r in refs])
        parts.append(now.select(F.lit(child).alias("ref_table"), F.col(key).cast("string").alias("row_id"), month_number(F.col(period)).alias("month"), F.inline(each)).filter(~blank(F.col("ref_key"))))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missing_keys(tables: dict[str, DataFrame], references=CATALOGUE, period: str = "last_indexed") -> DataFrame:
    """Per parent table and key that children name too early or in vain: when the key first stands there.

    Tagged parent and child keys are united in long form and grouped by parent table and key; groups that
    lack the parent flag, or get it in a later month than some child, stay. The grouping
    combines partially before the shuffle, so a key that a third of all rows name costs
    one row per task. ``since`` is null where the parent never comes. A parent row
    without a period counts as being there from the start.
    """
    children = _children(tables, references, period).select("parent", "ref_key", F.lit(None).cast("int").alias("since"), F.lit(0).alias("is_parent"), "month")
    parents = []
    for parent, key in dict.fromkeys((r.parent, r.parent_key) for r in references):
        src = tables[parent].select(F.col(key).cast("string").alias("ref_key"), F.coalesce(month_number(F.col(period)), F.lit(0)).alias("since"))
        parents.append(src.filter(F.col("ref_key").isNotNull()).select(F.lit(f"{parent}.{key}").alias("parent"), "ref_key", "since", F.lit(1).alias("is_parent"), F.lit(None).cast("int").alias("month")))
    groups = _union([children, *parents]).groupBy("parent", "ref_key").agg(F.max("is_parent").alias("there"), F.min("since").alias("since"), F.min("month").alias("first_named"), F.count_if(F.col("is_parent") == 0).alias("named"))
    return groups.filter((F.col("named") > 0) & ((F.col("there") == 0) | (F.col("first_named") < F.col("since")))).select("parent", "ref_key", "since")


def orphan_references(tables: dict[str, DataFrame], references=CATALOGUE, period: str = "last_indexed") -> DataFrame:
    """One row per current row and field whose reference leads nowhere.

    Columns ref_table, ref_field, row_id, parent, ref_key, month (``yyyy-mm`` or null)
    and cause: ``missing`` (the key has no row in the parent table) or ``later``
    (all its rows are of a later calendar month than the referring row).

    Defined cases: a null or blank reference is none; keys compare as stored; a row with a null id
    is left out; of repeated rows the greatest ``period`` counts, all rows of a parent key do; a referring row without
    period is an orphan only of a key that is missing altogether; empty tables give
    no rows, an empty parent table makes every reference an orphan. Other columns don't matter.

    The children meet the (fewer) missing keys by an inner sort-merge join, the kind that adaptive
    execution splits where one missing key is named by very many rows.
    """
    gone = missing_keys(tables, references, period).select(F.col("parent").alias("__p"), F.col("ref_key").alias("__k"), "since")
    rows = _children(tables, references, period)
    hit = rows.join(gone.hint("merge"), (rows.parent == gone["__p"]) & (rows.ref_key == gone["__k"]) & (gone.since.isNull() | (rows.month < gone.since)))
    return hit.select("ref_table", "ref_field", "row_id", "parent", "ref_key", month_label(F.col("month")).alias("month"), F.when(F.col("since").isNull(), F.lit("missing")).otherwise(F.lit("later")).alias("cause"))


def orphan_report(tables: dict[str, DataFrame], references=CATALOGUE, period: str = "last_indexed") -> DataFrame:
    """Orphans per referring table, field and month beside all references, so that rates can be told.

    Columns ref_table, ref_field, month, refs, missing, later. Months without orphans are listed too.
    """
    gone = missing_keys(tables, references, period).select(F.col("parent").alias("__p"), F.col("ref_key").alias("__k"), "since", F.lit(1).alias("gone"))
    # counts first, so a hot key is one row per table, field and month before it meets the missing keys
    counts = _children(tables, references, period).groupBy("ref_table", "ref_field", "parent", "ref_key", "month").agg(F.count(F.lit(1)).alias("n"))
    both = counts.join(gone, (counts.parent == gone["__p"]) & (counts.ref_key == gone["__k"]), "left")
    missing, later = F.col("gone").isNotNull() & F.col("since").isNull(), F.col("month") < F.col("since")
    return both.groupBy("ref_table", "ref_field", month_label(F.col("month")).alias("month")).agg(F.sum("n").alias("refs"), F.sum(F.when(missing, F.col("n")).otherwise(0)).alias("missing"), F.sum(F.when(later, F.col("n")).otherwise(0)).alias("later"))
