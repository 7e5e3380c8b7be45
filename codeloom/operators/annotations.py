"""Annotations of symbols: their rows, filters, and what owners pass on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def doc_tags(symbols: DataFrame) -> DataFrame:
    """(symbol_id, ordinal, annotation) of the ``@tag`` marks in documentation comments, lower case, in their order.

    The catalogue's own annotation rows have the same columns. Null comments and comments without tags give no rows.
    """
    tags = F.regexp_extract_all(F.lower("doc_comment"), F.lit(r"@([a-z]\w*)"), F.lit(1))
    return symbols.filter(F.col("doc_comment").isNotNull()).select(F.col("id").alias("symbol_id"), F.posexplode(tags).alias("ordinal", "annotation"))


def hydrate(symbols: DataFrame, annotations: DataFrame) -> DataFrame:
    """Symbols with their annotations in order, joined by blanks; null without any.

    A symbol's annotations stand at one symbol in a source file, so a list of them is bounded by that text.
    """
    per = annotations.groupBy(F.col("symbol_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "annotation"))), lambda x: x["annotation"]), " ").alias("annotations"))
    return symbols.join(per, "id", "left")


def annotated(symbols: DataFrame, annotations: DataFrame, keys: list[str]) -> DataFrame:
    """the symbols that bear every one of some annotation keys (all symbols, if there are none)."""
    if not keys:
        return symbols
    wanted = sorted({k.lower() for k in keys})
    have = annotations.filter(F.col("annotation").isin(wanted)).groupBy(F.col("symbol_id").alias("id")).agg(F.count_distinct("annotation").alias("n"))
    return symbols.join(have.filter(F.col("n") == len(wanted)), "id", "left_semi")


def owned_by_annotated(sets: DataFrame, annotations: DataFrame, keys: list[str], tree: str = "symbols") -> DataFrame:
    """(node) of every node of a forest with nested-set ranges that has an ancestor with one of some annotations.

    The marked nodes' ranges are merged first to those that no other marked range holds, which are disjoint, so each position meets at most one;
    within a root they are joined by range.
    """
    marked = annotations.filter(F.col("annotation").isin([k.lower() for k in keys])).select(F.concat(F.lit(tree + ":"), "symbol_id").alias("node")).distinct()
    at = sets.join(marked, "node", "left_semi").filter(F.col("rgt") > F.col("lft")).select(F.col("root").alias("__r"), F.col("lft").alias("__l"), F.col("rgt").alias("__g"))
    return sets.join(at, (F.col("root") == F.col("__r")) & (F.col("lft") > F.col("__l")) & (F.col("lft") <= F.col("__g")), "left_semi").select("node")
