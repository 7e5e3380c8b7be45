"""Edges between client calls and handlers, and walks over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.graph import distances


def web_edges(matches: DataFrame, kind: str = "http_call") -> DataFrame:
    """Edges (id, from_id, to_id, kind, external, confidence) of :func:`codeloom.operators.resolve.match_routes`' result.

    A call without handler leads to a node of its own name, ``external:VERB path``, which has no way on.
    """
    to = F.coalesce("handler_id", F.concat(F.lit("external:"), "external"))
    return matches.select(F.concat_ws("|", F.lit(kind), "id", to).alias("id"), F.col("id").alias("from_id"), to.alias("to_id"), F.lit(kind).alias("kind"), F.col("handler_id").isNull().alias("external"), "confidence")


def by_kind(edges: DataFrame, kind: str) -> DataFrame:
    """The edges of one kind in the order of their sources."""
    return edges.filter(F.col("kind") == kind).orderBy("from_id", "to_id")


def web_distances(edges: DataFrame, web: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """Hops and predecessors over calls and web edges together; external nodes are reached but not left."""
    both = edges.select("id", "from_id", "to_id").unionByName(web.select("id", "from_id", "to_id"))
    return distances(both, starts, max_hops)


def web_callers(web: DataFrame, seeds: DataFrame) -> DataFrame:
    """Who calls some handlers over the web: one hop back, each caller once per seed with its best confidence."""
    s = seeds.select(F.col("id").alias("to_id")).distinct()
    return web.join(s, "to_id", "left_semi").groupBy(F.col("to_id").alias("seed"), F.col("from_id").alias("caller"), "kind").agg(F.max("confidence").alias("confidence"))
