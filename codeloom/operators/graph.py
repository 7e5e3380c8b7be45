"""Reference graphs: centrality, shortest paths, impact, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.paths import is_test_path
from codeloom.plans.cut import Workspace

#: Weight of an incoming edge by kind; other kinds weigh 1.
EDGE_WEIGHTS = {"calls": 3.0, "implements": 2.0, "imports": 2.0, "extends": 2.0, "instantiates": 2.0, "contains": 0.0}
USE_WEIGHTS = {"type_usage": 1.0, "import": 2.0}
TYPE_KINDS = ("class", "struct", "enum", "interface", "trait", "type", "module", "namespace", "constant")
INHERIT, TEST_FACTOR = 0.7, 0.1
PATH_KINDS = ("calls", "instantiates", "overrides")
IMPACT_PRIORITY = {"calls": 0, "overrides": 1, "implements": 2, "extends": 3, "instantiates": 4, "references": 5, "imports": 6}
FRONTIER = 250


def _weight(kind, table, default):
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def reference_scores(symbols: DataFrame, edges: DataFrame, uses: DataFrame) -> DataFrame:
    """Weighted in-degree with propagation, each step on the result of the one before.

    1 direct edges by kind, self-loops left out; 1b uses of type names from other files, by full name and by what follows
    the first dot, on symbols outside tests; 2 implementations inherit 0.7 of what they implement or extend; 3 classes without
    score inherit 0.7 of their best constructor; 4 symbols of test paths keep a tenth; 5 functions of C and C++ without
    score inherit 0.7 of their header's.
    """
    ws = Workspace(symbols.sparkSession, "scores")
    s = ws.cut(symbols.select("id", "name", "kind", "language", "file_path", "parent_id"), "symbols")
    edges = ws.cut(edges.select("from_id", "to_id", "kind"), "edges")
    direct = edges.filter(F.col("from_id") != F.col("to_id")).groupBy(F.col("to_id").alias("id")).agg(F.sum(_weight(F.col("kind"), EDGE_WEIGHTS, 1.0)).alias("direct"))
    named = uses.filter(F.col("kind").isin(*USE_WEIGHTS)).select("name", "file_path", "kind")
    tail = named.filter(F.instr("name", ".") > 0).withColumn("name", F.expr("substring(name, instr(name, '.') + 1)"))
    # counts first: a name used very often is one row per file and kind before it meets the symbols
    counted = named.unionByName(tail).groupBy("name", "file_path", "kind").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("n") * _weight(F.col("kind"), USE_WEIGHTS, 0.0))
    total = counted.groupBy("name").agg(F.sum("w").alias("all"))
    own = counted.groupBy("name", "file_path").agg(F.sum("w").alias("own"))
    boost = s.filter(F.col("kind").isin(*TYPE_KINDS) & ~is_test_path(F.col("file_path"))).join(total, "name").join(own, ["name", "file_path"], "left").select("id", (F.col("all") - F.coalesce("own", F.lit(0.0))).alias("boost"))
    # steps that the next one reads twice are written once
    one = ws.cut(s.join(direct, "id", "left").join(boost, "id", "left").withColumn("score", F.coalesce("direct", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))).drop("direct", "boost"), "direct")
    base = one.select(F.col("id").alias("to_id"), F.col("score").alias("theirs"))
    up = edges.filter(F.col("kind").isin("implements", "extends")).join(base, "to_id").groupBy(F.col("from_id").alias("id")).agg(F.sum(F.col("theirs") * INHERIT).alias("more"))
    two = ws.cut(one.join(up, "id", "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more"), "inherited")
    best = two.filter(F.col("kind") == "constructor").groupBy(F.col("parent_id").alias("id")).agg(F.max("score").alias("best"))
    three = two.join(best, "id", "left").withColumn("score", F.when(F.col("kind").isin("class", "struct") & (F.col("score") == 0) & F.col("best").isNotNull(), F.col("best") * INHERIT).otherwise(F.col("score"))).drop("best")
    four = three.withColumn("score", F.when(is_test_path(F.col("file_path")), F.col("score") * TEST_FACTOR).otherwise(F.col("score")))
    heads = four.filter(F.col("file_path").rlike(r"\.(h|hpp|hh)$")).groupBy("name", "kind").agg(F.max("score").alias("head"))
    five = four.join(heads, ["name", "kind"], "left")
    inherits = F.col("language").isin("c", "cpp") & (F.col("kind") == "function") & (F.col("score") == 0) & F.col("head").isNotNull()
    return five.withColumn("score", F.round(F.when(inherits, F.col("head") * INHERIT).otherwise(F.col("score")), 9)).select("id", "name", "kind", "file_path", "score")


def distances(edges: DataFrame, starts: DataFrame, max_hops: int) -> DataFrame:
    """Hops and predecessor of every node that starts reach along edges.

    Level by level; each level is a written table, so lineage stays short and a lost executor costs no more than its tasks. The
    predecessor of a node is the least (from_id, edge id) of the level before. Stops when a level adds nothing.
    """
    spark = edges.sparkSession
    ws = Workspace(spark, "hops")
    e = ws.cut(edges.filter(F.col("from_id") != F.col("to_id")).select("from_id", "to_id", "id").distinct(), "edges")
    level = ws.cut(starts.select("id").distinct().select("id", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("via")), "start")
    seen = level
    for hop in range(1, max_hops + 1):
        step = e.join(level.select(F.col("id").alias("from_id")), "from_id").groupBy("to_id").agg(F.min(F.struct("from_id", "id")).alias("p"))
        step = step.select(F.col("to_id").alias("id"), F.lit(hop).alias("hops"), F.col("p.from_id").alias("via"))
        level = ws.cut(step.join(seen.select("id"), "id", "left_anti"), "level")
        if not level.limit(1).count():
            break
        seen = seen.unionByName(level)
    return seen


def impact(edges: DataFrame, scores: DataFrame, seeds: DataFrame, max_depth: int, cap: int = FRONTIER) -> DataFrame:
    """Who is affected when seeds change: callers of callers, breadth first.

    Per depth the best edge of each source counts (kind's priority, confidence, target); everything found is marked, the first ``cap`` in impact
    order (priority, score, id) are returned and walked further.
    """
    spark = edges.sparkSession
    ws = Workspace(spark, "impact")
    kind = F.when(F.col("kind") == "uses", "references").otherwise(F.col("kind"))
    e = edges.withColumn("kind", kind).filter(F.col("kind").isin(*IMPACT_PRIORITY)).withColumn("priority", _weight(F.col("kind"), IMPACT_PRIORITY, 9).cast("int"))
    e = ws.cut(e.select("from_id", "to_id", "priority", "confidence").join(scores.select(F.col("id").alias("from_id"), F.col("score")), "from_id", "left"), "edges")
    frontier = ws.cut(seeds.select("id").distinct(), "seeds")
    seen, out = frontier, None
    for depth in range(1, max_depth + 1):
        hits = e.join(frontier.select(F.col("id").alias("to_id")), "to_id")
        best = hits.groupBy(F.col("from_id").alias("id")).agg(F.min(F.struct("priority", (-F.coalesce("confidence", F.lit(0.0))).alias("c"), "to_id")).alias("b"), F.max("score").alias("score"))
        fresh = ws.cut(best.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), F.col("b.priority").alias("priority"), F.col("b.to_id").alias("target"), "score"), "found")
        kept = ws.cut(fresh.orderBy("priority", F.desc_nulls_last("score"), "id").limit(cap), "kept")
        out = kept if out is None else out.unionByName(kept)
        seen = seen.unionByName(fresh.select("id"))
        frontier = kept.select("id")
        if not kept.limit(1).count():
            break
    return out


def neighbours(edges: DataFrame, pivots: DataFrame) -> DataFrame:
    """Nodes next to pivots, incoming before outgoing, one row per node, pivots left out."""
    p = pivots.select("id").distinct()
    into = edges.join(p.withColumnRenamed("id", "to_id"), "to_id").select(F.col("from_id").alias("id"), F.lit(0).alias("d"), F.lit("incoming").alias("direction"), "kind", F.col("to_id").alias("pivot"))
    out = edges.join(p.withColumnRenamed("id", "from_id"), "from_id").select(F.col("to_id").alias("id"), F.lit(1).alias("d"), F.lit("outgoing").alias("direction"), "kind", F.col("from_id").alias("pivot"))
    both = into.unionByName(out).join(p, "id", "left_anti")
    return both.groupBy("id").agg(F.min(F.struct("d", "kind", "pivot", "direction")).alias("b")).select("id", "b.direction", "b.kind", "b.pivot")


def degree_stats(edges: DataFrame) -> DataFrame:
    """In- and out-degrees in one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("from_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("to_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))


def owner_chain(sets_with_paths: DataFrame, names: DataFrame) -> DataFrame:
    """Per node its ancestors' names from the root down, as text; from paths, so any depth takes one join."""
    steps = sets_with_paths.filter(F.col("path").isNotNull()).select("node", F.posexplode(F.split("path", "/")).alias("at", "step"))
    named = steps.join(names.select(F.col("id").alias("step"), "name"), "step").filter(F.col("node") != F.concat(F.lit("symbols:"), F.col("step")))
    return named.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " ").alias("owners"))


def first_by(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """At most n rows per group in a total order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("__r") <= n).drop("__r")


def endpoints(symbols: DataFrame, name: str, file_path: str | None = None, unique: bool = True) -> list[str]:
    """Ids of the symbols of a name (in a file). A start must be unique: ValueError if it isn't, or if there is none."""
    from codeloom.functions.paths import suffix_match

    hit = symbols.filter(F.col("name") == name)
    if file_path:
        hit = hit.filter(suffix_match(F.col("file_path"), file_path))
    ids = [r.id for r in hit.select("id").orderBy("id").limit(2 if unique else 1000).collect()]
    if not ids or (unique and len(ids) > 1):
        raise ValueError(f"{name!r} is {'ambiguous' if ids else 'unknown'}")
    return ids


def second_hop(edges: DataFrame, pivots: DataFrame, first: DataFrame, scores: DataFrame, tests: DataFrame, enough: int = 4, expand: int = 3) -> DataFrame:
    """Neighbours of the three best first neighbours outside tests, if there are fewer than four such; first occurrences win."""
    plain = first.join(tests.select("id"), "id", "left_anti")
    if plain.limit(enough).count() >= enough:
        return first
    best = plain.join(scores, "id", "left").orderBy(F.desc_nulls_last("score"), "id").limit(expand).select("id")
    more = neighbours(edges, best).join(first.select("id").unionByName(pivots.select("id")), "id", "left_anti")
    return first.unionByName(more)
