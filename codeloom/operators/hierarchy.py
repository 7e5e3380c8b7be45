"""Parent-child rows as full hierarchies: paths, depths, roots, nested sets, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.plans.cut import Workspace
from codeloom.plans.split import split_prefix
from codeloom.sources.tables import blank, current_rows

SEPARATOR = "/"


def forest(parts: dict[str, tuple[DataFrame, str, str]], version: str = "last_indexed") -> DataFrame:
    """Rows (tree, node, parent) of several tables, each given as (table, id column, parent column).

    The current row of an id counts. A parent that is null, blank or no id of its table becomes null.
    """
    out = None
    for name, (df, key, parent) in parts.items():
        now = current_rows(df, key, [parent], version).select(F.lit(name).alias("tree"), F.concat(F.lit(name + ":"), F.col(key).cast("string")).alias("node"), F.when(~blank(F.col(parent).cast("string")), F.concat(F.lit(name + ":"), F.col(parent).cast("string"))).alias("parent"))
        out = now if out is None else out.unionByName(now)
    ids = out.select(F.col("node").alias("__there"))
    # the parent's side is unique; many children of one parent are split by adaptive execution
    return out.join(ids, out.parent == ids["__there"], "left").select("tree", "node", F.col("__there").alias("parent"))


def _ring_minimum(ws: Workspace, ring: DataFrame) -> DataFrame:
    """The smallest node of each cycle, by pointer doubling, twice a round: (node, least)."""
    now = ring.select("node", F.col("parent").alias("next"), F.least("node", "parent").alias("least"))

    def double(rows: DataFrame) -> DataFrame:
        there = rows.select(F.col("node").alias("__n"), F.col("next").alias("__next"), F.col("least").alias("__least"))
        step = rows.join(there, rows.next == there["__n"])
        return step.select("node", F.col("__next").alias("next"), F.least("least", "__least").alias("least"), (F.col("__least") < F.col("least")).alias("moved"))

    while True:
        seen = Observation()
        now = ws.cut(double(double(now).drop("moved")).observe(seen, F.count_if("moved").alias("n")), "ring").drop("moved")
        if not seen.get["n"]:
            return now.select("node", "least")


def _climb(ws: Workspace, edges: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Upward: the rows (node, up, size) of each round, and those (node, up) that never reach a root.

    By doubling: before round k ``up`` is the ancestor 2**k steps above and ``size`` counts the descendants less than 2**k steps
    below, itself included; nodes that have no such ancestor are through. A tree of depth d takes log2(d) + 1 rounds, so a
    chain of a million nodes takes twenty, and each round handles only nodes at least 2**k deep. A round that
    loses no node has cycles alone before it: with an ancestor 2**(k+1) above on a way that ends, some node would have ended in between.
    """
    now, left = ws.counted(edges.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("size")), "climb")
    rounds = []
    while left:
        rounds.append(now)
        # combined before the shuffle, so a parent of a third of all nodes is one row per task
        add = now.groupBy(F.col("up").alias("__m")).agg(F.sum("size").alias("__add"))
        above = now.select(F.col("node").alias("__n"), F.col("up").alias("__up"))
        step = now.join(above, now.up == above["__n"]).join(add, F.col("node") == F.col("__m"), "left")
        now, count = ws.counted(step.select("node", F.col("__up").alias("up"), (F.col("size") + F.coalesce("__add", F.lit(0))).alias("size")), "climb")
        if count == left:
            return rounds, now.select("node", "up")
        left = count
    return rounds, None


def _on_cycles(ws: Workspace, looped: DataFrame) -> DataFrame:
    """(node) of those that lie on a cycle, from nodes on or below one with an ancestor of each.

    The ancestors 2**k steps above shrink to the cycles as k grows; once they stay as many, walking permutes them.
    """
    now = looped
    image, left = ws.counted(now.select(F.col("up").alias("node")).distinct(), "image")
    while True:
        # the ancestors' ancestors
        above = now.select(F.col("node").alias("__n"), F.col("up").alias("__up"))
        nxt, count = ws.counted(image.join(above, image.node == above["__n"]).select(F.col("__up").alias("node")).distinct(), "image")
        if count == left:
            return nxt
        now = ws.cut(now.join(above, now.up == above["__n"]).select("node", F.col("__up").alias("up")), "walk")
        image, left = nxt, count


def nested_sets(spark, nodes: DataFrame) -> DataFrame:
    """Root, depth, subtree size and preorder range of each node of a forest of (tree, node, parent).

    Upward: subtree sizes by doubling (see :func:`_climb`); what never reaches a root lies on a cycle or below one.
    Downward: prefix sums over siblings' sizes (split, so that a parent with very many children is no hot task) give each
    child its offset; a node's place is the sum of 1 + offset over itself and its ancestors, which doubling
    adds up along with depth and root. Both ways take log2(depth) + 1 rounds at every size, whatever the shape.

    Columns: tree, node, parent, root, depth, size, lft, rgt, cyclic. Descendants of x are
    the nodes of its root with x.lft < lft <= x.rgt, ancestors those with lft < x.lft <= rgt. Roots have depth 0.
    Nodes on a cycle (cyclic) or below one have depth -1, the smallest node of the cycle as root and null ranges; those on one have null size.
    An empty forest gives no rows; ``node`` must be unique and not null, ``parent`` null or a node.
    """
    ws = Workspace(spark, "hierarchy")
    state = ws.cut(nodes.select("node", "parent"), "nodes")
    rounds, looped = _climb(ws, state.filter(F.col("parent").isNotNull()))
    rows = state.withColumn("least", F.lit(None).cast("string"))
    adds = [r.select("up", "size") for r in rounds]
    if looped is not None:
        ring = _on_cycles(ws, looped).withColumnRenamed("node", "__r")
        least = _ring_minimum(ws, state.join(ring, F.col("node") == F.col("__r"), "left_semi"))
        rows = state.join(least.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left").drop("__n")
        # nodes below cycles: the cycles' nodes are their roots
        hanging = state.join(looped.select(F.col("node").alias("__l")), F.col("node") == F.col("__l"), "left_semi")
        below, _ = _climb(ws, hanging.join(ring, F.col("node") == F.col("__r"), "left_anti"))
        adds = [a.join(looped.select(F.col("node").alias("up")), "up", "left_anti") for a in adds] + [r.select("up", "size") for r in below]
        rounds += below
    if adds:
        total = adds[0]
        for a in adds[1:]:
            total = total.unionByName(a)
        total = total.groupBy(F.col("up").alias("__n")).agg(F.sum("size").alias("add"))
        rows = rows.join(total, F.col("node") == F.col("__n"), "left").drop("__n")
    else:
        rows = rows.withColumn("add", F.lit(None).cast("long"))
    cyclic = F.col("least").isNotNull()
    rows = ws.cut(rows.select("node", "parent", F.when(~cyclic, F.coalesce("add", F.lit(0)) + 1).alias("size"), cyclic.alias("cyclic"), "least"), "sized")
    for r in [state, *rounds]:
        ws.drop(r)

    kids = rows.filter(F.col("parent").isNotNull() & ~F.col("cyclic"))
    offsets = split_prefix(kids.select("parent", "node", "size"), ["parent"], ["node"], F.col("size"), "off")
    offsets = offsets.select("node", "parent", "size", F.lit(False).alias("cyclic"), F.lit(None).cast("string").alias("least"), (F.col("off") + 1).alias("lft"))
    tops = rows.filter(F.col("parent").isNull() | F.col("cyclic")).select("node", "parent", "size", "cyclic", "least", F.lit(0).cast("long").alias("lft"))
    top = F.col("parent").isNull() | F.col("cyclic")
    # a cycle's node as root has a depth so low that every sum with it stays negative
    start = tops.unionByName(offsets).select(
        "node", "parent", "size", "cyclic", F.when(~top, F.col("parent")).alias("up"), F.when(top, F.coalesce("least", "node")).alias("root"),
        F.when(F.col("cyclic"), F.lit(-(1 << 60))).when(top, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"), "lft",
    )
    going_on = F.col("up").isNotNull()
    seen = Observation()
    now = ws.cut(start.observe(seen, F.count_if(going_on).alias("n")), "start")
    ws.drop(rows)
    through = [now.filter(~going_on)]
    while seen.get["n"]:
        going = now.filter(going_on)
        above = going
        for t in through:
            above = above.unionByName(t)
        above = above.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("root").alias("__root"), F.col("depth").alias("__depth"), F.col("lft").alias("__lft"))
        step = going.join(above, F.col("up") == F.col("__n")).select("node", "parent", "size", "cyclic", F.col("__up").alias("up"), F.col("__root").alias("root"), (F.col("depth") + F.col("__depth")).alias("depth"), (F.col("lft") + F.col("__lft")).alias("lft"))
        seen = Observation()
        now = ws.cut(step.observe(seen, F.count_if(going_on).alias("n")), "down")
        through.append(now.filter(~going_on))
    out = through[0]
    for t in through[1:]:
        out = out.unionByName(t)
    ranged = F.col("depth") >= 0
    return out.select(F.substring_index("node", ":", 1).alias("tree"), "node", "parent", "root", F.when(ranged, F.col("depth")).otherwise(-1).cast("int").alias("depth"), "size", F.when(ranged, F.col("lft")).alias("lft"), F.when(ranged, F.col("lft") + F.col("size") - 1).alias("rgt"), "cyclic")


CATALOGUE = {"symbols": ("id", "parent_id"), "type_arguments": ("id", "parent_arg_id")}


def catalogue_forest(tables: dict[str, DataFrame]) -> DataFrame:
    return forest({name: (tables[name], *CATALOGUE[name]) for name in CATALOGUE})


def bare(node) -> Column:
    """The id within its table."""
    return F.substring(node, F.instr(node, ":") + 1, 1 << 30)


def with_paths(spark, sets: DataFrame) -> DataFrame:
    """Adds ``path``: the bare ids from the root to the node, joined by ``/``; null on and below cycles.

    Paths are as long as their nodes are deep, which no other column is; they are made by doubling: after round k each node knows its
    2**k nearest ancestors, so a chain of a thousand nodes takes ten rounds.
    """
    ws = Workspace(spark, "paths")
    rows = sets.select("tree", "node", "root", "depth", "size", "lft", "rgt", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), F.when(F.col("depth") >= 0, bare(F.col("node"))).alias("path"))
    rows = ws.cut(rows, "start")
    while rows.filter(F.col("up").isNotNull()).limit(1).count():
        above = rows.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("path").alias("__path"))
        step = rows.join(above, rows.up == above["__n"], "left")
        step = step.select("tree", "node", "root", "depth", "size", "lft", "rgt", F.col("__up").alias("up"), F.when(F.col("__path").isNotNull(), F.concat_ws(SEPARATOR, "__path", "path")).otherwise(F.col("path")).alias("path"))
        nxt = ws.cut(step, "double")
        ws.drop(rows)
        rows = nxt
    return rows.drop("up")


def descendants(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ancestor, node) for each row of ``wanted`` (column node): all its descendants, by range within its root.

    Only asked-for ancestors are expanded; the rest is told by (root, lft, rgt). An equi join on root with a range residual.
    """
    asked = sets.join(wanted.select(F.col("node").alias("__w")).distinct(), F.col("node") == F.col("__w")).select(F.col("node").alias("ancestor"), F.col("root").alias("__r"), F.col("lft").alias("__l"), F.col("rgt").alias("__g"))
    return sets.join(asked, (sets.root == asked["__r"]) & (sets.lft > asked["__l"]) & (sets.lft <= asked["__g"])).select("ancestor", "node", "depth")


#: Positions of a range that are made at once, so that no range is one long array.
BLOCK = 4096


def all_descendants(sets: DataFrame) -> DataFrame:
    """(tree, ancestor, node) for every node and each of its descendants, from the ranges.

    Positions within a root are dense and unique, so a range is spelt out and each position meets its node by an equi join on (root, position):
    the work is that of the pairs that come out, and neither a large root nor a node with very many children makes a hot task.
    Nodes on and below cycles have no ranges and give no pairs.
    """
    wide = sets.filter(F.col("rgt") > F.col("lft")).select(F.col("node").alias("ancestor"), "root", F.col("rgt").alias("__last"), F.explode(F.sequence(F.col("lft") + 1, F.col("rgt"), F.lit(BLOCK).cast("long"))).alias("__first"))
    spelt = wide.select("ancestor", F.col("root").alias("__r"), F.explode(F.sequence(F.col("__first"), F.least(F.col("__first") + (BLOCK - 1), F.col("__last")))).alias("__at"))
    there = sets.filter(F.col("lft") > 0).select("tree", "root", "lft", "node")
    return spelt.join(there, (F.col("__r") == there["root"]) & (F.col("__at") == there["lft"])).select("tree", "ancestor", "node")
