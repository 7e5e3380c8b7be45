"""Queries on references, hierarchies and snapshots (problems 1, 3 and 6) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import hierarchy, orphans, snapshots
from codeloom.sources.tables import table


def _tables(spark, d, *names):
    return {n: table(spark, d, n) for n in names}


REFERENCED = ("symbols", "source_regions", "type_arguments", "files", "identifiers")


def p1_found(spark, d):
    return orphans.orphan_references(_tables(spark, d, *REFERENCED)).select("ref_table", "ref_field", "row_id")


def p1_report(spark, d):
    return orphans.orphan_report(_tables(spark, d, *REFERENCED))


def _sets(spark, d):
    return hierarchy.nested_sets(spark, hierarchy.catalogue_forest(_tables(spark, d, "symbols", "type_arguments")))


def p3_found(spark, d):
    sets = _sets(spark, d).filter("depth <> 0")
    return sets.select(F.col("tree").alias("node_table"), hierarchy.bare(F.col("node")).alias("node_id"), hierarchy.bare(F.col("root")).alias("root_id"), "depth")


def p3_hierarchy(spark, d):
    """Every node with its path, depth, root and the number of its descendants."""
    out = hierarchy.with_paths(spark, _sets(spark, d))
    return out.select(F.col("tree").alias("node_table"), hierarchy.bare(F.col("node")).alias("node_id"), hierarchy.bare(F.col("root")).alias("root_id"), "depth", "path", F.when(F.col("depth") >= 0, F.col("size") - 1).alias("descendants"))


def p3_ranges(spark, d):
    """Every node's preorder range: its descendants are the nodes of its root with lft in (lft, rgt], its ancestors those whose range holds its lft."""
    return _sets(spark, d).select(F.col("tree").alias("node_table"), hierarchy.bare(F.col("node")).alias("node_id"), hierarchy.bare(F.col("root")).alias("root_id"), "depth", "lft", "rgt")


def p3_descendants(spark, d):
    """Every node with each of its descendants, by the ranges."""
    pairs = hierarchy.all_descendants(_sets(spark, d))
    return pairs.select(F.col("tree").alias("node_table"), hierarchy.bare(F.col("ancestor")).alias("ancestor_id"), hierarchy.bare(F.col("node")).alias("node_id"))


def p3_cycles(spark, d):
    """Each cycle once: its smallest id, its length and the nodes that hang below it."""
    sets = _sets(spark, d).filter("depth < 0")
    return sets.groupBy(F.col("tree").alias("node_table"), hierarchy.bare(F.col("root")).alias("root_id")).agg(F.count_if("cyclic").alias("cycle_length"), F.count_if(~F.col("cyclic")).alias("below"))


def p6_found(spark, d):
    return snapshots.file_changes(table(spark, d, "file_snapshots")).select("revision", "workspace_id", "file_path", "change_kind")


def p6_log_audit(spark, d):
    return snapshots.change_log_audit(table(spark, d, "file_snapshots"), table(spark, d, "revision_file_changes"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_hierarchy, p3_ranges, p3_descendants, p3_cycles, p6_found, p6_log_audit)}

_MONTH = "(year(to_timestamp({0}) AT TIME ZONE 'UTC') * 12 + month(to_timestamp({0}) AT TIME ZONE 'UTC') - 1)"


def _refs():
    one = "SELECT '{c}' AS ref_table, '{f}' AS ref_field, '{p}.{k}' AS parent, id AS row_id, val AS ref_key, " + _MONTH.format("li") + " AS m FROM (SELECT id, max(last_indexed) AS li, arg_max({f}, last_indexed) AS val, count(*) FROM (SELECT id, last_indexed, coalesce({f}, '') AS {f} FROM {c}) GROUP BY id) WHERE trim(val) <> ''"
    return " UNION ALL ".join(one.format(c=r.child, f=r.field, p=r.parent, k=r.parent_key) for r in orphans.CATALOGUE)


def _parents():
    return " UNION ALL ".join(f"SELECT '{t}.{k}' AS parent, {k} AS key, min({_MONTH.format('last_indexed')}) AS since FROM {t} GROUP BY {k}" for t, k in (("files", "path"), ("symbols", "id"), ("identifiers", "id")))


_ORPHANS = f"WITH refs AS ({_refs()}), parents AS ({_parents()}), j AS (SELECT r.*, p.since FROM refs r LEFT JOIN parents p ON r.parent = p.parent AND r.ref_key = p.key)"


def _walk(table_name, parent):
    return f"""SELECT '{table_name}' AS node_table, c.id AS node_id, c.par AS par FROM
      (SELECT id, arg_max(p, last_indexed) AS par FROM (SELECT id, last_indexed, coalesce({parent}, '') AS p FROM {table_name}) GROUP BY id) c"""


_HIER = f"""WITH RECURSIVE cur AS ({_walk('symbols', 'parent_id')} UNION ALL {_walk('type_arguments', 'parent_arg_id')}),
 edge AS (SELECT a.node_table, a.node_id, b.node_id AS par FROM cur a LEFT JOIN cur b ON a.node_table = b.node_table AND a.par = b.node_id AND trim(a.par) <> ''),
 tree AS (SELECT node_table, node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM edge WHERE par IS NULL
   UNION ALL SELECT e.node_table, e.node_id, t.root_id, t.depth + 1, t.path || '/' || e.node_id FROM tree t JOIN edge e ON e.node_table = t.node_table AND e.par = t.node_id),
 bad AS (SELECT e.* FROM edge e LEFT JOIN tree t ON e.node_table = t.node_table AND e.node_id = t.node_id WHERE t.node_id IS NULL),
 up AS (SELECT node_table, node_id, par AS anc FROM bad UNION SELECT u.node_table, u.node_id, b.par FROM up u JOIN bad b ON b.node_table = u.node_table AND b.node_id = u.anc),
 ring AS (SELECT node_table, node_id FROM up WHERE node_id = anc),
 loop AS (SELECT u.node_table, u.node_id, min(u.anc) AS root_id FROM up u JOIN ring r ON r.node_table = u.node_table AND r.node_id = u.anc GROUP BY ALL),
 placed AS (SELECT node_table, node_id, root_id, depth, path FROM tree UNION ALL SELECT node_table, node_id, root_id, -1, NULL FROM loop)"""

_CHANGES = """cur AS (SELECT revision, file_path, arg_max(workspace_id, last_indexed) AS workspace_id, ltrim(arg_max(coalesce(lower(trim(hash)), ''), last_indexed), '0') AS h FROM file_snapshots GROUP BY 1, 2),
 steps AS (SELECT revision, row_number() OVER (ORDER BY revision) AS step FROM (SELECT DISTINCT revision FROM file_snapshots)),
 s AS (SELECT cur.*, step FROM cur JOIN steps USING (revision)),
 changes AS (SELECT st.revision, coalesce(b.workspace_id, a.workspace_id) AS workspace_id, coalesce(b.file_path, a.file_path) AS file_path,
   CASE WHEN a.file_path IS NULL THEN 'added' WHEN b.file_path IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' END AS change_kind
   FROM (SELECT * FROM s WHERE step > 1) b FULL JOIN (SELECT *, step + 1 AS nxt FROM s) a ON a.nxt = b.step AND a.file_path = b.file_path
   JOIN steps st ON st.step = coalesce(b.step, a.nxt))"""

ORACLES = {
    "p1_found": f"{_ORPHANS} SELECT ref_table, ref_field, row_id FROM j WHERE since IS NULL OR m < since",
    "p1_report": f"{_ORPHANS} SELECT ref_table, ref_field, lpad((m // 12)::VARCHAR, 4, '0') || '-' || lpad((m % 12 + 1)::VARCHAR, 2, '0') AS month, count(*) AS refs, sum((since IS NULL)::INT)::BIGINT AS missing, coalesce(sum((m < since)::INT), 0)::BIGINT AS later FROM j GROUP BY ref_table, ref_field, m",
    "p3_found": f"{_HIER} SELECT node_table, node_id, root_id, depth::INT AS depth FROM placed WHERE depth <> 0",
    "p3_hierarchy": f"""{_HIER}, anc AS (SELECT node_table, unnest(string_split(path, '/')) AS node_id FROM tree)
      SELECT p.*, CASE WHEN p.depth >= 0 THEN (SELECT count(*) FROM anc a WHERE a.node_table = p.node_table AND a.node_id = p.node_id)::BIGINT - 1 END AS descendants
      FROM (SELECT node_table, node_id, root_id, depth::INT AS depth, path FROM placed) p""",
    "p3_descendants": f"""{_HIER} SELECT node_table, ancestor_id, node_id FROM (SELECT node_table, node_id, unnest(string_split(path, '/')) AS ancestor_id FROM tree) WHERE ancestor_id <> node_id""",
    "p3_cycles": f"""{_HIER} SELECT l.node_table, l.root_id, count(r.node_id)::BIGINT AS cycle_length, (count(*) - count(r.node_id))::BIGINT AS below
      FROM loop l LEFT JOIN ring r ON r.node_table = l.node_table AND r.node_id = l.node_id GROUP BY 1, 2""",
    "p6_found": f"WITH {_CHANGES} SELECT revision, workspace_id, file_path, change_kind FROM changes WHERE change_kind IS NOT NULL",
    "p6_log_audit": f"""WITH {_CHANGES}, t AS (SELECT revision, file_path, change_kind FROM changes WHERE change_kind IS NOT NULL),
      l AS (SELECT DISTINCT revision, file_path, change_kind FROM revision_file_changes WHERE revision IS NOT NULL AND file_path IS NOT NULL)
      SELECT coalesce(t.revision, l.revision) AS revision, coalesce(t.change_kind, l.change_kind) AS change_kind,
        CASE WHEN l.file_path IS NULL THEN 'not_logged' WHEN t.file_path IS NULL THEN 'not_so' WHEN t.change_kind IS NOT DISTINCT FROM l.change_kind THEN 'agrees' ELSE 'other_kind' END AS verdict, count(*)::BIGINT AS n
      FROM t FULL JOIN l ON t.revision = l.revision AND t.file_path = l.file_path GROUP BY 1, 2, 3""",
}
