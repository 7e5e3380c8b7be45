"""Queries on telemetry, change events, revisions and sinks (A, I, D20-D29, J, K) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import catalog, changes, telemetry
from codeloom.operators import vectors as V
from codeloom.queries.base import Area
from codeloom.sources import catalogue as T
from codeloom.sources.tables import table

query = Area()
_SUMMARY = "count(*)::BIGINT AS calls, round(sum(duration_ms::DECIMAL(24,6))::DOUBLE / count(duration_ms), 9) AS avg_ms, coalesce(sum(source_bytes), 0)::BIGINT AS source_bytes, coalesce(sum(output_bytes), 0)::BIGINT AS output_bytes, count(*) FILTER (success)::BIGINT AS succeeded, round(count(*) FILTER (success) / count(*), 6) AS success_rate"
_COLUMNS = ("workspace_id", "session_id", "tool_name", "duration_ms", "source_bytes", "output_bytes", "success")


@query(f"SELECT tool_name, {_SUMMARY} FROM tc GROUP BY tool_name")
def d20_tool_summary(spark, d):
    return telemetry.summary(T.tool_calls(spark, d, *_COLUMNS), ["tool_name"])


@query("WITH n AS (SELECT max(called_at) - INTERVAL 90 DAY AS since FROM tool_calls) SELECT count(*)::BIGINT AS calls, count(DISTINCT session_id)::BIGINT AS sessions, coalesce(sum(source_bytes), 0)::BIGINT AS source_bytes, coalesce(sum(output_bytes), 0)::BIGINT AS output_bytes FROM tc, n WHERE called_at >= since")
def d21_history(spark, d):
    return telemetry.history(T.tool_calls(spark, d, *_COLUMNS), 90)


@query(f"SELECT workspace_id, tool_name, {_SUMMARY} FROM tc GROUP BY ALL")
def d22_d33_d34_workspace_tools(spark, d):
    return telemetry.summary(T.tool_calls(spark, d, *_COLUMNS), ["workspace_id", "tool_name"])


@query("SELECT tool_name, count(*)::BIGINT AS n, list_sort(list(duration_ms))[least(floor(count(*) * 0.95), count(*) - 1)::INT + 1] AS p95, list_sort(list(duration_ms))[least(floor(count(*) * 0.5), count(*) - 1)::INT + 1] AS median FROM tc WHERE duration_ms IS NOT NULL AND tool_name IS NOT NULL GROUP BY 1")
def d23_k12_tool_p95(spark, d):
    calls = T.tool_calls(spark, d, "tool_name", "duration_ms").filter("tool_name is not null")
    return catalog.nth_element(calls, ["tool_name"], "duration_ms", {"p95": 0.95, "median": 0.5})


_EPISODES = """WITH r AS (SELECT id, session_id, workspace_id, called_at, coalesce(tool_name, '') AS tool, coalesce(tool_name, '') IN ('find_text','rank_hits') AS search, result_count FROM tc WHERE session_id IS NOT NULL AND called_at IS NOT NULL),
 l AS (SELECT *, lag(search) OVER w AS b, epoch_us(called_at) - lag(epoch_us(called_at)) OVER w AS wait, workspace_id IS DISTINCT FROM lag(workspace_id) OVER w AS moved FROM r WINDOW w AS (PARTITION BY session_id ORDER BY called_at, id)),
 st AS (SELECT *, CASE WHEN search AND (coalesce(NOT b, true) OR wait > 10000000 OR moved) THEN 1 ELSE 0 END AS starts, (NOT search AND coalesce(b, false)) AS closes FROM l),
 ep AS (SELECT *, sum(starts) OVER (PARTITION BY session_id ORDER BY called_at, id ROWS UNBOUNDED PRECEDING) AS episode FROM st),
 g AS (SELECT session_id, episode::BIGINT AS episode, max(workspace_id) FILTER (search) AS workspace_id, min(called_at) FILTER (search) AS started, count(*) FILTER (search)::BIGINT AS searches, count(*) FILTER (search AND coalesce(result_count, 0) = 0)::BIGINT AS zero_hits, max(tool) FILTER (closes AND tool IN ('open_symbol','read_region','show_outline','edit_lines','rename_name')) AS outcome_tool FROM ep WHERE episode > 0 GROUP BY 1, 2)"""


def _episodes(spark, d):
    return telemetry.episodes(T.tool_calls(spark, d, "session_id", "workspace_id", "tool_name", "result_count"))


@query(f"{_EPISODES} SELECT session_id, episode, workspace_id, strftime(started, '%Y-%m-%d %H:%M:%S.%f') AS started, searches, zero_hits, outcome_tool FROM g")
def i10_k09_search_episodes(spark, d):
    return _episodes(spark, d).withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(f"{_EPISODES} SELECT session_id, episode, array_to_string(list_filter([CASE WHEN zero_hits > 0 THEN 'zero_hits' END, CASE WHEN searches > 1 THEN 'repeat_query' END, CASE WHEN outcome_tool IS NULL THEN 'no_follow_up' END], lambda x: x IS NOT NULL), ',') AS flags FROM g")
def i11_episode_flags(spark, d):
    return telemetry.flags(_episodes(spark, d)).select("session_id", "episode", F.array_join("flags", ",").alias("flags"))


@query(f"{_EPISODES} SELECT CASE WHEN outcome_tool IS NULL THEN 'stalled' WHEN searches = 1 THEN 'one_shot_success' ELSE 'reformulation_converged' END AS outcome, count(*)::BIGINT AS episodes, sum(searches)::BIGINT AS searches, round(avg((zero_hits > 0)::INT), 6) AS zero_hit_rate FROM g GROUP BY 1")
def d28_d29_episode_stats(spark, d):
    return telemetry.episode_stats(_episodes(spark, d))


# events as file events: user as path, type as kind of change
_KINDS = {"signup": "C", "purchase": "M", "view": "M", "error": "D", "click": "R"}


def _events(spark, d):
    kind = F.lit("M")
    for k, v in _KINDS.items():
        kind = F.when(F.col("event_type") == k, F.lit(v)).otherwise(kind)
    return table(spark, d, "events").select(F.col("user_id").alias("path"), "event_id", "ts", kind.alias("change"))


_EV = "SELECT user_id AS path, event_id, ts, CASE event_type WHEN 'signup' THEN 'C' WHEN 'error' THEN 'D' WHEN 'click' THEN 'R' ELSE 'M' END AS change FROM events"


@query(f"""WITH RECURSIVE ev AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY path) AS n FROM ({_EV})),
 fold AS (SELECT path, rn, n, change FROM ev WHERE rn = 1 UNION ALL
  SELECT ev.path, ev.rn, ev.n, CASE WHEN fold.change = 'C' AND ev.change = 'M' THEN 'C' WHEN fold.change = 'D' AND ev.change IN ('C','M') THEN 'M' WHEN fold.change = 'C' AND ev.change = 'D' THEN 'D' WHEN fold.change = 'R' AND ev.change = 'M' THEN 'R' ELSE ev.change END FROM fold JOIN ev ON ev.path = fold.path AND ev.rn = fold.rn + 1)
 SELECT path, change, n::BIGINT AS events FROM fold WHERE rn = n""")
def i02_merge_events(spark, d):
    return changes.merge_events(_events(spark, d), "path", ["ts", "event_id"], "change")


@query(f"SELECT event_id, path FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY path ORDER BY ts, event_id) AS wait FROM ({_EV})) WHERE wait IS NULL OR wait > 3600000000")
def i04_debounce(spark, d):
    return changes.debounce(_events(spark, d), "path", "ts", 3600, ["event_id"]).select("event_id", "path")


@query(f"SELECT event_id, CASE WHEN change = 'R' THEN u.p ELSE path::VARCHAR END AS path, CASE WHEN change = 'R' THEN u.c ELSE change END AS change FROM (SELECT *, unnest(CASE WHEN change = 'R' THEN [{{'p': path::VARCHAR, 'c': 'D'}}, {{'p': path::VARCHAR || '.new', 'c': 'C'}}] ELSE [{{'p': path::VARCHAR, 'c': change}}] END) AS u FROM ({_EV}))")
def i09_renames(spark, d):
    e = _events(spark, d).select("event_id", F.col("path").cast("string").alias("old"), F.when(F.col("change") == "R", F.concat(F.col("path").cast("string"), F.lit(".new"))).alias("new"), "change")
    return changes.expand_renames(e, "change", "old", "new").select("event_id", "path", "change")


@query("WITH c AS (SELECT DISTINCT revision, workspace_id, file_path, change_kind FROM revision_file_changes) SELECT revision, workspace_id, count(*) FILTER (change_kind = 'added')::BIGINT AS added, count(*) FILTER (change_kind = 'modified')::BIGINT AS modified, count(*) FILTER (change_kind = 'deleted')::BIGINT AS deleted FROM c GROUP BY 1, 2")
def i13_i14_revision_log(spark, d):
    return changes.revision_log(table(spark, d, "revision_file_changes"))


@query("SELECT user_id AS path, count(*)::BIGINT AS queued, count(*) > 20 AS rescan FROM events GROUP BY 1")
def i03_i06_overflow(spark, d):
    return changes.needs_rescan(_events(spark, d), "path", 20)


@query("""WITH r AS (SELECT max(revision) AS r FROM file_snapshots), old AS (SELECT file_path, nullif(arg_max(coalesce(size, -1), last_indexed), -1) AS size FROM file_snapshots WHERE revision = (SELECT min(revision) FROM file_snapshots) GROUP BY 1),
 new AS (SELECT file_path, nullif(arg_max(coalesce(size, -1), last_indexed), -1) AS size FROM file_snapshots, r WHERE revision = r GROUP BY 1)
 SELECT coalesce(n.file_path, o.file_path) AS file_path, CASE WHEN n.file_path IS NOT NULL THEN n.size ELSE o.size END AS size FROM old o FULL JOIN new n ON o.file_path = n.file_path""")
def a09_k18_upsert(spark, d):
    from codeloom.sources.tables import current_rows

    snap = table(spark, d, "file_snapshots")
    ends = snap.agg(F.min("revision").alias("lo"), F.max("revision").alias("hi"))
    both = snap.crossJoin(F.broadcast(ends))
    old = current_rows(both.filter("revision = lo"), "file_path", ["size"]).select("file_path", "size")
    new = current_rows(both.filter("revision = hi"), "file_path", ["size"]).select("file_path", "size")
    return V.upsert(old, new, "file_path")


@query("SELECT i.id, i.name, s.id AS containing_symbol_id FROM i LEFT JOIN s ON i.containing_symbol_id = s.id")
def a15_a17_identifier_sink(spark, d):
    """Uses with unknown containers set to null, as the sink stores them."""
    ids = T.symbols(spark, d).select(F.col("id").alias("sid"))
    u = T.identifiers(spark, d, "name", "containing_symbol_id")
    return u.join(ids, F.col("containing_symbol_id") == F.col("sid"), "left").select("id", "name", F.col("sid").alias("containing_symbol_id"))


@query("SELECT id, identifier_id, coalesce(ordinal, -1)::INT AS ordinal, type_name, sha256(coalesce(identifier_id, '') || '/' || coalesce(parent_arg_id, '') || '/' || coalesce(ordinal, -1)::VARCHAR) AS row_key FROM ta")
def a19_type_argument_keys(spark, d):
    t = T.type_arguments(spark, d, "identifier_id", "parent_arg_id", "ordinal", "type_name")
    key = F.sha2(F.concat_ws("/", F.coalesce("identifier_id", F.lit("")), F.coalesce("parent_arg_id", F.lit("")), F.coalesce("ordinal", F.lit(-1)).cast("string")), 256)
    return t.select("id", "identifier_id", F.coalesce("ordinal", F.lit(-1)).alias("ordinal"), "type_name", key.alias("row_key"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)")
def a23_orphan_vectors(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id")
    return V.purge(table(spark, d, "embeddings"), docs, "vec_id").select("vec_id", "label")


@query("SELECT 'symbol' AS doc_type, id AS key, name, length(coalesce(code_context, ''))::INT AS body FROM s UNION ALL SELECT 'file', path, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', ''), length(coalesce(content, ''))::INT FROM f".replace("\\\\", "\\"))
def a24_a26_k02_search_documents(spark, d):
    from codeloom.functions.paths import basename

    s = T.symbols(spark, d, "name", "code_context").select(F.lit("symbol").alias("doc_type"), F.col("id").alias("key"), "name", F.length(F.coalesce("code_context", F.lit(""))).alias("body"))
    f = T.files(spark, d, "content").select(F.lit("file").alias("doc_type"), F.col("path").alias("key"), F.regexp_replace(basename(F.col("path")), r"\.[^.]*$", "").alias("name"), F.length(F.coalesce("content", F.lit(""))).alias("body"))
    return s.unionByName(f)


@query("SELECT path, language, length(content)::INT AS chars FROM f WHERE workspace_id IN (SELECT workspace_id FROM workspaces WHERE status = 'ready')")
def a30_a31_contents(spark, d):
    ready = table(spark, d, "workspaces").filter("status = 'ready'").select("workspace_id")
    return T.files(spark, d, "workspace_id", "language", "content").join(ready, "workspace_id", "left_semi").select("path", "language", F.length("content").alias("chars"))


@query("SELECT id, tool_name FROM tc WHERE called_at >= (SELECT max(called_at) FROM tool_calls) - INTERVAL 365 DAY")
def a33_retention(spark, d):
    newest = table(spark, d, "tool_calls").agg((F.max("called_at") - F.expr("interval 365 days")).alias("since"))
    return T.tool_calls(spark, d, "tool_name").crossJoin(F.broadcast(newest)).filter("called_at >= since").select("id", "tool_name")


@query("SELECT i.name FROM i WHERE i.name IS NOT NULL EXCEPT SELECT name FROM s")
def k03_k04_set_difference(spark, d):
    names = T.symbols(spark, d, "name").select("name").distinct()
    return T.identifiers(spark, d, "name").filter("name is not null").select("name").distinct().join(names, "name", "left_anti")


@query("WITH b AS (SELECT language, count(*) FILTER (kind IN ('function','method','class','struct')) AS base FROM s GROUP BY 1), v AS (SELECT s.id, s.language, row_number() OVER (PARTITION BY s.language ORDER BY coalesce(reference_score, 0) + CASE WHEN contains(name, '_') OR length(name) >= 12 THEN 0.15 ELSE 0 END DESC, s.id) AS rn FROM s WHERE kind IN ('variable','field','property')) SELECT v.id, v.language, v.rn::INT AS place FROM v JOIN b ON v.language = b.language WHERE rn <= floor(base * 0.2)")
def j21_variable_budget(spark, d):
    from pyspark.sql import Window

    s = T.symbols(spark, d, "name", "kind", "language", "reference_score")
    base = s.filter(F.col("kind").isin("function", "method", "class", "struct")).groupBy("language").agg(F.floor(F.count(F.lit(1)) * 0.2).alias("cap"))
    score = F.coalesce("reference_score", F.lit(0.0)) + F.when(F.col("name").contains("_") | (F.length("name") >= 12), 0.15).otherwise(0.0)
    v = s.filter(F.col("kind").isin("variable", "field", "property")).withColumn("place", F.row_number().over(Window.partitionBy("language").orderBy(F.desc(score), "id")))
    return v.join(F.broadcast(base), "language").filter("place <= cap").select("id", "language", "place")


QUERIES, ORACLES = query.QUERIES, query.ORACLES
