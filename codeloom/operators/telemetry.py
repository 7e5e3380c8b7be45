"""Tool call summaries and search episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEARCH_TOOLS = ("find_text", "rank_hits")
USEFUL_TOOLS = ("open_symbol", "read_region", "show_outline", "edit_lines", "rename_name")
GAP_SECONDS = 10


def summary(calls: DataFrame, by: list[str]) -> DataFrame:
    """Calls, average duration, bytes and success per group; sums and counts combine partially, so summaries merge."""
    out = calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.round(F.try_divide(F.sum(F.col("duration_ms").cast("decimal(24,6)")).cast("double"), F.count("duration_ms")), 9).alias("avg_ms"),
        F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("source_bytes"),
        F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("output_bytes"),
        F.count_if(F.col("success")).alias("succeeded"),
    )
    return out.withColumn("success_rate", F.round(F.col("succeeded") / F.col("calls"), 6))


def history(calls: DataFrame, days: int) -> DataFrame:
    """Totals of the last days before the newest call."""
    newest = calls.agg((F.max("called_at") - F.expr(f"interval {days} days")).alias("since"))
    rows = calls.crossJoin(F.broadcast(newest)).filter(F.col("called_at") >= F.col("since"))
    return rows.agg(F.count(F.lit(1)).alias("calls"), F.count_distinct("session_id").alias("sessions"), F.coalesce(F.sum("source_bytes"), F.lit(0)).alias("source_bytes"), F.coalesce(F.sum("output_bytes"), F.lit(0)).alias("output_bytes"))


def episodes(calls: DataFrame, gap: int = GAP_SECONDS) -> DataFrame:
    """Search episodes: one row per episode of a session.

    A search starts an episode if the session's call before is no search of the same workspace, or came more than ``gap`` seconds earlier; other tools
    close it. A closing tool of the useful set is the episode's outcome. Sessions are bounded by their users' pace, so a window per session is.

    Columns session_id, workspace_id, episode, started, searches, zero_hits, outcome_tool. Calls without session or time are left out.
    """
    w = Window.partitionBy("session_id").orderBy("called_at", "id")
    rows = calls.filter(F.col("session_id").isNotNull() & F.col("called_at").isNotNull()).select("id", "session_id", "workspace_id", "called_at", F.coalesce("tool_name", F.lit("")).alias("tool"), "result_count")
    rows = rows.withColumn("search", F.col("tool").isin(*SEARCH_TOOLS))
    before = F.lag("search").over(w)
    # whole microseconds, so that the border is exact
    wait = F.unix_micros(F.col("called_at").cast("timestamp")) - F.unix_micros(F.lag("called_at").over(w).cast("timestamp"))
    fresh = F.coalesce(~before, F.lit(True)) | (wait > gap * 1_000_000) | ~F.col("workspace_id").eqNullSafe(F.lag("workspace_id").over(w))
    rows = rows.withColumn("starts", (F.col("search") & fresh).cast("int")).withColumn("closes", ~F.col("search") & F.coalesce(before, F.lit(False)))
    rows = rows.withColumn("episode", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    useful = F.col("closes") & F.col("tool").isin(*USEFUL_TOOLS)
    return rows.filter(F.col("episode") > 0).groupBy("session_id", "episode").agg(
        F.max(F.when(F.col("search"), F.col("workspace_id"))).alias("workspace_id"),
        F.min(F.when(F.col("search"), F.col("called_at"))).alias("started"),
        F.count_if(F.col("search")).alias("searches"),
        F.count_if(F.col("search") & (F.coalesce("result_count", F.lit(0)) == 0)).alias("zero_hits"),
        F.max(F.when(useful, F.col("tool"))).alias("outcome_tool"),
    )


def flags(eps: DataFrame) -> DataFrame:
    """What is notable about each episode."""
    return eps.withColumn("flags", F.array_compact(F.array(F.when(F.col("zero_hits") > 0, F.lit("zero_hits")), F.when(F.col("searches") > 1, F.lit("repeat_query")), F.when(F.col("outcome_tool").isNull(), F.lit("no_follow_up")))))


def outcome(searches, follow):
    return F.when(follow.isNull(), "stalled").when(searches == 1, "one_shot_success").otherwise("reformulation_converged")


def episode_stats(eps: DataFrame) -> DataFrame:
    """D28, D29."""
    e = eps.withColumn("outcome", outcome(F.col("searches"), F.col("outcome_tool")))
    return e.groupBy("outcome").agg(F.count(F.lit(1)).alias("episodes"), F.sum("searches").alias("searches"), F.round(F.avg((F.col("zero_hits") > 0).cast("int")), 6).alias("zero_hit_rate"))
