"""Change events: merging, debouncing, applying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (pending, incoming) -> merged; other pairs take the incoming event.
MERGE = {("C", "M"): "C", ("D", "C"): "M", ("D", "M"): "M", ("C", "D"): "D", ("R", "M"): "R", ("M", "M"): "M"}


def merge_step(pending: Column, incoming: Column) -> Column:
    """One step of the fold."""
    out = incoming
    for (a, b), c in MERGE.items():
        out = F.when((pending == a) & (incoming == b), F.lit(c)).otherwise(out)
    return F.when(pending.isNull(), incoming).otherwise(out)


STATES = (None, "C", "M", "D", "R")


def merge_events(events: DataFrame, key: str, order: list[str], kind: str, span: Column | None = None) -> DataFrame:
    """I02 in batch: per key the merged kind of its events in order, and how many there were. Kinds are C, M, D and R.

    What a run of events does to a pending kind is a table of five entries, and such tables can be composed, so a key's events are folded by ``span`` (by default
    the hour of the first order column, or its value by thousands) first and only one table per span meets the others of its key: a key with a third of all events is no one task's list.
    """
    if span is None:
        span = F.date_trunc("hour", order[0]) if dict(events.dtypes)[order[0]].startswith("timestamp") else F.floor(F.col(order[0]) / 1000)
    seq = F.array_sort(F.collect_list(F.struct(*[F.col(o) for o in order], F.col(kind).alias("k"))))
    table = F.array(*[F.aggregate("__seq", F.lit(s).cast("string"), lambda a, x: merge_step(a, x["k"])) for s in STATES])
    part = events.groupBy(key, span.alias("__span")).agg(seq.alias("__seq"), F.count(F.lit(1)).alias("__n")).select(key, "__span", "__n", table.alias("__table"))
    spans = F.array_sort(F.collect_list(F.struct("__span", "__table")))
    place = F.create_map(*[F.lit(x) for i, s in enumerate(STATES[1:], 2) for x in (s, i)])
    folded = F.aggregate(spans, F.lit(None).cast("string"), lambda a, x: F.element_at(x["__table"], F.coalesce(place[a], F.lit(1))))
    return part.groupBy(key).agg(folded.alias("change"), F.sum("__n").alias("events"))


def debounce(events: DataFrame, key: str, ts: str, seconds: float, order: list[str]) -> DataFrame:
    """I04 in batch: events that come more than ``seconds`` after the key's event before; the first of each burst stays."""
    w = Window.partitionBy(key).orderBy(ts, *order)
    wait = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    return events.withColumn("__wait", wait).filter(F.col("__wait").isNull() | (F.col("__wait") > int(seconds * 1_000_000))).drop("__wait")


def expand_renames(events: DataFrame, kind: str, source: str, target: str) -> DataFrame:
    """A rename is a deletion of the old path and a creation of the new one."""
    both = F.array(F.struct(F.col(source).alias("path"), F.lit("D").alias("change")), F.struct(F.col(target).alias("path"), F.lit("C").alias("change")))
    one = F.array(F.struct(F.coalesce(F.col(target), F.col(source)).alias("path"), F.col(kind).alias("change")))
    rest = [c for c in events.columns if c not in (kind, source, target)]
    return events.select(*rest, F.inline(F.when(F.col(kind) == "R", both).otherwise(one)))


def apply_changes(current: DataFrame, changed: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of changed and deleted keys go, the changed ones' new rows come."""
    gone = changed.select(key).unionByName(deleted.select(key)).distinct()
    return current.join(gone, key, "left_anti").unionByName(changed)


def revision_log(changes: DataFrame) -> DataFrame:
    """Per revision and workspace the number of changes by kind, repeated rows once."""
    rows = changes.select("revision", "workspace_id", "file_path", "change_kind").distinct()
    return rows.groupBy("revision", "workspace_id").agg(*[F.count_if(F.col("change_kind") == k).alias(k) for k in ("added", "modified", "deleted")])


def needs_rescan(events: DataFrame, key: str, limit: int = 1000) -> DataFrame:
    """Keys whose queue overflows, so that a full comparison must repair them."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("queued")).withColumn("rescan", F.col("queued") > limit)


def shed(events: DataFrame, key: str, order: list[str], limit: int = 1000, keep: int = 750) -> DataFrame:
    """The events that stay queued, with ``rescan``: of a key with more than ``limit`` events the newest ``keep``, all of others.

    The rank filter cuts each task's rows before they meet.
    """
    n = needs_rescan(events, key, limit).select(F.col(key).alias("__k"), "rescan")
    marked = events.join(n, F.col(key) == F.col("__k")).drop("__k")
    w = Window.partitionBy(key).orderBy(*[F.desc(o) for o in order])
    over = marked.filter("rescan").withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= keep).drop("__r")
    return marked.filter("not rescan").unionByName(over)


def repair(now: DataFrame, stored: DataFrame, flagged: DataFrame, group: str, key: str = "path", value: str = "hash") -> DataFrame:
    """What a full comparison of the flagged groups' (workspaces') listings with the stored rows must change: (group, key, action).

    Actions are index (new or other content) and delete.
    """
    wanted = flagged.select(group).distinct()
    a = now.join(wanted, group, "left_semi").select(F.col(group).alias("ga"), F.col(key).alias("a"), F.col(value).alias("av"))
    b = stored.join(wanted, group, "left_semi").select(F.col(group).alias("gb"), F.col(key).alias("b"), F.col(value).alias("bv"))
    j = a.join(b, (F.col("ga") == F.col("gb")) & (F.col("a") == F.col("b")), "full_outer").filter(F.col("a").isNull() | F.col("b").isNull() | ~F.col("av").eqNullSafe(F.col("bv")))
    return j.select(F.coalesce("ga", "gb").alias(group), F.coalesce("a", "b").alias(key), F.when(F.col("a").isNull(), "delete").otherwise("index").alias("action"))


def due_repairs(repairs: DataFrame, now: int, min_age: int = 30, attempts: int = 10) -> DataFrame:
    """Repairs (updated_at in unix seconds, attempts) that are old enough and were not tried too often."""
    return repairs.filter((F.lit(now) - F.col("updated_at") >= min_age) & (F.coalesce("attempts", F.lit(0)) < attempts))


def in_batches(df: DataFrame, embed, schema: str, size: int = 250) -> DataFrame:
    """I16: a function from a pandas frame of at most ``size`` rows to one of ``schema``, over all rows."""

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), size):
                yield embed(pdf.iloc[at:at + size])

    return df.mapInPandas(run, schema)
