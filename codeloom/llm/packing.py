"""Filling containers of one capacity with items of many lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.cut import Workspace
from codeloom.plans.split import split_prefix

CAPACITY = 2048
#: Context-size tiers as shares of the capacity, powers of two; an item goes to the smallest tier's window that holds it.
TIERS = (8, 4, 2, 1)
#: A window of a shorter tier is closed if at most 1 / SLACK of it stays unused; otherwise its item moves up to the next longer window.
SLACK = 64
#: Containers of one training step, whose groups are balanced.
STEP = 64


def tier_of(size: int, capacity: int) -> int:
    """The tier's window: the smallest share of the capacity that holds ``size``."""
    for share in TIERS:
        if size <= capacity // share:
            return capacity // share
    return capacity


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, list[int]]]:
    """Windows by pattern: (how many, their share of the capacity, their item sizes, the first being the one that opens them).

    Works on the histogram of sizes alone, which has at most ``capacity`` entries whatever the corpus.
    Tiers are packed from the longest to the shortest. A tier's items open windows of its own length, largest first, and what they leave open is
    filled from the same tier and then from shorter ones, always by the largest size that fits. Where a window of a shorter
    tier can't be filled well any more (see :data:`SLACK`), as its gap asks for sizes that are used up, its item is routed to the next longer
    window instead, in the end to one of the whole capacity. One pattern is used as often as its sizes last, so each step exhausts a size or at
    least halves what is left of it: there are at most about capacity * log2(capacity) patterns.
    """
    left = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        left[s] = n
    # below[s]: the largest size <= s that is left, by path halving
    below = np.arange(capacity + 1).tolist()

    def largest(s: int) -> int:
        while s and left[s] <= 0:
            below[s] = below[below[s]] if below[s] != s else s - 1
            s = below[s]
        return s

    def fill(first: int, window: int) -> tuple[list[int], dict[int, int], int]:
        pattern, used, gap = [first], {first: 1}, window - first
        s = largest(gap)
        while s:
            take = min(int(left[s]) - used.get(s, 0), gap // s)
            if take > 0:
                pattern += [s] * take
                used[s] = used.get(s, 0) + take
                gap -= s * take
            s = largest(min(gap, s - 1))
        return pattern, used, gap

    out: list[tuple[int, int, list[int]]] = []
    shortest_first = sorted(TIERS, reverse=True)
    bounds = [0, *[capacity // s for s in shortest_first]]
    for i in range(len(shortest_first) - 1, -1, -1):
        while (first := largest(bounds[i + 1])) > bounds[i]:
            for share in shortest_first[i:]:
                window = capacity // share
                pattern, used, gap = fill(first, window)
                if gap * SLACK <= window or share == 1:
                    break
            times = min(int(left[s]) // n for s, n in used.items())
            for s, n in used.items():
                left[s] -= times * n
            out.append((times, share, pattern))
    return out


class Slots:
    """Where the r-th item of each size goes, by binary search over the patterns that hold the size.

    The windows of a tier fill containers of their own, side by side; what is left of the tiers' last ones shares the last few containers.
    Within a tier windows are ordered by what attention costs them, so that dealing the containers to the tier's step groups in
    snake order gives each group its share of costly and of cheap ones, all of one context size.
    """

    def __init__(self, patterns: list[tuple[int, int, list[int]]], capacity: int, step: int):
        by_size: dict[int, list[tuple]] = {}
        self.blocks: list[tuple[int, int, int, int]] = []  # first container, containers, first group, groups
        self.first: dict[int, int] = {}  # by share: the first container
        self.full: dict[int, int] = {}  # by share: windows in whole containers
        rests: list[tuple[int, int]] = []
        containers = groups = 0

        def block(n: int) -> None:
            nonlocal containers, groups
            if n:
                of = -(-n // step)
                self.blocks.append((containers, n, groups, of))
                containers, groups = containers + n, groups + of

        for share in sorted(TIERS):
            mine = sorted((p for p in patterns if p[1] == share), key=lambda p: (-sum(x * x for x in p[2]), p[2]))
            start = 0
            for times, _, pattern in mine:
                at, i = 0, 0
                while i < len(pattern):
                    s, per = pattern[i], 1
                    while i + per < len(pattern) and pattern[i + per] == s:
                        per += 1
                    by_size.setdefault(s, []).append((times * per, start, per, at, share, sum(pattern)))
                    at += s * per
                    i += per
                start += times
            self.first[share], self.full[share] = containers, start // share * share
            rests += [(share, w) for w in range(self.full[share], start)]
            block(start // share)
        # the rests, longest windows first: each is a power of two of the shortest, so they leave no gaps between them
        self.rest: dict[tuple[int, int], tuple[int, int]] = {}
        began, at = containers, 0
        for share, w in rests:
            self.rest[share, w] = (began + at // capacity, at % capacity) if capacity % max(TIERS) == 0 else (began + len(self.rest), 0)
            at += capacity // share
        block(1 + max((c for c, _ in self.rest.values()), default=began - 1) - began)
        self.capacity, self.containers, self.groups = capacity, containers, groups
        self.by_size = {s: (np.concatenate([[0], np.cumsum([x[0] for x in rows])]), np.array([x[1:] for x in rows], np.int64)) for s, rows in by_size.items()}

    def place(self, size: np.ndarray, rank: np.ndarray) -> pd.DataFrame:
        n = len(size)
        container, offset, tier, index, full, group = (np.full(n, -1, np.int64) for _ in range(6))
        for s in np.unique(size):
            if s not in self.by_size:
                continue
            at = np.flatnonzero(size == s)
            ends, rows = self.by_size[s]
            which = np.searchsorted(ends, rank[at], side="right") - 1
            inside = rank[at] - ends[which]
            start, per, base, share, tokens = rows[which].T
            window = start + inside // per
            within = base + inside % per * s
            tier[at], index[at], full[at] = self.capacity // share, window, tokens
            for c in np.unique(share):
                mine = share == c
                container[at[mine]] = self.first[int(c)] + window[mine] // c
                offset[at[mine]] = window[mine] % c * (self.capacity // c) + within[mine]
                for j in np.flatnonzero(mine & (window >= self.full[int(c)])):
                    container[at[j]], before = self.rest[int(c), int(window[j])]
                    offset[at[j]] = before + within[j]
        for begin, many, first, of in self.blocks:
            mine = (container >= begin) & (container < begin + many)
            turn, seat = np.divmod(container[mine] - begin, of)
            group[mine] = first + np.where(turn % 2 == 0, seat, of - 1 - seat)
        return pd.DataFrame({"container_id": container, "at": offset, "tier": tier, "window": index, "window_tokens": full, "step_group": group})


def pieces(df: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Items no longer than the capacity: only longer ones are split, into full pieces and a rest."""
    rows = df.select(key, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__n"))
    rows = rows.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("__n") / F.lit(capacity))).cast("int"))
    rows = rows.select(key, "__n", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return rows.select(key, "part", "parts", (F.col("part").cast("long") * capacity).alias("start"), F.least(F.lit(capacity), F.col("__n") - F.col("part").cast("long") * capacity).cast("int").alias("length"))


def pack(df: DataFrame, key: str = "doc_id", size: str = "tokens", capacity: int = CAPACITY, step: int = STEP) -> DataFrame:
    """One row per piece of an item with its container.

    Columns key, part, parts, start (of the piece in its item), length, container_id, at (the place in the container),
    tier (the length of its window), window (counted within the tier), window_tokens, step_group (of containers of one tier).

    Items up to the capacity stay whole; longer ones give pieces of the capacity and a rest, which is packed like any item. Items of
    length 0 or null need no room: they are listed with null container. Negative lengths count as 0.
    Repeated rows are items of their own; an empty table gives no rows. Only the histogram of lengths (at
    most ``capacity`` entries) comes to the driver, only the patterns made of it go out.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "packing")
    items = pieces(ws.cut(df.select(key, F.greatest(F.lit(0), F.coalesce(F.col(size), F.lit(0))).cast("long").alias(size)), "items"), key, size, capacity)
    counts = {r[0]: r[1] for r in items.filter("length > 0").groupBy("length").count().collect()}
    slots = spark.sparkContext.broadcast(Slots(plan(counts, capacity), capacity, step))
    ranked = split_prefix(items, ["length"], [key, "part"], F.lit(1).cast("long"), "rank")
    columns = ["container_id", "at", "tier", "window", "window_tokens", "step_group"]
    kind = dict(items.dtypes)[key]

    def run(batches):
        for pdf in batches:
            got = slots.value.place(pdf["length"].to_numpy(), pdf["rank"].to_numpy())
            for c in got:
                pdf[c] = got[c].where(got["container_id"] >= 0).astype("Int64")
            yield pdf[[key, "part", "parts", "start", "length", *columns]]

    return ranked.select(key, "part", "parts", "start", "length", "rank").mapInPandas(run, f"`{key}` {kind}, part int, parts int, start long, length int, " + ", ".join(f"{c} long" for c in columns))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per tier: windows, items, tokens, unused tokens and their share."""
    per = packed.filter("container_id is not null").groupBy("tier", "window").agg(F.count(F.lit(1)).alias("items"), F.sum("length").alias("tokens"))
    out = per.groupBy("tier").agg(F.count(F.lit(1)).alias("windows"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    return out.withColumn("unused", F.col("windows") * F.col("tier") - F.col("tokens")).withColumn("unused_share", F.round(F.col("unused") / (F.col("windows") * F.col("tier")), 6))


def step_report(packed: DataFrame) -> DataFrame:
    """Per step group: containers, tokens and the sum of squared lengths, which attention costs."""
    return packed.filter("container_id is not null").groupBy("step_group").agg(F.count_distinct("container_id").alias("containers"), F.sum("length").alias("tokens"), F.sum(F.col("length").cast("long") * F.col("length")).alias("squares"), F.min("tier").alias("shortest_tier"), F.max("tier").alias("longest_tier"))


def check(packed: DataFrame, capacity: int) -> DataFrame:
    """One row on a whole packing: pieces, tokens, overlaps (of pieces in a container), beyond (pieces past its end), needless (pieces of items that
    needed no split or more of them than needed), ids_dense, fills_well (containers within 1 % and the tiers' last ones of the least possible)."""
    w = Window.partitionBy("container_id").orderBy("at")
    placed = packed.filter("container_id is not null").select("container_id", "at", "length", F.lead("at").over(w).alias("next"))
    per = placed.agg(
        F.count_if(F.col("next") < F.col("at") + F.col("length")).alias("overlaps"), F.count_if(F.col("at") + F.col("length") > capacity).alias("beyond"),
        F.coalesce(F.count_distinct("container_id") == F.max("container_id") + 1, F.lit(True)).alias("ids_dense"), F.count_distinct("container_id").alias("containers"),
    )
    whole = packed.agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count_if((F.col("parts") > 1) & (F.col("part") < F.col("parts") - 1) & (F.col("length") < capacity)).alias("needless"))
    # a row each
    both = whole.crossJoin(F.broadcast(per))
    return both.select("pieces", "tokens", "overlaps", "beyond", "needless", "ids_dense", (F.col("containers") <= F.ceil(F.col("tokens") / capacity) * 1.01 + len(TIERS)).alias("fills_well"))
