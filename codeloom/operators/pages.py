"""Results that are too long for one answer: kept under a handle and read page by page."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.cut import Workspace

#: Results kept at most (the oldest goes) and seconds that one is kept.
ENTRIES, TTL = 256, 3600


class Spillover:
    """Written results by handle; a handle is read by its owner alone, until it expires or makes room for newer ones."""

    def __init__(self, spark: SparkSession, entries: int = ENTRIES, ttl: float = TTL):
        self.spark, self.entries, self.ttl = spark, entries, ttl
        self._ws = Workspace(spark, "spillover")
        self._held: dict[str, dict] = {}

    def put(self, df: DataFrame, owner: str, order: list, title: str = "", now: float | None = None) -> str:
        """Writes the rows in their order and gives their handle.

        Rows are sorted by range over many tasks; a row's number is that of its partition's first row, of which the driver keeps one number per partition, and its place behind it.
        """
        now = time.time() if now is None else now
        rows = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
        table = self._ws.cut(rows, "rows")
        counts = sorted((r[0], r[1]) for r in table.groupBy(F.shiftright("__id", 33).alias("p")).count().collect())
        first, at = {}, 0
        for p, n in counts:
            first[p], at = at, at + n
        handle = hashlib.sha256(json.dumps([owner, title, now, len(self._held)]).encode()).hexdigest()[:24]
        while len(self._held) >= self.entries:
            self._forget(min(self._held, key=lambda h: self._held[h]["at"]))
        self._held[handle] = {"owner": owner, "title": title, "at": now, "table": table, "first": first, "rows": at}
        return handle

    def _forget(self, handle: str) -> None:
        self._ws.drop(self._held.pop(handle)["table"])

    def get(self, handle: str, owner: str, offset: int = 0, limit: int = 50, now: float | None = None) -> DataFrame:
        """Rows [offset, offset + limit) of a result with their ``row`` from 0. KeyError for an unknown or expired handle or another owner's."""
        now = time.time() if now is None else now
        for h in [h for h, x in self._held.items() if now - x["at"] > self.ttl]:
            self._forget(h)
        held = self._held.get(handle)
        if held is None or held["owner"] != owner:
            raise KeyError(handle)
        # only the partitions that hold the page are read
        wanted = {p: a for p, a in held["first"].items() if a < offset + limit and a + self._size(held, p) > offset}
        low, high = (min(wanted) << 33, (max(wanted) + 1) << 33) if wanted else (0, 0)
        base = F.lit(0)
        for p, a in wanted.items():
            base = F.when(F.shiftright("__id", 33) == p, F.lit(a)).otherwise(base)
        rows = held["table"].filter((F.col("__id") >= low) & (F.col("__id") < high)).withColumn("row", (base + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long"))
        return rows.filter((F.col("row") >= offset) & (F.col("row") < offset + limit)).drop("__id")

    def _size(self, held: dict, p: int) -> int:
        later = [a for a in held["first"].values() if a > held["first"][p]]
        return (min(later) if later else held["rows"]) - held["first"][p]
