"""Percentiles of very large numeric columns from sketches that can be combined.

The sketch is the relative-error quantile sketch of Cormode, Karnin, Liberty, Thaler and
Vesely (2021) with the upper tail protected: each level's compactor keeps its largest
values and halves a stretch of its smallest, so the error of a rank shrinks with the distance
from the top.
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.plans.cut import Workspace

#: Section size: with it the standard error of a rank r of n is about 0.1306 / K * (n - r).
K = 64
SECTIONS = 3
PERCENTILES = {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99, "p999": 0.999}
#: Groups whose sketches a task holds at once; more are passed on as partial sketches.
HELD_GROUPS = 20_000
CHUNK = 200_000


def rank_error(k: int = K) -> float:
    """The stated bound (four standard errors) of a rank, relative to the number of values above it."""
    return 4 * 0.1306 / k


class Sketch:
    """Relative compactors by level; an item of level h stands for 2**h values."""

    __slots__ = ("k", "n", "low", "high", "levels")

    def __init__(self, k: int = K):
        self.k, self.n, self.low, self.high = k, 0, np.inf, -np.inf
        #: per level: values, number of compactions, sections, section size
        self.levels: list[list] = []

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        self.n += len(values)
        self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
        self._put(0, values)
        self._settle()

    def _put(self, h: int, values: np.ndarray) -> None:
        while len(self.levels) <= h:
            self.levels.append([np.zeros(0), 0, SECTIONS, self.k])
        level = self.levels[h]
        level[0] = np.concatenate([level[0], values])

    def merge(self, other: Sketch) -> None:
        if other.n == 0:
            return
        self.n += other.n
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for h, (values, done, sections, size, *_) in enumerate(other.levels):
            self._put(h, values)
            mine = self.levels[h]
            mine[1] |= done
            if sections > mine[2]:
                mine[2], mine[3] = sections, size
        self._settle()

    def _settle(self) -> None:
        h = 0
        while h < len(self.levels):
            level = self.levels[h]
            values, done, sections, size = level[:4]
            if len(values) >= 2 * sections * size:
                # a schedule like a binary counter: the lowest sections are compacted often, high ones seldom
                take = min(((~done & (done + 1)).bit_length() - 1) + 1, sections)
                keep = sections * size + (sections - take) * size
                cut = (len(values) - keep) & ~1
                values = np.sort(values)
                # a fixed coin: a hash of what the level has been through, flipped each second time
                coin = (((done >> 1) * 0x9E3779B1 ^ (h + 1) * 0x85EBCA6B ^ (self.n << 7)) >> 13) & 1 if done % 2 == 0 else 1 - self._last(h)
                self._remember(h, coin)
                self._put(h + 1, values[coin:cut:2])
                level = self.levels[h]
                level[0], level[1] = values[cut:], done + 1
                if level[1] >= 1 << (sections - 1) and size > 4:
                    level[2], level[3] = sections * 2, max(4, int(round(size / np.sqrt(2) / 2)) * 2)
            h += 1

    def _last(self, h: int) -> int:
        return self.levels[h][4] if len(self.levels[h]) > 4 else h & 1

    def _remember(self, h: int, coin: int) -> None:
        self.levels[h][4:] = [coin]

    def quantiles(self, qs: list[float]) -> list[float]:
        """For each q the smallest kept value of which at least q * n values are not greater (nearest rank)."""
        if self.n == 0:
            return [None] * len(qs)
        values = np.concatenate([x[0] for x in self.levels])
        weights = np.concatenate([np.full(len(x[0]), 1 << h, np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(values, kind="stable")
        values, ranks = values[order], np.cumsum(weights[order])
        at = np.searchsorted(ranks, np.maximum(1, np.ceil(np.asarray(qs) * self.n - 1e-9)))
        out = values[np.minimum(at, len(values) - 1)]
        return [self.low if q <= 0 else self.high if q >= 1 else float(v) for q, v in zip(qs, out)]

    def dump(self) -> bytes:
        head = struct.pack("<iqddi", self.k, self.n, self.low, self.high, len(self.levels))
        parts = [struct.pack("<iqiib", len(x[0]), x[1], x[2], x[3], self._last(h)) for h, x in enumerate(self.levels)]
        return head + b"".join(parts) + b"".join(x[0].astype("<f8").tobytes() for x in self.levels)

    @classmethod
    def load(cls, data: bytes) -> Sketch:
        k, n, low, high, depth = struct.unpack_from("<iqddi", data)
        out = cls(k)
        out.n, out.low, out.high = n, low, high
        at = struct.calcsize("<iqddi")
        heads = []
        for _ in range(depth):
            heads.append(struct.unpack_from("<iqiib", data, at))
            at += struct.calcsize("<iqiib")
        for length, done, sections, size, coin in heads:
            out.levels.append([np.frombuffer(data, "<f8", length, at).copy(), done, sections, size, coin])
            at += 8 * length
        return out


def partial_sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """(keys, sketch): one sketch per group and task, made where the rows are.

    Null and NaN values are left out (groups with nothing else give no sketch); null keys form groups
    of their own; infinite and negative values count as they are ordered.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__value")).filter(F.col("__value").isNotNull() & ~F.isnan("__value"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "__value") + ", sketch binary"

    def run(batches):
        held: dict[tuple, Sketch] = {}
        chunk, n = [], 0

        def take():
            pdf = pd.concat(chunk, ignore_index=True) if len(chunk) > 1 else chunk[0]
            codes = np.zeros(len(pdf), np.int64)
            uniques = []
            for c in keys:
                code, unique = pd.factorize(pdf[c], use_na_sentinel=False)
                codes = codes * max(1, len(unique)) + code
                uniques.append(unique)
            values = pdf["__value"].to_numpy(np.float64)
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
            edges = np.flatnonzero(np.diff(codes)) + 1
            for code, part in zip(codes[np.concatenate([[0], edges])], np.split(values, edges)):
                key = []
                for unique in reversed(uniques):
                    code, i = divmod(int(code), max(1, len(unique)))
                    v = unique[i]
                    key.append(None if v is None or v is pd.NaT or v != v else v)
                key = tuple(reversed(key))
                if key not in held:
                    held[key] = Sketch(k)
                held[key].add(part)

        def give():
            out = pd.DataFrame([(*key, s.dump()) for key, s in held.items()], columns=[*keys, "sketch"])
            held.clear()
            return out

        for pdf in batches:
            if len(pdf):
                chunk.append(pdf)
                n += len(pdf)
            if n >= CHUNK:
                take()
                chunk, n = [], 0
                if len(held) > HELD_GROUPS:
                    yield give()
        if chunk:
            take()
        if held:
            yield give()

    return rows.mapInPandas(run, schema)


#: Values of a group beyond which its rows are split over several tasks.
SPLIT = 100_000


def group_sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """(keys, sketch) with one sketch per group, for fine groups such as days, of which there are very many.

    Rows move once, sorted by group, and each group's values stream through one sketch. Groups with more than :data:`SPLIT`
    values are dealt row by row to several tasks, whatever their values, and the sketches of these are then merged. The list of such groups is joined as its size
    suggests, not broadcast by force. Nulls and NaN are treated as in :func:`partial_sketches`.
    """
    ws = Workspace(df.sparkSession, "sketches")
    rows = ws.cut(df.select(*keys, F.col(value).cast("double").alias("__value")).filter(F.col("__value").isNotNull() & ~F.isnan("__value")), "values")
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", __part int, sketch binary"
    names = [f"__h{i}" for i in range(len(keys))]
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > SPLIT).select(*[F.col(c).alias(n) for c, n in zip(keys, names)], F.ceil(F.col("__n") / SPLIT).alias("__parts"))
    on = F.lit(True)
    for c, n in zip(keys, names):
        on = on & F.col(c).eqNullSafe(F.col(n))
    # a row's number in its task of the written table is the same whenever that task runs again
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).join(hot, on, "left")
    dealt = dealt.select(*keys, "__value", F.when(F.col("__parts").isNotNull(), F.pmod("__row", F.col("__parts")) + 1).otherwise(0).cast("int").alias("__part"))
    group = [*keys, "__part"]

    def run(batches):
        open_key, open_sketch = None, None
        small = 2 * SECTIONS * k
        for pdf in batches:
            if not len(pdf):
                continue
            values = pdf["__value"].to_numpy(np.float64)
            change = np.zeros(len(pdf), bool)
            for c in group:
                col = pdf[c].to_numpy()
                blank = pd.isna(col)
                change[1:] |= (col[1:] != col[:-1]) & ~(blank[1:] & blank[:-1]) if col.dtype == object else (col[1:] != col[:-1])
                if col.dtype == object:
                    change[1:] |= blank[1:] != blank[:-1]
            edges = np.concatenate([[0], np.flatnonzero(change), [len(pdf)]])
            heads = [pdf[c].to_numpy()[edges[:-1]] for c in group]
            out = []
            for g, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                key = tuple(None if pd.isna(h[g]) else h[g] for h in heads)
                if key != open_key:
                    if open_sketch is not None:
                        out.append((*open_key, open_sketch.dump()))
                    open_key, open_sketch = key, None
                    if b - a < small and b < len(pdf):  # whole and small: its values are the sketch
                        out.append((*key, _raw(values[a:b], k)))
                        open_key = None
                        continue
                if open_sketch is None:
                    open_sketch = Sketch(k)
                open_sketch.add(values[a:b])
            yield pd.DataFrame(out, columns=[*group, "sketch"])
        if open_sketch is not None:
            yield pd.DataFrame([(*open_key, open_sketch.dump())], columns=[*group, "sketch"])

    made = dealt.repartition(*group).sortWithinPartitions(*group).mapInPandas(run, schema)
    if not hot.limit(1).count():
        return made.drop("__part")
    made = ws.cut(made, "made")
    whole = made.filter("__part = 0").drop("__part")
    return whole.unionByName(merge_sketches(made.filter("__part > 0").drop("__part"), keys))


def _raw(values: np.ndarray, k: int) -> bytes:
    """What :meth:`Sketch.dump` gives for a sketch that has compacted nothing yet."""
    n = len(values)
    return struct.pack("<iqddi", k, n, values.min(), values.max(), 1) + struct.pack("<iqiib", n, 0, SECTIONS, k, 0) + values.astype("<f8").tobytes()


def merge_sketches(df: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """(keys, sketch) with one sketch per group, from any number of partial ones.

    In two passes, the first by (keys, salt), so a group with a sketch from every task of a large job doesn't meet in one task;
    within a task sketches are folded one by one.
    """
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", sketch binary"

    def fold(batches):
        # rows come sorted by key, so one running sketch is enough
        now, sketch, out = None, None, []
        for pdf in batches:
            for row in pdf[[*keys, "sketch"]].itertuples(index=False, name=None):
                key = tuple(None if v is None or v is pd.NaT or v != v else v for v in row[:-1])
                if sketch is None or key != now:
                    if sketch is not None:
                        out.append((*now, sketch.dump()))
                    now, sketch = key, Sketch.load(row[-1])
                else:
                    sketch.merge(Sketch.load(row[-1]))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=[*keys, "sketch"])
                out = []
        if sketch is not None:
            out.append((*now, sketch.dump()))
        if out:
            yield pd.DataFrame(out, columns=[*keys, "sketch"])

    salted = df.select(*keys, "sketch", F.pmod(F.xxhash64("sketch"), F.lit(salts)).cast("int").alias("__salt"))
    once = salted.repartition(*keys, "__salt").sortWithinPartitions(*keys, "__salt", "sketch").mapInPandas(fold, schema)
    return once.repartition(*keys).sortWithinPartitions(*keys, "sketch").mapInPandas(fold, schema)


def roll_up(df: DataFrame, keys: list[str], sets: dict[str, list[str]]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones: (grouping, keys, sketch), keys outside the set being null."""
    types = dict(df.dtypes)
    each = F.array(*[F.struct(F.lit(name).alias("grouping"), *[(F.col(c) if c in wanted else F.lit(None).cast(types[c])).alias(c) for c in keys]) for name, wanted in sets.items()])
    rows = df.select("sketch", F.explode(each).alias("__g")).select("__g.grouping", *[F.col(f"__g.{c}") for c in keys], "sketch")
    return merge_sketches(rows, ["grouping", *keys])


def read_percentiles(df: DataFrame, percentiles: dict[str, float] = PERCENTILES, keep_sketch: bool = False) -> DataFrame:
    """The keys with n, min, the percentiles (nearest rank), max and rank_error (see :func:`rank_error`; 0 where all values are kept)."""
    keys = [c for c in df.columns if c != "sketch"]
    types = dict(df.dtypes)
    names = list(percentiles)
    more = ["sketch"] if keep_sketch else []
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", n long, " + ", ".join(f"`{c}` double" for c in ["min", *names, "max", "rank_error"]) + ", sketch binary" * keep_sketch
    qs = list(percentiles.values())
    head, level = struct.calcsize("<iqddi"), struct.calcsize("<iqiib")

    def one(data: bytes):
        k, n, low, high, depth = struct.unpack_from("<iqddi", data)
        if depth == 1:  # nothing was compacted: exact
            values = np.sort(np.frombuffer(data, "<f8", n, head + level))
            return (n, low, *[float(values[min(n, max(1, math.ceil(q * n - 1e-9))) - 1]) for q in qs], high, 0.0)
        s = Sketch.load(data)
        return (s.n, s.low, *s.quantiles(qs), s.high, rank_error(k))

    def run(batches):
        for pdf in batches:
            got = pd.DataFrame([one(x) for x in pdf["sketch"]], columns=["n", "min", *names, "max", "rank_error"], index=pdf.index)
            yield pd.concat([pdf[keys], got, pdf[more]], axis=1)

    return df.mapInPandas(run, schema)


def check_bounds(sketches: DataFrame, rows: DataFrame, keys: list[str], sets: dict[str, list[str]], value: str, k: int = K, percentiles: dict[str, float] = PERCENTILES) -> DataFrame:
    """(grouping, keys, n, compacted, percentile, within): whether the rank of each percentile lies within the stated bound, by counts over all rows.

    ``sketches`` are :func:`roll_up`'s, ``rows`` what they were made of, without null and NaN. A report has as many rows as there are groups and percentiles.
    """
    got = read_percentiles(sketches, percentiles)
    each = F.array(*[F.struct(F.lit(name).alias("grouping"), *[(F.col(c) if c in wanted else F.lit(None).cast(dict(rows.dtypes)[c])).alias(c) for c in keys]) for name, wanted in sets.items()])
    # equal values of a group are one row from here on
    values = rows.select(F.explode(each).alias("__g"), F.col(value).alias("__v")).groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__n"))
    values = values.select(*[F.col(f"__g.{c}").alias(f"__{c}") for c in ("grouping", *keys)], "__v", "__n")
    on = F.col("grouping") == F.col("__grouping")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    counts = [f(F.when(cond, F.col("__n")).otherwise(0)).alias(f"{side}_{p}") for p in percentiles for f, side, cond in ((F.sum, "low", F.col("__v") < F.col(p)), (F.sum, "high", F.col("__v") <= F.col(p)))]
    ranked = got.join(values, on).groupBy("grouping", *keys, "n", "rank_error").agg(*counts)
    wants = {p: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n") - 1e-9)) for p, q in percentiles.items()}
    within = [F.struct(F.lit(p).alias("percentile"), (F.greatest(F.col(f"low_{p}") + 1 - wants[p], wants[p] - F.col(f"high_{p}"), F.lit(0)) <= F.lit(rank_error(k) * (1 - q)) * F.col("n") + 1).alias("within")) for p, q in percentiles.items()]
    return ranked.select("grouping", *keys, "n", (F.col("rank_error") > 0).alias("compacted"), F.inline(F.array(*within)))
