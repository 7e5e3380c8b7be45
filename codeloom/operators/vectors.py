"""Vector search and rank fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of either side; a task multiplies two blocks.
QUERY_BLOCK, CORPUS_BLOCK = 512, 8192
RRF_K = 60


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Blocks of about ``size`` rows each, so that what a task holds doesn't grow with the table."""
    n = max(1, -(-df.count() // size))
    return df.groupBy(F.pmod(F.xxhash64(key), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list(F.struct(F.col(key).alias("id"), F.col(vector).alias("v"))).alias(name))


def knn(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", min_score: float | None = None, drop_self: bool = True) -> DataFrame:
    """The k nearest rows of each query, exactly: (query_id, id, distance, rank).

    Blocks of queries meet blocks of the corpus, each pair is one matrix product that passes on k rows per query, and a window over these (k per
    corpus block) takes the best. Distance is 1 - cosine, or the L2 norm of the difference; ties go to the smaller id. Null vectors and, for cosine, zero
    ones are left out; with ``drop_self`` a row isn't its own neighbour; ``min_score`` keeps 1 - distance at least so large.
    """
    rows = corpus.filter(F.col(vector).isNotNull()).select(key, vector)
    asked = queries.filter(F.col(vector).isNotNull()).select(key, vector)
    kind = dict(rows.dtypes)[key]
    pairs = _blocks(rows, key, vector, CORPUS_BLOCK, "c").crossJoin(_blocks(asked, key, vector, QUERY_BLOCK, "q"))

    def run(batches):
        for pdf in batches:
            out = []
            for c, q in zip(pdf["c"], pdf["q"]):
                ci, qi = np.array([r["id"] for r in c]), np.array([r["id"] for r in q])
                cv, qv = (np.array([r["v"] for r in side], np.float64) for side in (c, q))
                if metric == "cosine":
                    cn, qn = np.linalg.norm(cv, axis=1), np.linalg.norm(qv, axis=1)
                    ci, cv, qi, qv = ci[cn > 0], cv[cn > 0] / cn[cn > 0, None], qi[qn > 0], qv[qn > 0] / qn[qn > 0, None]
                    dist = 1 - qv @ cv.T
                else:
                    dist = np.sqrt(np.maximum(0, (qv**2).sum(1)[:, None] + (cv**2).sum(1)[None] - 2 * qv @ cv.T))
                dist = np.round(dist, 9)
                for i in range(len(qi)):
                    row = dist[i].copy()
                    if drop_self:
                        row[ci == qi[i]] = np.inf
                    edge = min(k, len(row)) - 1
                    if edge < 0:
                        continue
                    limit = np.partition(row, edge)[edge]
                    near = np.flatnonzero(row <= limit)
                    near = near[np.lexsort((ci[near], row[near]))][:k]
                    out += [(qi[i], ci[j], row[j]) for j in near if np.isfinite(row[j])]
            yield pd.DataFrame(out, columns=["query_id", "id", "distance"])

    found = pairs.mapInPandas(run, f"query_id {kind}, id {kind}, distance double")
    if min_score is not None:
        found = found.filter(1 - F.col("distance") >= min_score)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def rrf(keyword: DataFrame, semantic: DataFrame, key: str = "id", weights: tuple[float, float] = (1.0, 1.0), k: int = RRF_K, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (``by``, key, rank): score = sum of w / (k + rank), full outer on the key."""
    a = keyword.select(*by, key, F.col("rank").alias("ra"))
    b = semantic.select(*by, key, F.col("rank").alias("rb"))
    j = a.join(b, [*by, key], "full_outer")
    part = lambda r, w: F.coalesce(F.lit(w) / (F.col(r) + k), F.lit(0.0))
    out = j.withColumn("score", F.round(part("ra", weights[0]) + part("rb", weights[1]), 9))
    order = [F.desc("score"), F.asc(key)]
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order) if by else Window.partitionBy(F.lit(1)).orderBy(*order))).select(*by, key, "score", "rank")


def label_vote(neighbours: DataFrame, labels: DataFrame, key: str = "vec_id", label: str = "label") -> DataFrame:
    """The most frequent label among each query's neighbours (ties to the smaller) and its share."""
    named = neighbours.join(labels.select(F.col(key).alias("id"), F.col(label).alias("l")), "id")
    counts = named.groupBy("query_id", "l").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("query_id").agg(F.max(F.struct("n", (-F.col("l")).alias("neg"))).alias("b"), F.sum("n").alias("of")).select("query_id", (-F.col("b.neg")).cast("int").alias("label"), F.round(F.col("b.n") / F.col("of"), 6).alias("share"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def purge(vectors: DataFrame, symbols: DataFrame, key: str) -> DataFrame:
    """Vectors whose symbol is still there."""
    return vectors.join(symbols.select(F.col(symbols.columns[0]).alias(key)), key, "left_semi")
