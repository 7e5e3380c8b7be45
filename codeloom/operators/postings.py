"""A maintained index of postings: searches read the files of their terms alone (F01-F04, J01 with A24-A27)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.search import Query, plain_tokens, score_postings
from codeloom.plans.cut import Workspace, shared_dir
from codeloom.plans.spread import partitions_for

#: Folders that terms are dealt to by hash; a search opens at most one per term and segment.
BUCKETS = 64


class Postings:
    """Postings (term, field, key, tf, len) of documents in segments: a build, then one per change, until they are merged.

    A segment holds postings by term bucket, sorted by term, so that a file's statistics tell most readers to skip it; lengths (key, field, len); and the keys that it
    replaces or deletes in the segments before. Nothing written is ever changed, so readers and a lost executor see whole segments.
    """

    def __init__(self, spark: SparkSession, fields: dict[str, float], key: str = "key", root: str | None = None, tokens=plain_tokens):
        self.spark, self.fields, self.key, self.tokens = spark, fields, key, tokens
        self.root = root or f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}"
        self.segments: list[str] = []
        self._kind = "string"

    def _write(self, docs: DataFrame, gone: DataFrame | None) -> None:
        path = f"{self.root}/{len(self.segments):04d}-{uuid.uuid4().hex}"
        each = F.array(*[F.struct(F.lit(f).alias("field"), self.tokens(F.col(f)).alias("toks")) for f in self.fields])
        rows = docs.select(F.col(self.key).alias("key"), F.explode(each).alias("x")).select("key", "x.field", F.greatest(F.size("x.toks"), F.lit(0)).alias("len"), "x.toks")
        rows = Workspace(self.spark, "tokens").cut(rows, "tokens")
        rows.select("key", "field", "len").write.parquet(f"{path}/lengths")
        post = rows.select("key", "field", "len", F.explode("toks").alias("term")).groupBy("term", "field", "key", "len").agg(F.count(F.lit(1)).alias("tf"))
        post = post.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        # a term of a third of all postings is spread by key over its bucket's files, of which there are more the more there is to write
        many = partitions_for(rows)
        post.repartition(many, "bucket", F.pmod(F.xxhash64("key"), F.lit(max(1, many // BUCKETS)))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
        if gone is not None:
            gone.select(F.col(self.key).alias("key")).distinct().write.parquet(f"{path}/gone")
        self.segments.append(path)

    def build(self, docs: DataFrame) -> Postings:
        """Starts anew with all documents."""
        self.segments, self._kind = [], dict(docs.dtypes)[self.key]
        self._write(docs, None)
        return self

    def upsert(self, docs: DataFrame) -> None:
        """Adds documents; those that have the same key are replaced. A key stands in one row of ``docs``."""
        self._write(docs, docs)

    def delete(self, keys: DataFrame) -> None:
        """Takes documents out by key."""
        none = self.spark.createDataFrame([], ", ".join([f"`{self.key}` {self._kind}", *[f"`{f}` string" for f in self.fields if f != self.key]]))
        self._write(none, keys)

    def _load(self, path: str, part: str) -> DataFrame:
        schema = {"lengths": f"key {self._kind}, field string, len int", "postings": f"term string, field string, key {self._kind}, len int, tf long, bucket int", "gone": f"key {self._kind}"}[part]
        return self.spark.read.schema(schema).parquet(f"{path}/{part}")

    def _read(self, part: str, keep=None) -> DataFrame:
        """A part of all segments without what later segments take out of earlier ones."""
        out = None
        for i, path in enumerate(self.segments):
            rows = self._load(path, part)
            rows = rows if keep is None else rows.filter(keep)
            for later in self.segments[i + 1:]:
                rows = rows.join(self._load(later, "gone"), "key", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def search(self, queries: list[Query]) -> DataFrame:
        """BM25 as :func:`codeloom.operators.search.bm25` gives it: (query, key, score, mode). Only the folders of the queries' terms are read, and of lengths their numbers."""
        terms = sorted({t for q in queries for t, _, _ in q.groups()})
        stats = self._read("lengths").groupBy("field").agg(F.count(F.lit(1)).alias("N"), F.avg("len").alias("avg"))
        buckets = [r[0] for r in self.spark.createDataFrame([(t,) for t in terms], "t string").select(F.pmod(F.xxhash64("t"), F.lit(BUCKETS)).cast("int")).distinct().collect()]
        post = self._read("postings", F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return score_postings(self.spark, post, stats, "key", self.fields, queries)
