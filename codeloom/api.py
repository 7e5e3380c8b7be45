"""The engine's facade: one method per tool."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.operators import analysis, catalog, context, graph, hierarchy, pages, resolve, search, vectors
from codeloom.sources import catalogue as T
from codeloom.sources import sinks
from codeloom.sources.tables import table


class Engine:
    """Queries over one data directory; every method gives a DataFrame planned by Catalyst, or the few rows of one request."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory
        self._pages = pages.Spillover(spark)

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.directory, name)

    def search(self, text: str, limit: int = 6, language: str | None = None, kind: str | None = None, file_pattern: str | None = None, exclude_tests: bool | None = None, exact_filters: bool = False) -> DataFrame:
        """Lexical search over symbols. Filters work on the best candidates as the reference's do; ``exact_filters`` applies them before ranking."""
        q = search.parse_query(text)
        docs = T.symbols(self.spark, self.directory, "name", "signature", "doc_comment", "code_context", "kind", "file_path", "language").withColumnRenamed("code_context", "code_body")
        keep = catalog.search_filter(language, kind, file_pattern, search.exclude_tests(text, file_pattern, exclude_tests))
        limit = catalog.clamp(limit)
        fields = {f: search.FIELD_BOOSTS[f] for f in ("name", "signature", "doc_comment", "code_body")}
        source = docs.filter(keep) if exact_filters else docs
        best = search.top_hits(search.bm25(source, "id", fields, [q]), "id", max(search.LEAST_CANDIDATES, search.OVERFETCH * limit))
        rows = best.join(docs, "id").filter(keep).withColumn("role", paths.role(F.col("file_path"), F.col("language")))
        rows = rows.select("id", "score", F.col("name").alias("title"), F.col("file_path").alias("path"), "kind", "role", F.concat_ws(" ", "signature", "doc_comment", "code_body").alias("body"), F.lit(False).alias("is_file"), paths.is_test_path(F.col("file_path")).alias("is_test"), F.lit(True).alias("is_source"))
        return search.promote(search.rerank(rows, q), text).limit(limit).select("id", "title", "kind", "path", F.round("final", 6).alias("score"))

    def lines(self, text: str) -> DataFrame:
        return search.line_search(T.files(self.spark, self.directory, "content"), text)

    def symbols(self, path: str) -> DataFrame:
        """J02."""
        return catalog.lookup(T.symbols(self.spark, self.directory, "name", "kind", "file_path", "start_line", "parent_id"), "file_path", path, ["start_line", "id"])

    def references(self, name: str) -> DataFrame:
        """J04."""
        defs = T.symbols(self.spark, self.directory, "name", "file_path", "start_line").filter(F.col("name") == name)
        return resolve.references(T.edges(self.spark, self.directory), T.identifiers(self.spark, self.directory, "name", "kind", "file_path", "start_line"), defs)

    def call_path(self, start: str, target: str, max_hops: int = 6) -> list[str] | None:
        """Ids along a shortest path, or None."""
        starts = T.symbols(self.spark, self.directory).filter(F.col("id") == start)
        reached = graph.distances(T.edges(self.spark, self.directory), starts, min(32, max_hops))
        back, now = [target], target
        while now != start:  # one row per hop
            row = reached.filter(F.col("id") == now).first()
            if row is None or row.via is None:
                return None
            now = row.via
            back.append(now)
        return back[::-1]

    def impact(self, ids: list[str], depth: int = 2) -> DataFrame:
        """J07."""
        s = T.symbols(self.spark, self.directory, "reference_score")
        return graph.impact(T.edges(self.spark, self.directory), s.select("id", F.col("reference_score").alias("score")), s.filter(F.col("id").isin(ids)), depth)

    def deep_dive(self, name: str) -> dict[str, DataFrame]:
        """A symbol's definition, neighbours, children and references."""
        s = T.symbols(self.spark, self.directory, "name", "kind", "file_path", "signature", "parent_id", "start_line")
        own = s.filter(F.col("name") == name)
        return {"definitions": own, "neighbours": graph.neighbours(T.edges(self.spark, self.directory), own), "children": catalog.lookup_joined(s, "parent_id", own.select("id")), "references": self.references(name)}

    def context(self, text: str, limit: int = 20) -> dict:
        """The pivots of a question with their code within the budget, and what had to be left out."""
        hits = self.search(text, limit).collect()
        n = context.pivot_count([h.score for h in hits])
        budget = context.allocate(n)
        rows = {r.id: r for r in T.symbols(self.spark, self.directory, "name", "code_context").filter(F.col("id").isin([h.id for h in hits])).collect()}
        pivots = [(h.id, context.head_tail(rows[h.id].code_context or "", budget["pivots"] // max(1, n))) for h in hits[:n]]
        others = [h.title or "" for h in hits[n:]]
        kept, spilled = context.pack(others, budget["neighbours"])
        return {"pivots": pivots, "neighbours": [others[i] for i in kept], "spilled": [others[i] for i in spilled]}

    def patterns(self, facet: str = "$.arity", by: tuple[str, ...] = ("language", "kind")) -> DataFrame:
        """J08."""
        s = T.symbols(self.spark, self.directory, *by, "metadata").withColumn("facet", F.get_json_object("metadata", facet))
        return s.filter(F.col("facet").isNotNull()).groupBy(*by, "facet").agg(F.count(F.lit(1)).alias("n"))

    def similar(self, vec_id: int, k: int = 10) -> DataFrame:
        e = self._t("embeddings")
        return vectors.knn(e, e.filter(F.col("vec_id") == vec_id), k, min_score=0.35)

    def outline_sets(self) -> DataFrame:
        return hierarchy.nested_sets(self.spark, hierarchy.catalogue_forest({t: self._t(t) for t in hierarchy.CATALOGUE}))

    def workspaces(self) -> DataFrame:
        """Every workspace with its files, symbols and whether what was derived of it is as new as they are."""
        files = T.files(self.spark, self.directory, "workspace_id", "symbol_count")
        state = analysis.freshness(self._t("workspaces"), files)
        per = files.groupBy("workspace_id").agg(F.sum("symbol_count").alias("symbols"))
        return state.join(per, "workspace_id", "left").select("workspace_id", "files", F.coalesce("symbols", F.lit(0)).alias("symbols"), "state")

    def index(self, root: str, store: sinks.Store, profile: str = "full_index") -> int:
        """Scans a folder and publishes its files as the store's next revision, which is all that a refresh needs to compare."""
        return store.publish({"files": sinks.scan(self.spark, root, profile=profile)}, "index")

    def refresh(self, root: str, store: sinks.Store) -> DataFrame:
        """How the folder differs from the store's files: (path, state)."""
        return resolve.changed_files(sinks.scan(self.spark, root), store.read("files"))

    def spill(self, df: DataFrame, owner: str, order: list, title: str = "") -> str:
        """Keeps a long result; its handle is good for :meth:`page`."""
        return self._pages.put(df, owner, order, title)

    def page(self, handle: str, owner: str, offset: int = 0, limit: int = 50) -> DataFrame:
        """J09."""
        return self._pages.get(handle, owner, offset, limit)
