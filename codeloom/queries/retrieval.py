"""Queries on lexical, vector and hybrid retrieval (F) with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import paths
from codeloom.functions.naming import camel_parts, drop_compounds
from codeloom.operators import search as S
from codeloom.operators import vectors as V
from codeloom.operators.postings import Postings
from codeloom.queries.base import Area
from codeloom.sources import catalogue as T
from codeloom.sources.tables import table

query = Area()
ASKED = ("rank quota", "merge ledger status", "cache turbine", "load invoice", "function settle meter", "retry later", "split parcel harvest", "scanBeacon")
FIELDS = {"name": 4.0, "signature": 2.0, "doc_comment": 1.5, "code_body": 1.0}


def _queries(asked=ASKED):
    return [S.parse_query(q) for q in asked]


def _symbol_docs(spark, d):
    s = T.symbols(spark, d, "name", "signature", "doc_comment", "code_context", "kind", "file_path", "language")
    return s.withColumnRenamed("code_context", "code_body")


def _terms_sql(queries) -> str:
    return ", ".join(f"({i}, '{t}', {str(g == 'original').lower()}, {w!r})" for i, q in enumerate(queries) for t, g, w in q.groups())


def _bm25_sql(docs: str, key: str, fields: dict[str, float], queries) -> str:
    each = " UNION ALL ".join(f"SELECT {key}, '{f}' AS field, regexp_extract_all(lower(coalesce({f}, '')), '[\\p{{L}}\\p{{N}}_]+') AS toks FROM docs" for f in fields)
    boost = "CASE field " + " ".join(f"WHEN '{f}' THEN {b}" for f, b in fields.items()) + " END"
    need = "CASE query " + " ".join(f"WHEN {i} THEN {len(q.terms)}" for i, q in enumerate(queries)) + " END"
    return f"""WITH docs AS ({docs}), x AS (SELECT {key}, field, toks, len(toks) AS len FROM ({each})), st AS (SELECT field, count(*) AS n, avg(len) AS avg FROM x GROUP BY 1),
     q(query, term, original, weight) AS (VALUES {_terms_sql(queries)}), t AS (SELECT {key}, field, len, unnest(toks) AS term FROM x),
     post AS (SELECT {key}, field, term, len, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3, 4), df AS (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2),
     part AS (SELECT query, {key}, post.term, original, {boost} * weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg)) AS p FROM post JOIN df USING (field, term) JOIN st USING (field) JOIN q ON q.term = post.term),
     sc AS (SELECT query, {key}, sum(p) AS score, count(DISTINCT CASE WHEN original THEN term END) AS found, {need} AS need FROM part GROUP BY query, {key}),
     k AS (SELECT *, found = need AS complete, max(CASE WHEN found = need THEN 1 ELSE 0 END) OVER (PARTITION BY query) AS strict FROM sc WHERE found > 0)
     SELECT query, {key}, score, CASE WHEN strict = 1 THEN 'and' ELSE 'or' END AS mode FROM k WHERE strict = 0 OR complete"""


@query("SELECT query::INT AS query, id, round(score, 6) AS score, mode FROM (" + _bm25_sql("SELECT id, name, signature, doc_comment, code_context AS code_body FROM s", "id", FIELDS, _queries()) + ")")
def f01_f04_bm25_symbols(spark, d):
    return S.bm25(_symbol_docs(spark, d), "id", FIELDS, _queries()).withColumn("score", F.round("score", 6))


@query("SELECT query::INT AS query, doc_id, rank::INT AS rank, mode FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (" + _bm25_sql("SELECT doc_id, text FROM documents", "doc_id", {"text": 1.0}, _queries()) + ")) WHERE rank <= 20")
def e01_f02_bm25_documents(spark, d):
    return S.top_hits(S.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", {"text": 1.0}, _queries()), "doc_id", 20).select("query", "doc_id", "rank", "mode")


_CHANGED = "SELECT id, CASE WHEN kind = 'method' THEN 'rank quota' ELSE name END AS name, signature, doc_comment, code_context AS code_body FROM s WHERE kind IS DISTINCT FROM 'class'"


@query("SELECT query::INT AS query, id AS key, round(score, 6) AS score, mode FROM (" + _bm25_sql(_CHANGED, "id", FIELDS, _queries()) + ")")
def f01_f03_a24_postings(spark, d):
    """The searches on a maintained index: built from all symbols, methods replaced (with another name), classes deleted."""
    docs = _symbol_docs(spark, d).select(F.col("id").alias("key"), "kind", *FIELDS)
    index = Postings(spark, FIELDS).build(docs)
    index.upsert(docs.filter("kind = 'method'").withColumn("name", F.lit("rank quota")))
    index.delete(docs.filter("kind = 'class'"))
    return index.search(_queries()).withColumn("score", F.round("score", 6))


@query()
def f02_f19_unified_search(spark, d):
    """The whole pipeline for one query over symbols and files: tokens with variants, BM25, over-fetch, rerank, promotion."""
    q = S.parse_query("settle quota")
    s = T.symbols(spark, d, "name", "signature", "doc_comment", "code_context", "kind", "file_path", "language")
    f = T.files(spark, d, "language", "content")
    docs = s.select(F.concat(F.lit("s:"), "id").alias("key"), F.col("name"), "signature", "doc_comment", F.col("code_context").alias("code_body"), F.lit(None).cast("string").alias("path_text"), F.lit(None).cast("string").alias("content"), F.col("file_path").alias("path"), "kind", "language", F.lit(False).alias("is_file"))
    file_docs = f.select(F.concat(F.lit("f:"), "path").alias("key"), F.regexp_replace(paths.basename(F.col("path")), r"\.[^.]*$", "").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("signature", "doc_comment", "code_body")], F.col("path").alias("path_text"), "content", F.col("path"), F.lit(None).cast("string").alias("kind"), "language", F.lit(True).alias("is_file"))
    docs = docs.unionByName(file_docs)
    boosts = {k: v for k, v in S.FIELD_BOOSTS.items() if k in docs.columns}
    hits = S.top_hits(S.bm25(docs, "key", boosts, [q], S.code_tokens), "key", max(S.LEAST_CANDIDATES, 4 * 50))
    rows = hits.join(docs, "key").withColumn("role", paths.role(F.col("path"), F.col("language")))
    rows = rows.select("key", "score", F.col("name").alias("title"), "path", "kind", "role", F.coalesce("content", F.concat_ws(" ", "signature", "doc_comment", "code_body")).alias("body"), "is_file", paths.is_test_path(F.col("path")).alias("is_test"), (~F.col("language").isin(*paths.DOC_LANGUAGES)).alias("is_source"))
    best = S.promote(S.rerank(rows, q), "settle quota").limit(50)
    return best.select("key", "title", "path", "tier", F.round("final", 6).alias("final"))


@query(r"SELECT name, array_to_string(list_filter(string_split(name, '_'), lambda x: x <> ''), ' ') AS snake, regexp_replace(regexp_replace(name, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g') AS camel FROM (SELECT DISTINCT name FROM s WHERE name IS NOT NULL)")
def f10_f11_splits(spark, d):
    from codeloom.functions.naming import snake_parts

    n = F.col("name")
    return T.symbols(spark, d, "name").filter("name is not null").select("name").distinct().select("name", F.array_join(snake_parts(n), " ").alias("snake"), F.array_join(camel_parts(n), " ").alias("camel"))


@query(r"WITH t AS (SELECT id, list_distinct(regexp_extract_all(lower(signature), '[\p{L}\p{N}_]+')) AS toks FROM s WHERE signature IS NOT NULL) SELECT id, len(list_filter(toks, lambda t: NOT (contains(t, '_') AND len(list_filter(list_filter(string_split(t, '_'), lambda p: p <> ''), lambda p: NOT list_contains(toks, p))) = 0)))::INT AS kept FROM t")
def f12_f13_f41_tokens(spark, d):
    s = T.symbols(spark, d, "signature").filter("signature is not null").select("id", F.array_distinct(S.plain_tokens(F.col("signature"))).alias("toks"))
    return s.select("id", F.size(drop_compounds(F.col("toks"))).alias("kept"))


@query()
def f08_f39_f40_code_tokens(spark, d):
    """Tokens of signatures with the variants of known affixes."""
    toks = S.code_tokens(F.col("signature"), affixes=("is_", "_mut"), prefixes=("I",), suffixes=("Store", "Reader"))
    return T.symbols(spark, d, "signature").filter("signature is not null").select("id", F.array_join(toks, " ").alias("tokens"))


@query(r"SELECT path, line::INT AS line, text FROM (SELECT path, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS line, regexp_replace(raw, '\r$', '') AS text FROM f WHERE content IS NOT NULL) WHERE contains(lower(text), 'retry later')")
def f31_f33_line_search(spark, d):
    return S.line_search(T.files(spark, d, "content"), '"retry later"')


@query(r"WITH l AS (SELECT path, unnest(string_split(content, chr(10))) AS text FROM f WHERE content IS NOT NULL) SELECT path, count(*) FILTER (list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 'return') AND list_contains(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), 'null'))::BIGINT AS hits, count(*)::INT AS lines FROM l GROUP BY 1 HAVING hits > 0")
def f33_line_density(spark, d):
    return S.line_density(T.files(spark, d, "content"), "return null").select("path", "hits", "lines")


@query(r"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') || ' ', ' missing parents ')")
def f43_f44_phrase(spark, d):
    return table(spark, d, "documents").filter(S.phrase_match(F.col("text"), "missing parents!")).select("doc_id")


_KNN = "SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id) AS rank, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance, b.label FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id"


def _near(spark, d, k, **more):
    e = table(spark, d, "embeddings")
    return V.knn(e, e.filter("vec_id % 20 = 0"), k, **more)


@query(f"SELECT query_id, id, rank::INT AS rank, round(distance, 6) AS distance FROM ({_KNN}) WHERE rank <= 10")
def f25_f26_knn(spark, d):
    return _near(spark, d, 10).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


@query(f"SELECT query_id, id, round(1 - distance, 6) AS score FROM ({_KNN}) WHERE rank <= 5 AND 1 - distance >= 0.35")
def f27_f28_similar(spark, d):
    return _near(spark, d, 5, min_score=0.35).select("query_id", "id", F.round(1 - F.col("distance"), 6).alias("score"))


@query(f"WITH n AS (SELECT query_id, label, count(*) AS n FROM ({_KNN}) WHERE rank <= 15 GROUP BY 1, 2) SELECT query_id, label::INT AS label, round(n / 15.0, 6)::DOUBLE AS share FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS rn FROM n) WHERE rn = 1")
def f25_label_vote(spark, d):
    return V.label_vote(_near(spark, d, 15), table(spark, d, "embeddings"))


@query(f"SELECT k.query_id, k.id, k.rank::INT AS rank, d.doc_kind, d.source FROM ({_KNN}) k JOIN documents d ON d.doc_id = k.id WHERE k.rank <= 10")
def c19_c20_hit_enrichment(spark, d):
    hits = _near(spark, d, 10)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "doc_kind", "source")
    return hits.join(docs, "id").select("query_id", "id", "rank", "doc_kind", "source")


@query(f"""WITH sem AS (SELECT query_id AS query, id, rank FROM ({_KNN}) WHERE rank <= 40 AND query_id < {20 * len(ASKED)}),
 kw AS (SELECT query * 20 AS query, doc_id AS id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS rank FROM ({_bm25_sql('SELECT doc_id, text FROM documents', 'doc_id', {'text': 1.0}, _queries())})) WHERE rank <= 40),
 j AS (SELECT coalesce(kw.query, sem.query) AS query, coalesce(kw.id, sem.id) AS id, round(coalesce(0.8 / (60 + kw.rank), 0) + coalesce(0.8 / (60 + sem.rank), 0), 9) AS score FROM kw FULL JOIN sem ON kw.query = sem.query AND kw.id = sem.id)
 SELECT query::BIGINT AS query, id, score::DOUBLE AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM j) WHERE rank <= 10""")
def f29_f30_hybrid_rrf(spark, d):
    sem = _near(spark, d, 40).filter(F.col("query_id") < 20 * len(ASKED)).select(F.col("query_id").alias("query"), "id", "rank")
    kw = S.top_hits(S.bm25(table(spark, d, "documents").select("doc_id", "text"), "doc_id", {"text": 1.0}, _queries()), "doc_id", 40)
    kw = kw.select((F.col("query") * 20).cast("long").alias("query"), F.col("doc_id").alias("id"), "rank")
    return V.rrf(kw, sem, weights=(0.8, 0.8), by=("query",)).filter("rank <= 10")


@query("SELECT id, round(reference_score * (1.0::DOUBLE + 0.3::DOUBLE * ln(1 + reference_score)), 9)::DOUBLE AS boosted, round((reference_score * CASE WHEN regexp_matches(file_path, '(^|/)(fixtures|fixture|Fixtures|Fixture|testdata|test_data|test-data|__fixtures__|snapshots|Snapshots|__snapshots__|benchmarks|Benchmarks|benchmark|Benchmark)(/|$)') THEN 0.7::DOUBLE WHEN regexp_matches(file_path, '@TEST@') THEN 0.85::DOUBLE WHEN regexp_matches(file_path, '(^|/)(docs|doc|documentation|Docs|Doc|Documentation)(/|$)') THEN 0.92::DOUBLE ELSE 1.08::DOUBLE END) * CASE WHEN language <> 'python' THEN 0.85::DOUBLE ELSE 1.0::DOUBLE END, 9)::DOUBLE AS prior, CASE WHEN contains(signature, 'async') THEN round(reference_score * 1.5::DOUBLE, 9) ELSE round(reference_score, 9) END AS pattern FROM s WHERE reference_score IS NOT NULL")
def f21_f24_score_stages(spark, d):
    s = T.symbols(spark, d, "reference_score", "file_path", "language", "signature").filter("reference_score is not null")
    r = F.col("reference_score")
    return s.select("id", F.round(S.centrality_boost(r, r), 9).alias("boosted"), F.round(S.language_affinity(S.path_prior(r, F.col("file_path")), F.col("language"), "python"), 9).alias("prior"), F.round(S.pattern_boost(r, F.col("signature"), ["async"]), 9).alias("pattern"))


QUERIES, ORACLES = query.QUERIES, query.ORACLES
