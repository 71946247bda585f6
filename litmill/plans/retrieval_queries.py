"""Queries of the retrieval path: BM25, vectors, fusion, tuning, evidence, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.rules import EXPANSIONS
from litmill.operators import evidence as ev
from litmill.operators import retrieval as rt
from litmill.plans.catalog import SQL, query
from litmill.plans.library_queries import STRIP_SQL
from litmill.plans.text_queries import COLLAPSE, TOKENS, WS
from litmill.session import spread, table

N = 5


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "source"))


def bm25_sql(n: int) -> str:
    """CTEs up to hits(query_id, rank, doc_id, score)."""
    return f"""
    qt AS (SELECT item_id AS query_id, unnest({TOKENS.format('text')}) AS term FROM eval_items),
    q AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
    dt AS (SELECT doc_id, len(ts) AS dl, ts FROM (SELECT doc_id, {TOKENS.format('text')} AS ts FROM documents)),
    corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dt),
    posting AS (SELECT doc_id, dl, unnest(ts) AS term FROM dt),
    tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM posting GROUP BY ALL),
    idf0 AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf, corpus GROUP BY term, n),
    mean AS (SELECT avg(idf) AS m FROM idf0),
    idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * m ELSE idf END AS idf FROM idf0, mean),
    s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN q USING (term) JOIN idf USING (term), corpus GROUP BY ALL),
    hits AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s) WHERE rank <= {n})
    """


@query(sql=f"WITH {bm25_sql(N)} SELECT query_id, rank, doc_id, score FROM hits")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the five best documents for every evaluation text."""
    return rt.bm25_top(asked(spark, d), docs(spark, d), N)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def query_vectors(spark: SparkSession, d: str, step: int = 100) -> DataFrame:
    """The stated query set of a search: every vector whose id is divisible by 100, against all."""
    return vectors(spark, d).where(F.col("vec_id") % step == 0).select(F.col("vec_id").alias("query_id"), "embedding")


DIST = "round(1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) + 0.0"


@query(sql=f"""
SELECT query_id, rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
SELECT a.vec_id AS query_id, b.vec_id, {DIST} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0)) WHERE rank <= {N}
""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return rt.vector_top(query_vectors(spark, d), vectors(spark, d), N)


@query()
def vector_topk_lsh(spark: SparkSession, d: str) -> DataFrame:
    """The approximate index over all vectors, asked by the same query set."""
    return rt.lsh_top(query_vectors(spark, d), vectors(spark, d), N)


def vector_hits(spark: SparkSession, d: str, n: int) -> DataFrame:
    """Hits of documents by vector: a document has the vector of its own number, an item that of item_id."""
    q = vectors(spark, d).join(asked(spark, d), F.col("vec_id") == F.col("query_id"), "left_semi").select(F.col("vec_id").alias("query_id"), "embedding")
    return rt.vector_top(q, vectors(spark, d), n).withColumnRenamed("vec_id", "doc_id")


VHITS = f"""v AS (SELECT query_id, vec_id AS doc_id, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (
 SELECT a.vec_id AS query_id, b.vec_id, {DIST} AS distance FROM embeddings a JOIN embeddings b ON a.vec_id IN (SELECT item_id FROM eval_items))) WHERE rank <= {3 * N})"""
FUSED = f"""{bm25_sql(3 * N)}, {VHITS},
 b AS (SELECT query_id, doc_id, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0.0 END AS b, rank AS br FROM hits),
 j AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.doc_id, b.doc_id) AS doc_id, coalesce(1 / (1 + v.distance), 0.0) AS vs, coalesce(b.b, 0.0) AS bs, v.rank AS vr, br FROM v FULL OUTER JOIN b ON v.query_id = b.query_id AND v.doc_id = b.doc_id),
 k AS (SELECT *, round(greatest(0.0, least(1.0, 0.7 * vs + 0.3 * bs)), 6) AS score FROM j),
 fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, (vr IS NULL), coalesce(vr, br)) AS rank FROM k) WHERE rank <= {N})"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    return rt.hybrid(vector_hits(spark, d, 3 * N), rt.bm25_top(asked(spark, d), docs(spark, d), 3 * N), N)


@query(sql=f"WITH {FUSED} SELECT query_id, rank, doc_id, round(vs, 6) AS vector_score, round(bs, 6) AS bm25_score, score, round((1 - score) / greatest(score, 1e-6), 6) AS distance FROM fused")
def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d)


@query(sql=f"""
WITH {FUSED}, r AS (SELECT f.*, (length(t.text) % 1000) / 1000.0 AS raw FROM fused f LEFT JOIN documents t USING (doc_id)),
m AS (SELECT *, min(raw) OVER (PARTITION BY query_id) AS lo, max(raw) OVER (PARTITION BY query_id) AS hi FROM r),
f AS (SELECT *, round(CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 1.0 END, 6) AS final_score FROM m)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rank) AS rank, doc_id, final_score FROM f
""")
def reranked(spark: SparkSession, d: str) -> DataFrame:
    """A stub scorer, the length of the text, stands for a model."""
    hits = fused(spark, d).join(docs(spark, d).select("doc_id", "text"), "doc_id", "left")
    return rt.rerank(hits, F.length("text") % 1000 / 1000.0).select("query_id", "rank", "doc_id", "final_score")


@query(sql=r"""
WITH q AS (SELECT paper_id AS query_id, regexp_replace(coalesce(title, ''), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS q FROM papers),
t AS (SELECT *, lower(q) AS l, len(regexp_extract_all(lower(q), '[a-z0-9]+')) AS n FROM q),
r AS (SELECT *, CASE WHEN regexp_matches(l, '^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$') OR (starts_with(l, '10.') AND contains(l, '/')) OR contains(l, 'arxiv:') OR contains(l, 'doi:') THEN 1 WHEN n <= 2 THEN 2
  WHEN contains(q, '?') OR contains(l, 'why') OR contains(l, 'how') OR contains(l, 'compare') OR contains(l, 'difference') OR contains(l, 'tradeoff') THEN 3 WHEN n >= 12 THEN 4 ELSE 5 END AS k FROM t)
SELECT query_id, CASE WHEN k <= 2 THEN 'bm25' WHEN k = 4 THEN 'vector' ELSE 'hybrid' END AS mode, CASE k WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 5 THEN 6 ELSE 8 END AS n_results, CASE WHEN k = 3 THEN 4 ELSE 3 END AS candidate_multiplier,
 CASE k WHEN 1 THEN 'identifier_query' WHEN 2 THEN 'short_keyword_query' WHEN 3 THEN 'question_or_reasoning_query' WHEN 4 THEN 'long_semantic_query' ELSE 'default_hybrid' END AS reason FROM r
""")
def auto_tune(spark: SparkSession, d: str) -> DataFrame:
    return rt.auto_tune(table(spark, d, "papers").select(F.col("paper_id").alias("query_id"), F.col("title").alias("text")))


RULES = ", ".join(f"({k}, '{key}', [{', '.join(repr(t) for t in terms)}])" for k, (key, terms) in enumerate(EXPANSIONS))


@query(sql=f"""
WITH RECURSIVE q AS (SELECT paper_id AS query_id, title AS text, array_to_string({TOKENS.format('title')}, ' ') AS p FROM papers WHERE title IS NOT NULL),
r(k, key, terms) AS (VALUES {RULES}),
f AS (SELECT query_id, text, p, -1 AS k, CAST([] AS VARCHAR[]) AS terms, CAST([] AS VARCHAR[]) AS keys FROM q
 UNION ALL SELECT f.query_id, f.text, f.p, f.k + 1, CASE WHEN contains(p, r.key) AND len(f.terms) < 8 THEN list_concat(f.terms, list_filter(r.terms, lambda t: NOT list_contains(f.terms, t)))[1:8] ELSE f.terms END,
   CASE WHEN contains(p, r.key) AND len(f.terms) < 8 THEN list_append(f.keys, r.key) ELSE f.keys END FROM f JOIN r ON r.k = f.k + 1)
SELECT query_id, CASE WHEN len(terms) > 0 THEN text || ' ' || array_to_string(terms, ' ') ELSE text END AS expanded_query, array_to_string(terms, '|') AS extra_terms, array_to_string(keys, '|') AS rules_matched FROM f WHERE k = {len(EXPANSIONS) - 1}
""")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    return rt.expand_queries(table(spark, d, "papers").where("title is not null").select(F.col("paper_id").alias("query_id"), F.col("title").alias("text")))


def evidence(spark: SparkSession, d: str) -> DataFrame:
    hits = fused(spark, d).join(docs(spark, d), "doc_id")
    return ev.label_evidence(hits.select("query_id", "rank", "doc_id", "distance", "text", F.col("source").alias("title")))


GRADED = f"""WITH {FUSED}, e AS (SELECT query_id, rank, greatest(0.0, least(1.0, 1 / (1 + round((1 - score) / greatest(score, 1e-6), 6)))) AS s, t.source AS title, t.text FROM fused JOIN documents t USING (doc_id)),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC) AS rn FROM e),
 g AS (SELECT query_id, count(*) AS n, max(s) AS top, avg(s) FILTER (rn <= 3) AS mean3, count(*) FILTER (s >= 0.55) AS strong, count(DISTINCT lower({STRIP_SQL.format('title')})) FILTER ({STRIP_SQL.format('title')} <> '') AS titles FROM o GROUP BY 1),
 x AS (SELECT *, greatest(0.0, least(1.0, (0.45 * top + 0.30 * mean3 + 0.15 * least(1.0, strong / 3) + 0.10 * least(1.0, titles / 3)) * (0.85 + 0.15 * least(1.0, n / 5)))) AS x FROM g),
 y AS (SELECT *, CASE WHEN x < 0.28 OR top < 0.20 THEN 'refuse' WHEN x < 0.48 OR strong < 2 THEN 'downgrade' ELSE 'answer' END AS decision FROM x),
 z AS (SELECT query_id, round(x, 4) AS confidence, CASE decision WHEN 'refuse' THEN 'low' WHEN 'downgrade' THEN 'medium' ELSE 'high' END AS band, decision,
  array_to_string(list_filter([CASE WHEN top < 0.22 THEN 'very_low_top_evidence' END, CASE WHEN mean3 < 0.30 THEN 'weak_average_evidence' END, CASE WHEN strong < 2 THEN 'few_strong_evidence_chunks' END, CASE WHEN titles < 2 THEN 'low_source_diversity' END], lambda r: r IS NOT NULL), ',') AS reasons,
  n AS evidence_count, round(top, 4) AS top_score, round(mean3, 4) AS mean_top3, strong AS strong_count, titles AS unique_titles FROM y)"""


@query(sql=f"{GRADED} SELECT * FROM z UNION ALL SELECT item_id, 0.0, 'low', 'refuse', 'no_evidence', 0, 0.0, 0.0, 0, 0 FROM eval_items WHERE item_id NOT IN (SELECT query_id FROM z)")
def confidence_decision(spark: SparkSession, d: str) -> DataFrame:
    """The decision on every question; one without evidence is refused."""
    return ev.confidence(evidence(spark, d), asked(spark, d))


SHORT = f"(CASE WHEN length({{0}}) <= 220 THEN {{0}} ELSE regexp_replace(substr({{0}}, 1, 220), '{WS}+$', '') || '...' END)"


@query(sql=f"""{GRADED}, l AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, '- [S' || row_number() OVER (PARTITION BY query_id ORDER BY rank) || '] ' || {SHORT.format(COLLAPSE.format("coalesce(text, '')"))} AS line FROM e)
SELECT z.query_id, z.decision, CASE z.decision
 WHEN 'refuse' THEN '{ev.REFUSAL[0]}' || chr(10) || '{ev.REFUSAL[1]}' || chr(10) || string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 3) || chr(10) || 'Confidence=' || printf('%.3f', round(any_value(confidence), 3)) || ' (' || any_value(band) || '); decision=refuse.'
 WHEN 'downgrade' THEN '{ev.DOWNGRADED[0]}' || chr(10) || string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 5) || chr(10) || 'Confidence=' || printf('%.3f', round(any_value(confidence), 3)) || ' (' || any_value(band) || '); decision=downgrade.'
 ELSE string_agg(line, chr(10) ORDER BY rank) FILTER (rank <= 4) END AS answer FROM z JOIN l USING (query_id) GROUP BY z.query_id, z.decision""")
def answers(spark: SparkSession, d: str) -> DataFrame:
    e = evidence(spark, d)
    return ev.answers(e, ev.confidence(e))


@query(sql=f"""WITH {FUSED}, e AS (SELECT query_id, t.source AS title, 1 / (1 + round((1 - score) / greatest(score, 1e-6), 6)) AS s, rank FROM fused JOIN documents t USING (doc_id)),
best AS (SELECT query_id, title, max(s) AS m, arg_min(rank, (-s, rank)) AS first FROM e GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(m, 6) DESC, first) AS rank, title, round(m, 6) AS similarity FROM best QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(m, 6) DESC, first) <= 3""")
def best_per_paper(spark: SparkSession, d: str) -> DataFrame:
    return rt.best_per_paper(evidence(spark, d), 3)


@query(sql=f"""WITH {FUSED}, e AS (SELECT query_id, t.source AS title, round(1 / (1 + round((1 - score) / greatest(score, 1e-6), 6)), 6) AS s, rank, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS x,
 row_number() OVER (PARTITION BY query_id, t.source ORDER BY rank) AS k FROM fused JOIN documents t USING (doc_id)),
g AS (SELECT query_id, title, arg_min(s, rank) AS similarity, min(rank) AS first, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY rank) FILTER (k <= 2), '') AS excerpts FROM e GROUP BY ALL)
SELECT query_id, title, similarity, excerpts FROM g QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY first) <= 3""")
def excerpts_per_paper(spark: SparkSession, d: str) -> DataFrame:
    return rt.excerpts_per_paper(evidence(spark, d), 3)


@query(sql="""
WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings)
SELECT label, k - 1 AS pos, round(avg(x), 5) AS mean FROM p GROUP BY label, k
""")
def mean_vector(spark: SparkSession, d: str) -> DataFrame:
    m = rt.mean_vectors(vectors(spark, d), "label")
    return m.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", "pos", F.round("x", 5).alias("mean"))


@query(sql="""
WITH p AS (SELECT label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, k, avg(x) AS x FROM p GROUP BY ALL), v AS (SELECT label, list(x ORDER BY k) AS e FROM m GROUP BY 1),
s AS (SELECT a.label AS query_id, b.label AS vec_id, round(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS distance FROM v a JOIN v b ON a.label <> b.label)
SELECT query_id, rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s) WHERE rank <= 3
""")
def similar_papers(spark: SparkSession, d: str) -> DataFrame:
    """Papers most like a paper, by mean vector, itself left out; a label stands for a paper."""
    m = rt.mean_vectors(vectors(spark, d), "label")
    return rt.vector_top(m.select(F.col("label").cast("bigint").alias("query_id"), "embedding"), m.select(F.col("label").alias("vec_id"), "embedding"), 3, exclude_self=True)


@query(sql=rf"""WITH a AS ({SQL['answers']}), c AS (SELECT query_id, regexp_extract_all(coalesce(answer, ''), '\[S([0-9]+)\]', 1) AS c FROM a)
SELECT query_id, len(c) > 0 AND len(list_filter(c, lambda k: CAST(k AS INTEGER) NOT BETWEEN 1 AND 3)) = 0 AS valid FROM c""")
def tag_validation(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer cites evidence, and none beyond S3."""
    e = evidence(spark, d)
    return ev.answers(e, ev.confidence(e)).select("query_id", ev.valid_tags(F.col("answer"), F.lit(3)).alias("valid"))


@query(sql=f"""
WITH h AS (SELECT source, string_agg('[Source: ' || section || ']' || chr(10) || left(text, 200) || chr(10) || chr(10), '' ORDER BY doc_id) AS context FROM (
 SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE section IS NOT NULL AND text IS NOT NULL) WHERE rn <= 5 GROUP BY 1)
SELECT * FROM h
""")
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    """The first five texts of each source as one context."""
    from pyspark.sql import Window as W

    t = table(spark, d, "documents").where("section is not null and text is not null").withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy("doc_id"))).where("rn <= 5")
    part = F.concat(F.lit("[Source: "), F.col("section"), F.lit("]\n"), F.left(F.col("text"), F.lit(200)), F.lit("\n\n"))
    return t.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("p")))), lambda x: x["p"]), "").alias("context"))


@query()
def rank_by_article(spark: SparkSession, d: str) -> DataFrame:
    """Papers ranked by likeness of vectors to an article, in percent."""
    hits = rt.vector_top(query_vectors(spark, d), vectors(spark, d), 10)
    return hits.select("query_id", "rank", "vec_id", F.round(100 * (1 - F.col("distance")), 1).alias("percent"))

