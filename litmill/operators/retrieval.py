"""Retrieval over relations of queries and chunks: BM25, exact vector search, fusion, rerank, tuning."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litmill.functions.rules import EXPANSIONS
from litmill.functions.text import looks_like_identifier, strip, tokens
from litmill.session import union_all


@dataclass(frozen=True)
class RetrievalConfig:
    """Weights of the hybrid, candidates per wanted hit, depth of the rerank."""

    alpha: float = 0.7
    multiplier: int = 3
    rerank_depth: int = 20


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def top_n(df: DataFrame, n: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first n rows of each query by a total order, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


#: Queries per pass of BM25 over the corpus; their term weights are what a task holds.
TERM_BLOCK = 256


def bm25_top(queries: DataFrame, docs: DataFrame, n: int, p: Bm25 = Bm25()) -> DataFrame:
    """(query_id, rank, doc_id, score): the n best documents of each query; score to 6 places.

    A query term counts as often as it is repeated; the idf of a term in more than half of the
    documents is a share of the mean idf. Documents without a term of the query fill up with score 0.
    Term statistics are aggregates over all documents. Then the queries go over the documents in
    blocks: a task scores its documents against a block's term weights as a matrix product and keeps
    the n best per query, so what is shuffled is tasks * queries * n rows, not a row for each
    document that shares a stop word with a query.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    terms = d.select(tokens(F.col("text")).alias("ts"))
    corpus = terms.agg(F.count("*").alias("n"), F.avg(F.size("ts")).alias("avgdl")).first()
    df = terms.select(F.explode(F.array_distinct("ts")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.select("term", (F.log(F.lit(corpus["n"]) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf")).first()[0] or 0.0
    parts, block = [], {}
    for r in queries.select("query_id", tokens(F.col("text")).alias("ts")).toLocalIterator():
        block[r["query_id"]] = Counter(r["ts"])
        if len(block) == TERM_BLOCK:
            parts.append(_bm25_part(block, d, raw, mean, corpus["avgdl"] or 1.0, n, p))
            block = {}
    if block or not parts:
        parts.append(_bm25_part(block, d, raw, mean, corpus["avgdl"] or 1.0, n, p))
    hits = top_n(union_all(parts), n, F.desc("score"), F.asc("doc_id"))
    few = queries.select("query_id").join(hits.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < n)
    # a query short of hits has fewer than n of them, so 2n documents hold enough others
    first = d.select("doc_id").orderBy("doc_id").limit(2 * n)
    fill = few.select("query_id").crossJoin(first).join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return top_n(hits.drop("rank").unionByName(fill), n, F.desc("score"), F.asc("doc_id"))


def _bm25_part(block: dict, docs: DataFrame, raw: DataFrame, mean: float, avgdl: float, n: int, p: Bm25) -> DataFrame:
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for c in block.values() for t in c})], "term string")
    # at most the distinct terms of one block of queries
    idf = {r["term"]: p.epsilon * mean if r["idf"] < 0 else r["idf"] for r in raw.join(wanted, "term").collect()}
    at = {t: k for k, t in enumerate(sorted(idf))}
    weight, has = np.zeros((len(at), len(block))), np.zeros((len(at), len(block)), np.float32)
    for q, c in enumerate(block.values()):
        for t, times in c.items():
            if t in at:
                weight[at[t], q], has[at[t], q] = times * idf[t], 1
    shared = spark.sparkContext.broadcast((np.array(list(block), np.int64), at, weight, has))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, weight, has = shared.value
        words = re.compile("[a-z0-9]+").findall
        best, doc = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                b = batch.slice(start, 512)
                tf, length = np.zeros((b.num_rows, len(at))), np.zeros((b.num_rows, 1))
                for k, t in enumerate(b.column(1).to_pylist()):
                    ts = words(t.lower()) if t else []
                    length[k] = len(ts)
                    for w, times in Counter(ts).items():
                        if w in at:
                            tf[k, at[w]] = times
                s = np.round((tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * length / avgdl))) @ weight, 6)
                s[((tf > 0).astype(np.float32) @ has) == 0] = -np.inf
                best, doc = np.hstack([best, s.T]), np.hstack([doc, np.broadcast_to(b.column(0).to_numpy(), s.T.shape)])
                order = np.lexsort((doc, -best), axis=1)[:, :n]
                best, doc = np.take_along_axis(best, order, 1), np.take_along_axis(doc, order, 1)
        there = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[:, None], best.shape)[there]), pa.array(doc[there]), pa.array(best[there])], names=["query_id", "doc_id", "score"])

    return docs.mapInArrow(score, "query_id bigint, doc_id bigint, score double")


#: Query vectors per pass over the corpus; a block and its partial results are what a task holds.
QUERY_BLOCK = 1024


def vector_top(queries: DataFrame, vectors: DataFrame, n: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, distance): the n nearest vectors by cosine distance, exact, to 6 places.

    Queries (query_id, embedding) go out in blocks of bounded size; each task keeps the n best of its
    own rows per query, so what is shuffled is tasks * queries * n rows, never all pairs.
    """
    parts, block = [], []
    for r in queries.select("query_id", "embedding").where("embedding is not null").toLocalIterator():
        block.append((r["query_id"], r["embedding"]))
        if len(block) == QUERY_BLOCK:
            parts.append(_vector_part(block, vectors, n, exclude_self))
            block = []
    if block or not parts:
        parts.append(_vector_part(block, vectors, n, exclude_self))
    found = parts[0]
    for x in parts[1:]:
        found = found.unionByName(x)
    return top_n(found, n, F.asc("distance"), F.asc("vec_id"))


def _vector_part(block: list, vectors: DataFrame, n: int, exclude_self: bool) -> DataFrame:
    ids = np.array([k for k, _ in block], dtype=np.int64)
    q = np.array([v for _, v in block], dtype=np.float64)
    if len(ids):
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-30)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        kept_d, kept_v = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            v = np.array(b.column(0).to_pylist(), np.int64)
            e = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            e /= np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-30)
            d = np.round(1 - q @ e.T, 6) + 0.0  # no negative zero
            if exclude_self:
                d[ids[:, None] == v[None, :]] = np.inf
            kept_d, kept_v = np.hstack([kept_d, d]), np.hstack([kept_v, np.broadcast_to(v, d.shape)])
            order = np.lexsort((kept_v, kept_d), axis=1)[:, :n]
            kept_d, kept_v = np.take_along_axis(kept_d, order, 1), np.take_along_axis(kept_v, order, 1)
        there = np.isfinite(kept_d)
        qid = np.broadcast_to(ids[:, None], kept_d.shape)
        yield pa.RecordBatch.from_arrays([pa.array(qid[there]), pa.array(kept_v[there]), pa.array(kept_d[there])], names=["query_id", "vec_id", "distance"])

    return vectors.where("embedding is not null").select(F.col("vec_id").cast("bigint"), "embedding").mapInArrow(nearest, "query_id bigint, vec_id bigint, distance double")


def lsh_top(queries: DataFrame, vectors: DataFrame, n: int, seed: int = 42, tables: int = 8, width: float = 0.8) -> DataFrame:
    """As vector_top with exclude_self, approximate: bucketed random projections of the unit vectors.

    Every vector is indexed; recall against the exact search is measured by the tests.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector

    norm = Normalizer(inputCol="raw", outputCol="unit", p=2.0)
    unit = lambda df, k: norm.transform(df.select(F.col(k).alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))).select("id", "unit")
    v, q = unit(vectors, "vec_id"), unit(queries, "query_id")
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=width, numHashTables=tables, seed=seed).fit(v)
    pairs = model.approxSimilarityJoin(q, v, 1.5, distCol="d").select(F.col("datasetA.id").alias("query_id"), F.col("datasetB.id").alias("vec_id"), (F.col("d") * F.col("d") / 2).alias("distance"))
    return top_n(pairs.where("query_id <> vec_id").withColumn("distance", F.round("distance", 6)), n, F.asc("distance"), F.asc("vec_id"))


def distance_of(score: Column) -> Column:
    """The distance whose 1 / (1 + d) is the score."""
    return (1 - score) / F.greatest(score, F.lit(1e-6))


def normalized(score: Column) -> Column:
    """Divided by the query's greatest score; 0 where that is not positive."""
    most = F.max(score).over(W.partitionBy("query_id"))
    return F.when(most > 0, score / most).otherwise(F.lit(0.0))


def hybrid(vector_hits: DataFrame, bm25_hits: DataFrame, n: int, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, rank, doc_id, vector_score, bm25_score, score, distance): both hit lists fused.

    vector_hits: query_id, doc_id, distance, rank. bm25_hits: query_id, doc_id, score, rank. Ties keep
    the order of the vector hits, then of the hits that only BM25 found.
    """
    v = vector_hits.select("query_id", "doc_id", (1 / (1 + F.col("distance"))).alias("v"), F.col("rank").alias("vr"))
    b = bm25_hits.withColumn("s", normalized(F.col("score"))).select("query_id", "doc_id", F.col("s").alias("b"), F.col("rank").alias("br"))
    j = v.join(b, ["query_id", "doc_id"], "full_outer").withColumns({"v": F.coalesce("v", F.lit(0.0)), "b": F.coalesce("b", F.lit(0.0))})
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cfg.alpha * F.col("v") + (1 - cfg.alpha) * F.col("b")))
    j = j.withColumn("score", F.round(s, 6)).withColumn("only_b", F.col("vr").isNull())
    t = top_n(j, n, F.desc("score"), F.asc("only_b"), F.asc(F.coalesce("vr", "br")))
    return t.select("query_id", "rank", "doc_id", F.round("v", 6).alias("vector_score"), F.round("b", 6).alias("bm25_score"), "score", F.round(distance_of(F.col("score")), 6).alias("distance"))


def rerank(hits: DataFrame, score: Column, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """hits (query_id, rank, doc_id, score, ...) in the order of a reranker's score, scaled to 0..1 over the first hits.

    Only the first rerank_depth hits are scored anew; the rest keep their combined score. All equal
    scores become 1.
    """
    head = F.col("rank") <= cfg.rerank_depth
    w = W.partitionBy("query_id")
    h = hits.withColumn("raw", F.when(head, score))
    low, high = F.min("raw").over(w), F.max("raw").over(w)
    scaled = F.when(high > low, (F.col("raw") - low) / (high - low)).otherwise(F.lit(1.0))
    h = h.withColumn("final_score", F.round(F.when(head, scaled).otherwise(F.col("score")), 6)).withColumn("before", F.col("rank"))
    return h.withColumn("rank", F.row_number().over(w.orderBy(F.desc("final_score"), F.asc("before")))).drop("raw")


def auto_tune(queries: DataFrame, n: int = 5, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, mode, n_results, candidate_multiplier, reason) by ordered rules on the query's form."""
    q = strip(F.coalesce("text", F.lit("")))
    low, count = F.lower(q), F.size(tokens(q))
    asks = q.contains("?")
    for w in ("why", "how", "compare", "difference", "tradeoff"):
        asks |= low.contains(w)
    case = (
        F.when(looks_like_identifier(q), F.struct(F.lit("bm25").alias("mode"), F.lit(max(3, min(8, n))).alias("n"), F.lit(cfg.multiplier).alias("m"), F.lit("identifier_query").alias("r")))
        .when(count <= 2, F.struct(F.lit("bm25").alias("mode"), F.lit(max(5, n)).alias("n"), F.lit(cfg.multiplier).alias("m"), F.lit("short_keyword_query").alias("r")))
        .when(asks, F.struct(F.lit("hybrid").alias("mode"), F.lit(max(n, 8)).alias("n"), F.lit(max(cfg.multiplier, 4)).alias("m"), F.lit("question_or_reasoning_query").alias("r")))
        .when(count >= 12, F.struct(F.lit("vector").alias("mode"), F.lit(max(n, 8)).alias("n"), F.lit(cfg.multiplier).alias("m"), F.lit("long_semantic_query").alias("r")))
        .otherwise(F.struct(F.lit("hybrid").alias("mode"), F.lit(max(n, 6)).alias("n"), F.lit(cfg.multiplier).alias("m"), F.lit("default_hybrid").alias("r")))
    )
    return queries.select("query_id", case.alias("x")).select("query_id", F.col("x.mode").alias("mode"), F.col("x.n").alias("n_results"), F.col("x.m").alias("candidate_multiplier"), F.col("x.r").alias("reason"))


def expand_queries(queries: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, expanded_query, extra_terms, rules_matched): related terms of the rules whose key the query holds."""
    plain = F.array_join(tokens(F.col("text")), " ")
    rules = F.filter(F.array(*[F.when(plain.contains(k), F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, terms)).alias("t"))) for k, terms in EXPANSIONS]), lambda r: r.isNotNull())
    # a rule is matched only while terms are still wanted
    folded = F.aggregate(
        rules,
        F.struct(F.array().cast("array<string>").alias("terms"), F.array().cast("array<string>").alias("keys")),
        lambda s, r: F.when(F.size(s["terms"]) < most, F.struct(F.slice(F.array_union(s["terms"], r["t"]), 1, most).alias("terms"), F.concat(s["keys"], F.array(r["k"])).alias("keys"))).otherwise(s),
    )
    x = queries.select("query_id", "text", folded.alias("f"))
    more = F.size("f.terms") > 0
    return x.select(
        "query_id", F.when(more, F.concat_ws(" ", F.col("text"), F.array_join("f.terms", " "))).otherwise(F.col("text")).alias("expanded_query"),
        F.array_join("f.terms", "|").alias("extra_terms"), F.array_join("f.keys", "|").alias("rules_matched"),
    )


def best_per_paper(hits: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, title, similarity): each title's best hit, the earliest among equals, best first."""
    h = hits.withColumn("similarity", 1 / (1 + F.col("distance")))
    best = h.groupBy("query_id", "title").agg(F.max(F.struct(F.col("similarity"), (-F.col("rank")).alias("r"))).alias("m"))
    best = best.select("query_id", "title", F.round("m.similarity", 6).alias("similarity"), (-F.col("m.r")).alias("first"))
    return top_n(best, n, F.desc("similarity"), F.asc("first")).drop("first")


def excerpts_per_paper(hits: DataFrame, n: int, most: int = 500, each: int = 2) -> DataFrame:
    """(query_id, title, similarity, excerpts): of the first n titles the first hit's similarity and two excerpts."""
    cut = F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("..."))).otherwise(F.col("text"))
    # ranked before they are gathered, so no list is longer than `each`
    first = hits.withColumn("_no", F.row_number().over(W.partitionBy("query_id", "title").orderBy("rank"))).where(F.col("_no") <= each)
    g = first.withColumn("x", F.struct("rank", cut.alias("t"))).groupBy("query_id", "title").agg(
        F.min_by(F.round(1 / (1 + F.col("distance")), 6), "rank").alias("similarity"), F.min("rank").alias("first"), F.array_sort(F.collect_list("x")).alias("xs"),
    )
    return top_n(g, n, F.asc("first")).select("query_id", "title", "similarity", F.array_join(F.col("xs.t"), "\n\n").alias("excerpts"))


def mean_vectors(vectors: DataFrame, by: str) -> DataFrame:
    """(by, embedding): the mean of the vectors of each group, element by element."""
    pos = vectors.select(by, F.posexplode("embedding").alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return pos.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("embedding"))
