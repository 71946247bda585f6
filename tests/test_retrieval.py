import numpy as np
from pyspark.sql import functions as F

from litmill.operators import evidence as ev
from litmill.operators import retrieval as rt


def tuned(spark, text, n=5):
    return rt.auto_tune(spark.createDataFrame([(1, text)], "query_id int, text string"), n).first()


def test_auto_tune(spark):
    assert (tuned(spark, "10.1000/xyz123").mode, tuned(spark, "10.1000/xyz123").n_results) == ("bm25", 5)
    assert tuned(spark, "auction design").reason == "short_keyword_query"
    q = tuned(spark, "How does the first-price auction compare with the second-price auction in revenue and efficiency?")
    assert (q.mode, q.n_results, q.candidate_multiplier) == ("hybrid", 8, 4)
    assert tuned(spark, None).mode == "bm25"


def test_bm25_fills_up_with_zero_scores(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, None), (4, "red red wine"), (5, "blue"), (6, "grey")], "doc_id int, text string")
    got = rt.bm25_top(spark.createDataFrame([(9, "red")], "query_id int, text string"), docs, 4).orderBy("rank").collect()
    assert [r.doc_id for r in got][2:] == [2, 3] and [r.score for r in got][2:] == [0.0, 0.0]
    assert {r.doc_id for r in got[:2]} == {1, 4}


def test_vector_top_is_exact_and_lsh_recalls(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    e = {r.vec_id: np.array(r.embedding, float) for r in v.collect()}
    ids = sorted(e)
    m = np.array([e[k] / np.linalg.norm(e[k]) for k in ids])
    exact = {k: [i for _, i in sorted((round(1 - float(m[ids.index(k)] @ m[j]), 6), i) for j, i in enumerate(ids) if i != k)[:5]] for k in ids if k % 100 == 0}
    got = {}
    for r in rt.vector_top(q, v, 5, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact
    near = {}
    for r in rt.lsh_top(q, v, 5).collect():
        near.setdefault(r.query_id, set()).add(r.vec_id)
    recall = sum(len(near.get(k, set()) & set(exact[k])) for k in exact) / sum(map(len, exact.values()))
    assert recall >= 0.9


def test_vector_top_of_nothing(spark):
    v = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert rt.vector_top(v.withColumnRenamed("vec_id", "query_id"), v, 3).count() == 0


def graded(spark, scores, titles=None, **kw):
    rows = [(1, k, s, (titles or [f"t{k}" for k in range(len(scores))])[k], f"S{k + 1}", "text") for k, s in enumerate(scores)]
    e = spark.createDataFrame(rows, "query_id int, rank int, score double, title string, label string, text string")
    return e, ev.confidence(e, spark.createDataFrame([(1,)], "query_id int"), **kw)


def test_confidence_cases(spark):
    r = graded(spark, [0.11, 0.19, 0.15], refuse=0.30, downgrade=0.55)[1].first()
    assert (r.band, r.decision) == ("low", "refuse") and r.confidence == 0.2167
    e, g = graded(spark, [0.12, 0.18, 0.17], refuse=0.30, downgrade=0.55)
    assert g.first().confidence == 0.2143
    assert "Insufficient high-confidence evidence" in ev.answers(e, g).first().answer
    e, g = graded(spark, [0.50, 0.43, 0.36], refuse=0.30, downgrade=0.60)
    assert g.first().confidence == 0.4268
    assert "downgraded to direct, source-supported observations" in ev.answers(e, g).first().answer


def test_no_evidence_is_refused(spark):
    e = spark.createDataFrame([], "query_id int, rank int, score double, title string, label string, text string")
    r = ev.confidence(e, spark.createDataFrame([(7,)], "query_id int")).first()
    assert (r.decision, r.reasons, r.confidence) == ("refuse", "no_evidence", 0.0)


def test_valid_tags(spark):
    df = spark.createDataFrame([("a [S1] b [S2]",), ("a [S3]",), ("none",), (None,)], "a string")
    assert [r.x for r in df.select(ev.valid_tags(F.col("a"), F.lit(2)).alias("x")).collect()] == [True, False, False, False]


def test_rank_by_article_takes_the_stated_query_set(spark, sf):
    from litmill.plans import retrieval_queries as rq

    got = {r.query_id for r in rq.rank_by_article(spark, sf).select("query_id").collect()}
    assert got == {r.vec_id for r in rq.vectors(spark, sf).where("vec_id % 100 = 0").select("vec_id").collect()}
