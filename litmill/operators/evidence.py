"""Evidence of hits, its confidence, and answers made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litmill.functions.text import short_snippet, strip


def label_evidence(hits: DataFrame) -> DataFrame:
    """hits (query_id, rank, distance, ...) with label S1.. and score 1 / (1 + distance)."""
    return hits.withColumn("label", F.concat(F.lit("S"), F.row_number().over(W.partitionBy("query_id").orderBy("rank")).cast("string"))).withColumn("score", 1 / (1 + F.col("distance")))


def confidence(evidence: DataFrame, queries: DataFrame | None = None, refuse: float = 0.28, downgrade: float = 0.48, strong: float = 0.55) -> DataFrame:
    """One row a query: score, band, decision, reasons and what they rest on. A query without evidence is refused."""
    refuse = max(0.0, min(1.0, refuse))
    downgrade, strong = max(refuse + 0.02, min(1.0, downgrade)), max(0.0, min(1.0, strong))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("score", F.lit(0.0))))
    e = evidence.select("query_id", s.alias("s"), F.lower(strip(F.coalesce("title", F.lit("")))).alias("t"))
    e = e.withColumn("rn", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("s"))))
    g = e.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("s").alias("top"), F.avg(F.when(F.col("rn") <= 3, F.col("s"))).alias("mean3"),
        F.count_if(F.col("s") >= strong).alias("strong"), F.count_distinct(F.when(F.col("t") != "", F.col("t"))).alias("titles"),
    )
    if queries is not None:
        g = queries.select("query_id").distinct().join(g, "query_id", "left").fillna({"n": 0, "top": 0.0, "mean3": 0.0, "strong": 0, "titles": 0})
    third = lambda c: F.least(F.lit(1.0), F.col(c) / 3)
    raw = 0.45 * F.col("top") + 0.30 * F.col("mean3") + 0.15 * third("strong") + 0.10 * third("titles")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * (0.85 + 0.15 * F.least(F.lit(1.0), F.col("n") / 5))))
    g = g.withColumn("x", F.when(F.col("n") > 0, score).otherwise(F.lit(0.0)))
    decision = F.when((F.col("x") < refuse) | (F.col("top") < 0.20), "refuse").when((F.col("x") < downgrade) | (F.col("strong") < 2), "downgrade").otherwise("answer")
    reasons = F.array_compact(F.array(
        F.when(F.col("top") < 0.22, "very_low_top_evidence"), F.when(F.col("mean3") < 0.30, "weak_average_evidence"),
        F.when(F.col("strong") < 2, "few_strong_evidence_chunks"), F.when(F.col("titles") < 2, "low_source_diversity"),
    ))
    g = g.withColumn("decision", decision)
    return g.select(
        "query_id", F.round("x", 4).alias("confidence"), F.element_at(F.create_map(*map(F.lit, ("refuse", "low", "downgrade", "medium", "answer", "high"))), F.col("decision")).alias("band"), "decision",
        F.when(F.col("n") == 0, F.lit("no_evidence")).otherwise(F.array_join(reasons, ",")).alias("reasons"),
        F.col("n").alias("evidence_count"), F.round("top", 4).alias("top_score"), F.round("mean3", 4).alias("mean_top3"), F.col("strong").alias("strong_count"), F.col("titles").alias("unique_titles"),
    )


REFUSAL = ("Insufficient high-confidence evidence in the local library to answer this question reliably.", "Available evidence is listed below without further synthesis:")
DOWNGRADED = ("Evidence is partial, so this response is downgraded to direct, source-supported observations only:",)


def answers(evidence: DataFrame, graded: DataFrame) -> DataFrame:
    """(query_id, decision, answer): refusal with three pieces of evidence, observations with five, else four snippets."""
    bullet = F.concat(F.lit("- ["), F.col("label"), F.lit("] "), short_snippet(F.col("text")))
    line = F.struct("rank", bullet.alias("line"))
    lists = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    x = graded.select("query_id", "confidence", "band", "decision").join(lists, "query_id", "left")
    bullets = lambda k: F.transform(F.slice(F.coalesce("lines", F.array().cast("array<struct<rank:int,line:string>>")), 1, k), lambda s: s["line"])
    tail = F.concat(F.lit("Confidence="), F.format_string("%.3f", F.round("confidence", 3)), F.lit(" ("), F.col("band"), F.lit("); decision="), F.col("decision"), F.lit("."))
    text = (
        F.when(F.col("decision") == "refuse", F.concat(F.array(*map(F.lit, REFUSAL)), bullets(3), F.array(tail)))
        .when(F.col("decision") == "downgrade", F.concat(F.array(*map(F.lit, DOWNGRADED)), bullets(5), F.array(tail)))
        .otherwise(bullets(4))
    )
    return x.select("query_id", "decision", F.array_join(text, "\n").alias("answer"))


def valid_tags(answer: Column, most: Column) -> Column:
    """Whether an answer cites evidence, and only evidence that exists ([S1] to [Sn])."""
    cited = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[S([0-9]+)\]"), F.lit(1))
    return (F.size(cited) > 0) & F.forall(cited, lambda k: k.cast("int").between(1, most))
