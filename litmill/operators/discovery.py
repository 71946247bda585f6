"""Searching by article: queries taken from a text, their ranking, topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litmill.functions.rules import ACADEMIC_WORDS, STOPWORDS
from litmill.functions.text import content_tokens, strip


def scored_terms(docs: DataFrame, key: str, text: str, seeds: int = 20) -> DataFrame:
    """(key, term, tf, score, rank): the terms of each text by count and dominance in its beginning, body or end."""
    t = strip(F.coalesce(F.col(text), F.lit("")))
    n = F.length(t)
    a, b = F.floor(n * 0.2).cast("int"), F.floor(n * 0.8).cast("int")
    parts = F.array(F.substring(t, F.lit(1), a), F.substring(t, a + 1, b - a), F.substring(t, b + 1, n - b))
    d = docs.where(F.length(strip(F.col(text))) >= 50).select(key, F.posexplode(parts).alias("sec", "part"), content_tokens(t).alias("all"))
    sec = d.select(key, "sec", F.explode(content_tokens(F.col("part"))).alias("term")).groupBy(key, "sec", "term").agg(F.count("*").alias("c"))
    w = W.partitionBy(key, "sec")
    freq = sec.withColumn("sf", F.col("c") / F.sum("c").over(w)).groupBy(key, "term").agg(F.max("sf").alias("sf"))
    tf = d.where("sec = 0").select(key, F.explode("all").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    g = tf.withColumn("gf", F.col("tf") / F.sum("tf").over(W.partitionBy(key)))
    s = g.join(freq, [key, "term"], "left").withColumn("score", F.round(F.col("tf") * F.coalesce("sf", F.lit(0.0)) / F.col("gf"), 6))
    return s.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "term"))).where(F.col("rank") <= seeds).select(key, "term", "tf", "score", "rank")


def article_queries(docs: DataFrame, key: str, text: str, n: int = 3) -> DataFrame:
    """(key, pos, query): n search phrases of each text: three and two words from a seed on weigh more, and each adds a new word."""
    seeds = scored_terms(docs, key, text)
    seed_set = seeds.groupBy(key).agg(F.collect_set("term").alias("seeds"))
    words = docs.select(key, text).join(seed_set, key).select(key, "seeds", F.transform(F.regexp_extract_all(F.col(text), F.lit("[A-Za-z][a-z]+"), F.lit(0)), F.lower).alias("w"))
    fine = lambda x: ~x.isin(*STOPWORDS, *ACADEMIC_WORDS) & (F.length(x) >= 4)
    grams = words.select(key, "w", "seeds", F.posexplode("w").alias("i", "w1")).where(F.array_contains("seeds", F.col("w1"))).select(key, "w1", F.get("w", F.col("i") + 1).alias("w2"), F.get("w", F.col("i") + 2).alias("w3"))
    two = grams.where(fine(F.col("w2")))
    count = lambda df, cols, weight, most: df.groupBy(key, *cols).agg(F.count("*").alias("c")).withColumn("phrase", F.concat_ws(" ", *cols)).withColumn("_nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc("c"), "phrase"))).where(F.col("_nth") <= most).select(key, (F.col("c") * weight).cast("double").alias("s"), "phrase")
    candidates = count(two.where(fine(F.col("w3"))), ["w1", "w2", "w3"], 3, 10).unionByName(count(two, ["w1", "w2"], 2, 15)).unionByName(seeds.select(key, F.col("score").alias("s"), F.col("term").alias("phrase")))
    # greedy cover over at most 45 candidates a text
    ordered = candidates.groupBy(key).agg(F.reverse(F.array_sort(F.collect_list(F.struct("s", "phrase")))).alias("c"))
    picked = F.aggregate(
        "c", F.struct(F.array().cast("array<string>").alias("q"), F.array().cast("array<string>").alias("seen")),
        lambda s, c: F.when((F.size(s["q"]) < n) & (F.size(F.array_except(F.split(c["phrase"], " "), s["seen"])) > 0), F.struct(F.concat(s["q"], F.array(c["phrase"])).alias("q"), F.array_union(s["seen"], F.split(c["phrase"], " ")).alias("seen"))).otherwise(s),
        lambda s: s["q"],
    )
    return ordered.select(key, F.posexplode(picked).alias("pos", "query"))


def topic_clusters(vectors: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """(vec_id, cluster, x, y): clusters of unit vectors, and two principal components to draw them.

    Approximate by design: bisecting k-means stands for density clustering. Fewer than three vectors
    are one cluster of -1.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("raw"))
    if v.limit(3).count() < 3:
        return v.select("vec_id", F.lit(-1).alias("cluster"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    unit = Normalizer(inputCol="raw", outputCol="unit").transform(v)
    labelled = BisectingKMeans(featuresCol="unit", predictionCol="cluster", k=k, seed=seed).fit(unit).transform(unit)
    drawn = PCA(k=2, inputCol="unit", outputCol="pc").fit(labelled).transform(labelled)
    xy = vector_to_array("pc")
    return drawn.select("vec_id", "cluster", F.round(F.get(xy, 0), 6).alias("x"), F.round(F.get(xy, 1), 6).alias("y"))


def cluster_summary(clusters: DataFrame, titles: DataFrame) -> DataFrame:
    """(cluster, size, titles): the size and the first five titles of each cluster."""
    t = clusters.join(titles, "vec_id", "left").withColumn("rn", F.row_number().over(W.partitionBy("cluster").orderBy("vec_id")))
    g = t.groupBy("cluster").agg(F.count("*").alias("size"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= 5, F.struct("rn", "title")))), lambda x: x["title"]).alias("ts"))
    more = F.when(F.col("size") > 5, F.concat(F.lit("... and "), (F.col("size") - 5).cast("string"), F.lit(" more")))
    return g.select("cluster", "size", F.concat_ws("; ", F.array_join("ts", "; "), more).alias("titles"))
