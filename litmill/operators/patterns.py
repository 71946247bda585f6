"""Phrases and sentence templates over sentences of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.rules import CATEGORIES, JUNK_WORDS, OTHER_CATEGORY, PHRASES, STARTER_WORDS, TEMPLATES
from litmill.functions.text import fast_sentences, plain_sentences, strip


def category_of(pattern: str) -> str:
    return next((name for name, words in CATEGORIES if any(w in pattern for w in words)), OTHER_CATEGORY)


def sentences(docs: DataFrame, key: str, text: str, fast: bool = True) -> DataFrame:
    """(key, pos, sentence) of every text."""
    cut = fast_sentences if fast else plain_sentences
    return docs.select(key, F.posexplode(cut(F.col(text))).alias("pos", "sentence"))


def _hits(sentence: Column, flags: str) -> Column:
    """array<struct<no, match>> of the phrases found: patterns are literals, compiled once, no join."""
    found = [F.when(sentence.rlike(flags + p), F.struct(F.lit(k).alias("no"), F.regexp_extract(sentence, flags + p, 0).alias("match"))) for k, p in enumerate(PHRASES)]
    return F.array_compact(F.array(*found))


def phrase_matches(s: DataFrame, key: str, lowered: bool = False) -> DataFrame:
    """(key, pos, no, match): the first match of each phrase in each sentence.

    lowered: the patterns, as written, are matched to the sentence in small letters, so that those
    with capitals never hit; else case does not matter.
    """
    hits = _hits(F.lower("sentence"), "") if lowered else _hits(F.col("sentence"), "(?i)")
    # explode() would have the optimizer test the array's size first, and so match every phrase twice
    return s.select(key, "pos", "sentence", F.explode_outer(hits).alias("h")).where("h is not null").select(key, "pos", "sentence", F.col("h.no").alias("no"), F.col("h.match").alias("match"))


def phrase_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, p, category_of(p)) for k, p in enumerate(PHRASES)], "no int, pattern string, category string")


def pattern_counts(matches: DataFrame) -> DataFrame:
    """(pattern, category, n) of sentences matched."""
    return matches.groupBy("no").agg(F.count("*").alias("n")).join(F.broadcast(phrase_table(matches.sparkSession)), "no").select("pattern", "category", "n")


def pattern_variants(matches: DataFrame) -> DataFrame:
    """(pattern, variant, n): matched wordings of 1 to 80 characters, in small letters."""
    v = F.lower(strip(F.col("match")))
    return matches.select("no", v.alias("variant")).where(F.length("variant").between(1, 80)).groupBy("no", "variant").agg(F.count("*").alias("n")).join(F.broadcast(phrase_table(matches.sparkSession)), "no").select("pattern", "variant", "n")


def pattern_examples(matches: DataFrame, source: str, most: int = 5) -> DataFrame:
    """(pattern, rank, example, source): the first distinct sentences of each phrase, in scan order."""
    from pyspark.sql import Window as W

    e = matches.select("no", F.substring("sentence", 1, 200).alias("example"), F.col(source).alias("source"), "pos")
    first = e.groupBy("no", "example", "source").agg(F.min(F.struct("source", "pos")).alias("at"))
    r = first.withColumn("rank", F.row_number().over(W.partitionBy("no").orderBy("at", "example"))).where(F.col("rank") <= most)
    return r.join(F.broadcast(phrase_table(matches.sparkSession)), "no").select("pattern", "rank", "example", "source")


def template_counts(s: DataFrame) -> DataFrame:
    """(template, n): sentences by the first template they begin with."""
    t = F.lit(None).cast("string")
    for p, name in reversed(TEMPLATES):
        t = F.when(F.col("sentence").rlike("(?i)" + p), F.lit(name)).otherwise(t)
    return s.select(t.alias("template")).where("template is not null").groupBy("template").agg(F.count("*").alias("n"))


def _junk(c: Column) -> Column:
    out = F.lit(False)
    for w in JUNK_WORDS:
        out |= c.contains(w)
    return out


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


ASCII = r"^[\x00-\x7F]*$"


def that_trigrams(s: DataFrame) -> DataFrame:
    """(phrase, n): two words and `that`, without digits, in sentences that are no boilerplate."""
    low = F.lower("sentence")
    w = s.where(~_junk(low) & low.contains(" that ") & low.rlike(ASCII)).select(_words(F.col("sentence")).alias("w"))
    grams = F.transform(F.col("w"), lambda x, k: F.when((x == "that") & (k >= 2), F.concat_ws(" ", F.get("w", k - 2), F.get("w", k - 1), x)))
    return w.select(F.explode(F.filter(grams, lambda g: g.isNotNull())).alias("phrase")).where(~F.col("phrase").rlike("[0-9]") & ~_junk(F.col("phrase"))).groupBy("phrase").agg(F.count("*").alias("n"))


def starters(s: DataFrame) -> DataFrame:
    """(phrase, n): the first three words of sentences, if a function word is among them and no initial."""
    low = F.lower("sentence")
    w = s.where(~_junk(low) & low.rlike(ASCII)).select(F.slice(_words(F.col("sentence")), 1, 3).alias("w")).where(F.size("w") == 3)
    ok = F.exists("w", lambda t: t.isin(*STARTER_WORDS)) & ~F.exists("w", lambda t: (F.length(t) == 1) & ~t.isin("a", "i"))
    g = w.where(ok).select(F.array_join("w", " ").alias("phrase")).where(~F.col("phrase").isin("in this paper", "the rest of") & ~_junk(F.col("phrase")))
    return g.groupBy("phrase").agg(F.count("*").alias("n"))


def discovered(s: DataFrame, n_docs: Column | int) -> DataFrame:
    """(template, n): phrases of both kinds with enough support, named by their kind."""
    g = that_trigrams(s).unionByName(starters(s)).groupBy("phrase").agg(F.sum("n").alias("n"))
    least = F.greatest(F.lit(5), F.floor(F.lit(n_docs) * 0.01))
    p = F.col("phrase")
    has = lambda *ws: F.greatest(*[F.contains(p, F.lit(f" {w} ")) for w in ws]) if len(ws) > 1 else F.contains(p, F.lit(f" {ws[0]} "))
    cat = F.when(has("show", "prove", "argue"), "ARGUMENT").when(has("implies", "suggests"), "ARGUMENT").when(has("we"), "METHOD/ACTION").when(has("result", "find"), "RESULT").otherwise("Other")
    return g.where(F.col("n") >= least).select(F.concat(F.lit("["), cat, F.lit("] "), p, F.lit("...")).alias("template"), "n")
