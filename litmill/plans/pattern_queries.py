"""Queries over phrases and sentence templates of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.rules import JUNK_WORDS, PHRASES, STARTER_WORDS, TEMPLATES
from litmill.operators import patterns as pt
from litmill.plans.catalog import query
from litmill.plans.library_queries import STRIP_SQL
from litmill.plans.text_queries import WS
from litmill.session import spread, table


def sentences(spark: SparkSession, d: str, fast: bool = True) -> DataFrame:
    return pt.sentences(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", fast)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MARK = "regexp_replace(translate(coalesce(text, ''), chr(10) || chr(13), '  '), '([.!?])" + WS + "+([A-Z])', '\\1' || chr(1) || '\\2', 'g')"
# a one-letter sentence would share its capital with the next cut; the marked text is cut twice
FAST = f"""raw AS (SELECT doc_id, string_split(regexp_replace({MARK}, '([.!?]){WS}+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM documents),
 parts AS (SELECT doc_id, generate_subscripts(parts, 1) AS k, unnest(parts) AS s0 FROM raw), trimmed AS (SELECT doc_id, k, {STRIP_SQL.format('s0')} AS sentence FROM parts),
 s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, sentence FROM trimmed WHERE length(sentence) BETWEEN 20 AND 500 AND regexp_matches(sentence, '[A-Za-z]')
  AND length(sentence) - length(replace(sentence, '=', '')) <= 3 AND length(sentence) - length(replace(sentence, '{{', '')) <= 2)"""
PLAIN = f"""raw AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents), parts AS (SELECT doc_id, generate_subscripts(parts, 1) AS k, unnest(parts) AS s0 FROM raw),
 trimmed AS (SELECT doc_id, k, {STRIP_SQL.format('s0')} AS sentence FROM parts), s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos, sentence FROM trimmed WHERE length(sentence) > 20)"""
TABLE = "p(no, pattern, category) AS (VALUES " + ", ".join(f"({k}, {_quoted(p)}, {_quoted(pt.category_of(p))})" for k, p in enumerate(PHRASES)) + ")"
JUNK = "(" + " OR ".join(f"contains({{0}}, {_quoted(w)})" for w in JUNK_WORDS) + ")"


@query(sql=f"WITH {FAST} SELECT doc_id, count(*) AS n, sum(length(sentence))::BIGINT AS chars FROM s GROUP BY 1")
def fast_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("sentence")).alias("chars"))


@query(sql=f"WITH {FAST}, {TABLE} SELECT pattern, category, count(*) AS n FROM s JOIN p ON regexp_matches(sentence, '(?i)' || pattern) GROUP BY ALL")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    return pt.pattern_counts(pt.phrase_matches(sentences(spark, d), "doc_id"))


@query(sql=f"WITH {FAST}, {TABLE}, m AS (SELECT pattern, lower({STRIP_SQL.format(chr(34) + 'x' + chr(34))}) AS variant FROM (SELECT pattern, regexp_extract(sentence, '(?i)' || pattern, 0) AS x FROM s JOIN p ON regexp_matches(sentence, '(?i)' || pattern))) SELECT pattern, variant, count(*) AS n FROM m WHERE length(variant) BETWEEN 1 AND 80 GROUP BY ALL")
def pattern_variants(spark: SparkSession, d: str) -> DataFrame:
    return pt.pattern_variants(pt.phrase_matches(sentences(spark, d), "doc_id"))


@query(sql=f"""WITH {FAST}, {TABLE}, m AS (SELECT no, pattern, left(sentence, 200) AS example, doc_id AS source, min(pos) AS pos FROM s JOIN p ON regexp_matches(sentence, '(?i)' || pattern) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY no ORDER BY source, pos, example) AS rank FROM m) SELECT pattern, rank, example, source FROM r WHERE rank <= 5""")
def pattern_examples(spark: SparkSession, d: str) -> DataFrame:
    return pt.pattern_examples(pt.phrase_matches(sentences(spark, d), "doc_id"), "doc_id")


@query(sql=f"WITH {PLAIN}, {TABLE} SELECT doc_id, pos, no, regexp_extract(lower(sentence), pattern, 0) AS match FROM s JOIN p ON regexp_matches(lower(sentence), pattern)")
def phrase_matches(spark: SparkSession, d: str) -> DataFrame:
    return pt.phrase_matches(sentences(spark, d, fast=False), "doc_id", lowered=True).drop("sentence")


@query(sql=f"WITH {FAST}, t AS (SELECT CASE {' '.join(f'WHEN regexp_matches(sentence, {_quoted(chr(40) + chr(63) + chr(105) + chr(41) + p)}) THEN {_quoted(n)}' for p, n in TEMPLATES)} END AS template FROM s) SELECT template, count(*) AS n FROM t WHERE template IS NOT NULL GROUP BY 1")
def structural_templates(spark: SparkSession, d: str) -> DataFrame:
    return pt.template_counts(sentences(spark, d))


THAT = f"""w AS (SELECT regexp_extract_all(lower(sentence), '[a-z0-9_]+') AS w FROM s WHERE NOT {JUNK.format('lower(sentence)')} AND contains(lower(sentence), ' that ') AND regexp_full_match(lower(sentence), '[\\x00-\\x7F]*')),
 g AS (SELECT w, generate_subscripts(w, 1) AS k, unnest(w) AS x FROM w), that AS (SELECT w[k - 2] || ' ' || w[k - 1] || ' that' AS phrase FROM g WHERE x = 'that' AND k >= 3),
 thats AS (SELECT phrase, count(*) AS n FROM that WHERE NOT regexp_matches(phrase, '[0-9]') AND NOT {JUNK.format('phrase')} GROUP BY 1)"""
START = f"""v AS (SELECT regexp_extract_all(lower(sentence), '[a-z0-9_]+')[1:3] AS w FROM s WHERE NOT {JUNK.format('lower(sentence)')} AND regexp_full_match(lower(sentence), '[\\x00-\\x7F]*')),
 st AS (SELECT array_to_string(w, ' ') AS phrase FROM v WHERE len(w) = 3 AND len(list_filter(w, lambda t: t IN ({', '.join(map(_quoted, STARTER_WORDS))}))) > 0 AND len(list_filter(w, lambda t: length(t) = 1 AND t NOT IN ('a', 'i'))) = 0),
 starts AS (SELECT phrase, count(*) AS n FROM st WHERE phrase NOT IN ('in this paper', 'the rest of') AND NOT {JUNK.format('phrase')} GROUP BY 1)"""


@query(sql=f"WITH {FAST}, {THAT} SELECT * FROM thats")
def trigram_that(spark: SparkSession, d: str) -> DataFrame:
    return pt.that_trigrams(sentences(spark, d))


@query(sql=f"WITH {FAST}, {START} SELECT * FROM starts")
def starters(spark: SparkSession, d: str) -> DataFrame:
    return pt.starters(sentences(spark, d))


@query(sql=f"""WITH {FAST}, {THAT}, {START}, u AS (SELECT phrase, sum(n)::BIGINT AS n FROM (FROM thats UNION ALL FROM starts) GROUP BY 1), c AS (SELECT greatest(5, floor(count(*) * 0.01)) AS least FROM documents)
SELECT '[' || CASE WHEN contains(phrase, ' show ') OR contains(phrase, ' prove ') OR contains(phrase, ' argue ') THEN 'ARGUMENT' WHEN contains(phrase, ' implies ') OR contains(phrase, ' suggests ') THEN 'ARGUMENT' WHEN contains(phrase, ' we ') THEN 'METHOD/ACTION'
 WHEN contains(phrase, ' result ') OR contains(phrase, ' find ') THEN 'RESULT' ELSE 'Other' END || '] ' || phrase || '...' AS template, n FROM u, c WHERE n >= least""")
def discovered_templates(spark: SparkSession, d: str) -> DataFrame:
    return pt.discovered(sentences(spark, d), table(spark, d, "documents").count())
