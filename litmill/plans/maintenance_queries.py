"""Queries over the upkeep of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions.rules import TITLE_JUNK, TITLE_STOPS
from litmill.operators import dedupe as dd
from litmill.operators import library as lib
from litmill.operators import maintenance as mt
from litmill.plans.catalog import query
from litmill.plans.dedupe_queries import COMPLETE, PAIR_KEYS, SCORED
from litmill.plans.library_queries import FLAG_SQL, MISSING_SQL, STRIP_SQL, TAGS_SQL, papers
from litmill.plans.text_queries import TOKENS
from litmill.session import spread, table
from litmill.sources import responses as rs

KEY = f"lower({STRIP_SQL.format('title')})"
LACKING = f"(authors IS NULL OR len(authors) = 0 OR (len(authors) = 1 AND {MISSING_SQL.format('authors[1]')}) OR {MISSING_SQL.format('published')} OR {MISSING_SQL.format('doi')} OR {MISSING_SQL.format('venue')})"
ANSWERS = f"""ans AS (SELECT {KEY} AS key, r.title AS a_title, authors AS a_authors, published AS a_published, doi AS a_doi, venue AS a_venue FROM resolved r LEFT JOIN paper_sources s ON s.source = r.source
 WHERE found AND {KEY} <> '' QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY coalesce(-trust, 0), result_no) = 1)"""
ONE = PAIR_KEYS + ", " + SCORED[: SCORED.index(" FROM r a JOIN r b")].split("\n c AS", 1)[1].join(["c AS", ""]) + " FROM n a JOIN n b ON a.ord <> b.ord AND substr(a.ord, 2)::BIGINT % 100 = 0)" + SCORED[SCORED.index(",\n t AS") :]


def answers(spark: SparkSession, d: str) -> DataFrame:
    """The answers of outside sources, the most trusted first."""
    trust = table(spark, d, "paper_sources").select("source", (-F.col("trust")).alias("priority"))
    return table(spark, d, "resolved").join(trust, "source", "left").fillna({"priority": 0}).withColumnRenamed("result_no", "ord")


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """The records with an id divisible by 100 stand for newly added ones."""
    return papers(spark, d).where("cast(substring(paper_id, 2) as bigint) % 100 = 0")


@query(sql=f"""WITH {ANSWERS}, p AS (SELECT *, {KEY} AS key FROM papers)
SELECT paper_id, CASE WHEN {MISSING_SQL.format('published')} AND NOT {MISSING_SQL.format('a_published')} THEN a_published ELSE published END AS published,
 CASE WHEN {MISSING_SQL.format('venue')} AND NOT {MISSING_SQL.format('a_venue')} THEN a_venue ELSE venue END AS venue,
 len(CASE WHEN (authors IS NULL OR len(authors) = 0 OR (len(authors) = 1 AND {MISSING_SQL.format('authors[1]')})) AND NOT (a_authors IS NULL OR len(a_authors) = 0 OR (len(a_authors) = 1 AND {MISSING_SQL.format('a_authors[1]')})) THEN a_authors ELSE authors END)::INTEGER AS authors
FROM p JOIN ans USING (key) WHERE {LACKING}""")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    """The papers that take fields from an answer."""
    return mt.with_metadata(papers(spark, d), answers(spark, d)).where("updated").select("paper_id", "published", "venue", F.size("authors").alias("authors"))


@query(sql=f"""WITH {ANSWERS}, p AS (SELECT *, {KEY} AS key FROM papers WHERE authors IS NULL OR len(authors) = 0 OR array_to_string(authors, ', ') IN ('Unknown', 'None', '') OR published IS NULL OR published IN ('Unknown', 'None', '')
 OR doi IS NULL OR doi IN ('Unknown', 'None', '') OR venue IS NULL OR venue IN ('Unknown', 'None', '')), j AS (SELECT paper_id, {TOKENS.format('a_title')} AS w, list_distinct({TOKENS.format('documents')}) AS b FROM p LEFT JOIN ans USING (key))
SELECT paper_id, len(w) > 0 AND len(list_filter(w, lambda x: list_contains(b, x))) / greatest(1, len(w)) >= 0.6 AS success FROM j""")
def enrich_report(spark: SparkSession, d: str) -> DataFrame:
    return mt.enrichment_report(lib.needs_enrichment(papers(spark, d)), answers(spark, d))


@query(sql=f"WITH {ONE} SELECT paper_a, paper_b, round(total, 4) AS combined_score FROM s WHERE round(total, 4) >= 0.84")
def one_vs_all(spark: SparkSession, d: str) -> DataFrame:
    """The records with an id divisible by 100, each scored against all others without the sequence ratio."""
    keys = dd.pair_keys(papers(spark, d), "paper_id")
    mine = keys.join(seeds(spark, d).select(F.col("paper_id").alias("ord")), "ord", "left_semi")
    return mt.one_against_all(mine, keys, sequence=False).select("paper_a", "paper_b", "combined_score")


@query(sql=f"""WITH {ANSWERS}, {ONE}, w AS (SELECT paper_id, coalesce(nullif(canonical_id, ''), nullif(entry_id, ''), title, '') AS who FROM papers),
o AS (SELECT paper_a AS paper_id, count(DISTINCT b.who) AS removed FROM s JOIN w a ON a.paper_id = paper_a JOIN w b ON b.paper_id = paper_b WHERE round(total, 4) >= 0.84 AND a.who <> b.who GROUP BY 1),
x AS (SELECT paper_id, {KEY} AS key, {LACKING} AS lacking, count(*) OVER (PARTITION BY {KEY}) AS n FROM papers)
SELECT x.paper_id, CASE WHEN lacking AND key IN (SELECT key FROM ans) THEN n ELSE 0 END AS metadata_updates, (coalesce(removed, 0) > 0)::INTEGER AS dedupe_groups, coalesce(removed, 0) AS dedupe_removed, n AS reindexed_chunks
FROM x LEFT JOIN o ON o.paper_id = x.paper_id WHERE key <> '' AND substr(x.paper_id, 2)::BIGINT % 100 = 0""")
def incremental_maintenance(spark: SparkSession, d: str) -> DataFrame:
    """The upkeep after each of the seeds was added, duplicates scored without the sequence ratio."""
    p = papers(spark, d)
    return mt.maintenance_report(seeds(spark, d).select("paper_id", "title"), p, answers(spark, d), dd.pair_keys(p, "paper_id"), sequence=False)


@query(sql=f"""
WITH p AS (SELECT *, {COMPLETE} AS score FROM papers), k AS (SELECT canonical_id, arg_min(paper_id, (-score, paper_id)) AS keep, count(*) AS n, bool_or({FLAG_SQL.format('is_favorite')}) AS fav, bool_or(coalesce(in_reading_list, false)) AS rl,
 arg_min(doi, paper_id) FILTER (NOT {MISSING_SQL.format('doi')}) AS fdoi, arg_min(venue, paper_id) FILTER (NOT {MISSING_SQL.format('venue')}) AS fvenue FROM p WHERE canonical_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT p.paper_id, CASE WHEN n IS NULL THEN doi WHEN NOT {MISSING_SQL.format('doi')} THEN doi ELSE fdoi END AS doi, CASE WHEN n IS NULL THEN venue WHEN NOT {MISSING_SQL.format('venue')} THEN venue ELSE fvenue END AS venue,
 CASE WHEN n IS NULL THEN is_favorite ELSE fav::VARCHAR END AS is_favorite, CASE WHEN n IS NULL THEN in_reading_list ELSE rl END AS in_reading_list
FROM p LEFT JOIN k ON k.canonical_id = p.canonical_id WHERE n IS NULL OR p.paper_id = keep""")
def merge_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The library after all groups of a canonical id are merged."""
    return mt.merge_duplicates(papers(spark, d), "canonical_id", "paper_id").select("paper_id", "doi", "venue", "is_favorite", "in_reading_list")


JUNK = " AND ".join(f"NOT contains(lower(x), '{w}')" for w in TITLE_JUNK)


@query(sql=rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10))[1:20], lambda x: {STRIP_SQL.format('x')}), lambda x: length(x) >= 3 AND {JUNK}) AS l FROM documents),
s AS (SELECT doc_id, l, list_position(list_transform(l, lambda x: contains(lower(x), '{TITLE_STOPS[0]}') OR starts_with(lower(x), '{TITLE_STOPS[1]}')), true) AS k FROM l),
g AS (SELECT doc_id, list_filter(CASE WHEN coalesce(k, 0) > 0 THEN l[1:k - 1] ELSE l END, lambda x: NOT (regexp_full_match(x, '[A-Za-z0-9_\-.:\s,]+') AND length(regexp_replace(x, '[^0-9]', '', 'g')) > length(x) * 0.4)) AS g FROM s)
SELECT doc_id, array_to_string(list_filter([g[1], CASE WHEN len(g) > 1 THEN array_to_string(g[1:2], ' ') END, CASE WHEN len(g) > 2 THEN replace(array_to_string(g[1:4], ' '), '*', '') END], lambda x: x IS NOT NULL), ' ## ') AS candidates FROM g""")
def title_candidates(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.array_join(mt.title_candidates(F.col("text")), " ## ").alias("candidates"))


@query(sql="WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS k, (SELECT count(*) FROM events) AS n FROM events) SELECT event_id FROM n WHERE k % greatest(1, n // least(n, 5000)) = 0")
def sampled(spark: SparkSession, d: str) -> DataFrame:
    return mt.systematic_sample(table(spark, d, "events").select("event_id"), "event_id")


@query(sql="SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def seen_first(spark: SparkSession, d: str) -> DataFrame:
    return mt.first_seen(table(spark, d, "events"), ["user_id", "event_type"], "event_id")


PLAIN = "regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g')"


@query(sql=f"WITH k AS (SELECT {PLAIN} AS key, min(ref_id) AS ref_id FROM external_ref_info GROUP BY 1) SELECT paper_id, ref_id FROM papers JOIN k ON key = {PLAIN} WHERE key NOT IN ('', 'unknown') AND NOT {MISSING_SQL.format('title')}")
def external_ids(spark: SparkSession, d: str) -> DataFrame:
    return mt.external_ids(papers(spark, d), table(spark, d, "external_ref_info"))


@query(sql="SELECT DISTINCT src, dst FROM citation_edges WHERE src IS NOT NULL AND dst IS NOT NULL")
def citation_responses(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a citation service made of the edges, and read back as edges."""
    e = table(spark, d, "citation_edges").where("src is not null")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("dst").alias("paperId")).alias("citedPaper"))).alias("data")))
    return rs.cited_works(e.select(F.col("src").alias("paper_id"), body.alias("body"))).select("src", "dst").distinct()


@query(sql="SELECT result_no::VARCHAR AS entry_id, title, coalesce(array_to_string(list_transform(list_filter(authors, lambda a: a IS NOT NULL), lambda a: regexp_replace(a, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')), '|'), '') AS authors FROM resolved WHERE found AND title IS NOT NULL AND trim(title) <> ''".replace("title, coalesce", "regexp_replace(regexp_replace(title, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), '^ +| +$', '', 'g') AS title, coalesce"))
def arxiv_feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed made of the resolved answers, an entry each, and flattened."""
    text = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    r = table(spark, d, "resolved").where("found and title is not null and trim(title) <> ''")
    people = F.array_join(F.transform(F.filter(F.coalesce("authors", F.array().cast("array<string>")), lambda a: a.isNotNull()), lambda a: F.concat(F.lit("<author><name>"), text(a), F.lit("</name></author>"))), "")
    entry = F.concat(F.lit("<entry><id>"), F.col("result_no").cast("string"), F.lit("</id><title>"), text(F.col("title")), F.lit("</title>"), people, F.lit("</entry>"))
    return rs.arxiv(r.select(F.concat(F.lit("<feed>"), entry, F.lit("</feed>")).alias("body"))).select("entry_id", "title", F.array_join("authors", "|").alias("authors"))
