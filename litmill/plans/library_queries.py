"""Queries over the library: roll-up, filters, look-ups, changes, novelty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import text as tx
from litmill.operators import library as lib
from litmill.plans.catalog import query
from litmill.session import table

MISSING_SQL = "({0} IS NULL OR lower(regexp_replace({0}, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g')) IN ('', 'unknown', 'none', 'null'))"
STRIP_SQL = "regexp_replace({0}, '^[ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+$', '', 'g')"
NORM_SQL = "regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]', '', 'g')"
YEAR_SQL = "CAST(nullif(regexp_extract({0}, '([0-9]{{4}})', 1), '') AS INTEGER)"
FLAG_SQL = f"coalesce({STRIP_SQL.format('lower({0})')} IN ('1', 'true', 'yes', 'y', 'on'), false)"
TAGS_SQL = f"list_filter(list_transform(regexp_split_to_array(coalesce({{0}}, ''), '[;,]'), lambda t: {STRIP_SQL.format('t')}), lambda t: t <> '')"


def papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers")


@query(sql=f"""
WITH c AS (SELECT *, paper_id AS ord, {TAGS_SQL.format('tags')} AS tl FROM papers),
t AS (SELECT title, ord, generate_subscripts(tl, 1) AS k, unnest(tl) AS tag FROM c),
f AS (SELECT title, lower(tag) AS low, min({{'o': ord, 'k': k, 't': tag}}) AS x FROM t GROUP BY ALL),
g AS (SELECT title, string_agg(x.t, ', ' ORDER BY x.o, x.k) AS tags FROM f GROUP BY title)
SELECT c.title, min(ord) AS first_ord, count(*) AS chunk_count, arg_min(coalesce(doi, chr(0)), ord) AS doi, arg_min(coalesce(source, chr(0)), ord) AS source,
  arg_min(coalesce(published, chr(0)), ord) AS published, arg_min(venue, ord) FILTER (coalesce(venue, '') <> '') AS venue, bool_or({FLAG_SQL.format('is_favorite')}) AS is_favorite,
  bool_or(coalesce(in_reading_list, false)) AS in_reading_list, max(coalesce(parse_pages, 0)) AS parse_pages, max(coalesce(parse_ocr_pages, 0)) AS parse_ocr_pages,
  coalesce(max(g.tags), '') AS tags
FROM c LEFT JOIN g ON g.title IS NOT DISTINCT FROM c.title GROUP BY c.title
""")
def paper_rollup(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d).withColumns({"ord": F.col("paper_id"), "parse_quality_score": F.lit(None).cast("double"), "parse_quality_label": F.lit(None).cast("string")})
    # chr(0) stands for null in the comparison with the oracle: its first-by-order skips nulls
    p = p.withColumns({c: F.coalesce(c, F.lit("\0")) for c in ("doi", "source", "published")})
    return lib.roll_up(p).drop("parse_quality_score", "parse_quality_label")


@query(sql=f"""
SELECT paper_id FROM papers WHERE ({YEAR_SQL.format('published')} IS NULL OR {YEAR_SQL.format('published')} BETWEEN 1995 AND 2010) AND source = 'crosslist'
AND lower(array_to_string(authors, ', ')) LIKE '%an%'
""")
def library_filter(spark: SparkSession, d: str) -> DataFrame:
    return lib.filter_library(papers(spark, d), (1995, 2010), "crosslist", "an").select("paper_id")


@query(sql=f"""
SELECT paper_id FROM papers WHERE lower(tags) LIKE '%data%' AND ({FLAG_SQL.format('is_favorite')} OR true) AND coalesce(in_reading_list, false)
""")
def reading_list_filter(spark: SparkSession, d: str) -> DataFrame:
    return lib.filter_library(papers(spark, d), tag="Data", reading=True).select("paper_id")


@query(sql=f"""
SELECT 'year_min' AS facet, CAST(min({YEAR_SQL.format('published')}) AS VARCHAR) AS value FROM papers
UNION ALL SELECT 'year_max', CAST(max({YEAR_SQL.format('published')}) AS VARCHAR) FROM papers
UNION ALL SELECT DISTINCT 'source', source FROM papers WHERE coalesce(source, '') <> ''
""")
def facets(spark: SparkSession, d: str) -> DataFrame:
    return lib.facets(papers(spark, d))


@query(sql="SELECT paper_id FROM papers WHERE documents IS NULL OR trim(documents) IN ('', 'Unknown', 'None')")
def missing_summary(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).where(F.col("documents").isNull() | F.trim("documents").isin("", "Unknown", "None")).select("paper_id")


@query(sql=f"""
SELECT paper_id FROM papers WHERE (authors IS NULL OR len(authors) = 0 OR (len(authors) = 1 AND {MISSING_SQL.format('authors[1]')}))
OR {MISSING_SQL.format('published')} OR {MISSING_SQL.format('doi')} OR {MISSING_SQL.format('venue')}
""")
def needs_fix(spark: SparkSession, d: str) -> DataFrame:
    return lib.needs_fix(papers(spark, d)).select("paper_id")


@query(sql="""
SELECT paper_id FROM papers WHERE authors IS NULL OR len(authors) = 0 OR array_to_string(authors, ', ') IN ('Unknown', 'None', '') OR published IS NULL OR published IN ('Unknown', 'None', '')
OR doi IS NULL OR doi IN ('Unknown', 'None', '') OR venue IS NULL OR venue IN ('Unknown', 'None', '') OR coalesce(entry_id LIKE 'manual\\_%' ESCAPE '\\', false) OR coalesce(source LIKE '%.pdf', false)
""")
def needs_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return lib.needs_enrichment(papers(spark, d), recheck=True).select("paper_id")


@query(sql=f"""
WITH w AS (SELECT DISTINCT lower({STRIP_SQL.format('title')}) AS title_key FROM resolved WHERE title IS NOT NULL)
SELECT title_key, min(paper_id) AS paper_id FROM w JOIN papers ON lower({STRIP_SQL.format('title')}) = title_key GROUP BY 1
""")
def lookup_titles(spark: SparkSession, d: str) -> DataFrame:
    return lib.lookup(papers(spark, d), table(spark, d, "resolved").where("title is not null"))


@query(sql="SELECT count(DISTINCT title) AS papers, count(*) AS chunks FROM papers")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).agg(F.count_distinct("title").alias("papers"), F.count("*").alias("chunks"))


@query(sql="SELECT r.result_no, EXISTS (SELECT 1 FROM papers p WHERE p.doi = r.doi) AS known FROM resolved r WHERE r.doi IS NOT NULL")
def existence_probe(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resolved").where("doi is not null").select("result_no", "doi")
    known = papers(spark, d).select(F.col("doi").alias("k")).where("k is not null").distinct()
    return r.join(known, r.doi == known.k, "left").select("result_no", F.col("k").isNotNull().alias("known"))


@query(sql="SELECT paper_id, title, source FROM papers WHERE title = 'Editorial'")
def point_scan(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).where(F.col("title") == "Editorial").select("paper_id", "title", "source")


@query(sql=f"""
SELECT paper_id, k - 1 AS pos, tag FROM (
  SELECT paper_id, generate_subscripts(tl, 1) AS k, unnest(tl) AS tag, tl FROM (SELECT paper_id, {TAGS_SQL.format('tags')} AS tl FROM papers))
WHERE list_position(list_transform(tl, lambda x: lower(x)), lower(tag)) = k
QUALIFY true
""".replace("QUALIFY true\n", "").replace("k - 1 AS pos, tag", "row_number() OVER (PARTITION BY paper_id ORDER BY k) - 1 AS pos, tag"))
def tags_parsed(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("paper_id", F.posexplode(tx.parse_tags(F.col("tags"))).alias("pos", "tag"))


@query(sql=f"SELECT {FLAG_SQL.format('is_favorite')} AS favorite, count(*) AS n FROM papers GROUP BY 1")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).groupBy(tx.to_flag(F.col("is_favorite")).alias("favorite")).agg(F.count("*").alias("n"))


@query(sql=r"""
WITH q AS (SELECT paper_id, regexp_replace(coalesce(doi, ''), '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g') AS t FROM papers)
SELECT paper_id, (regexp_matches(lower(t), '^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$') OR (starts_with(lower(t), '10.') AND contains(t, '/')) OR contains(lower(t), 'arxiv:') OR contains(lower(t), 'doi:')) AS is_identifier FROM q
""")
def identifier_predicate(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("paper_id", tx.looks_like_identifier(F.col("doi")).alias("is_identifier"))


@query(sql="SELECT paper_id, title, CASE WHEN canonical_id LIKE 'arxiv:%' THEN 'preprint' ELSE venue END AS venue, CASE WHEN canonical_id LIKE 'arxiv:%' THEN 'arXiv' ELSE source END AS source FROM papers")
def update_overlay(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d).select("paper_id", "title", "venue", "source", "canonical_id")
    return lib.overlay(p, F.startswith(F.col("canonical_id"), F.lit("arxiv:")), venue=F.lit("preprint"), source=F.lit("arXiv")).drop("canonical_id")


@query(sql="SELECT paper_id FROM papers WHERE canonical_id IS NULL OR canonical_id NOT IN (SELECT paper_a FROM duplicate_pairs WHERE paper_a IS NOT NULL)")
def delete_matching(spark: SparkSession, d: str) -> DataFrame:
    return lib.delete(papers(spark, d), table(spark, d, "duplicate_pairs").select(F.col("paper_a").alias("canonical_id")), "canonical_id").select("paper_id")


@query(sql="""
WITH n AS (SELECT title, max(venue) AS venue, max(published) AS published FROM resolved WHERE title IS NOT NULL GROUP BY 1),
o AS (SELECT title, max(venue) AS venue, max(published) AS published FROM papers WHERE title IS NOT NULL GROUP BY 1)
SELECT coalesce(n.title, o.title) AS title, CASE WHEN n.title IS NOT NULL THEN n.venue ELSE o.venue END AS venue, CASE WHEN n.title IS NOT NULL THEN n.published ELSE o.published END AS published
FROM o FULL OUTER JOIN n ON o.title = n.title
""")
def upsert_titles(spark: SparkSession, d: str) -> DataFrame:
    one = lambda t: table(spark, d, t).where("title is not null").groupBy("title").agg(F.max("venue").alias("venue"), F.max("published").alias("published"))
    return lib.upsert(one("papers"), one("resolved"), "title", ["venue", "published"])


@query(sql=f"""
SELECT result_no FROM resolved r WHERE found
AND (coalesce(doi, '') IN ('Unknown', '', 'None') OR lower({STRIP_SQL.format('doi')}) NOT IN (SELECT lower({STRIP_SQL.format('doi')}) FROM papers WHERE coalesce(doi, '') NOT IN ('Unknown', '', 'None')))
AND {NORM_SQL.format('title')} NOT IN (SELECT {NORM_SQL.format('title')} FROM papers WHERE {NORM_SQL.format('title')} <> '')
""")
def novelty_anti(spark: SparkSession, d: str) -> DataFrame:
    return lib.novel(table(spark, d, "resolved").where("found"), papers(spark, d)).select("result_no")


@query(sql=f"""
SELECT result_no FROM (SELECT result_no FROM resolved r WHERE found
AND {NORM_SQL.format('title')} NOT IN (SELECT {NORM_SQL.format('title')} FROM papers WHERE {NORM_SQL.format('title')} <> '')
AND (coalesce(doi, '') IN ('Unknown', '', 'None') OR lower({STRIP_SQL.format('doi')}) NOT IN (SELECT lower({STRIP_SQL.format('doi')}) FROM papers WHERE coalesce(doi, '') NOT IN ('Unknown', '', 'None')))
ORDER BY result_no LIMIT 25)
""")
def batch_import_cap(spark: SparkSession, d: str) -> DataFrame:
    """The first 25 novel answers: the cap is the feature of a batch import."""
    return lib.novel(table(spark, d, "resolved").where("found"), papers(spark, d)).orderBy("result_no").limit(25).select("result_no")


@query(sql="SELECT source, count(*) AS total, count(*) FILTER (documents IS NOT NULL) AS ingested, count(*) FILTER (documents IS NULL) AS skipped FROM papers GROUP BY source")
def ingest_report(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("documents").isNotNull()).alias("ingested"), F.count_if(F.col("documents").isNull()).alias("skipped"))
