"""Queries over duplicates: results, pairs, groups, merged records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.operators import dedupe as dd
from litmill.plans.catalog import query
from litmill.plans.library_queries import FLAG_SQL, MISSING_SQL, NORM_SQL, STRIP_SQL, TAGS_SQL, YEAR_SQL, papers
from litmill.plans.text_queries import TOKENS, WS
from litmill.session import table


@query(sql=f"""
WITH r AS (SELECT result_no, CASE WHEN lower({STRIP_SQL.format("coalesce(doi, '')")}) <> '' THEN 'doi:' || lower({STRIP_SQL.format('doi')}) ELSE 'title:' || {NORM_SQL.format('title')} END AS key,
 round((CASE WHEN coalesce(source, '') <> '' AND contains(source, 'open') THEN 2.0 ELSE 0.0 END + least(length(coalesce(title, '')) / 200.0, 2.0) + CASE WHEN coalesce(published, '') <> '' AND published <> 'Unknown' THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS score FROM resolved WHERE found)
SELECT key, arg_max(result_no, (score, -result_no)) AS result_no, max(score) AS score, min(result_no) AS first_ord FROM r GROUP BY key
""")
def result_dedupe(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resolved").where("found").withColumns({"summary": F.col("title"), "pdf_url": F.when(F.contains(F.col("source"), F.lit("open")), F.col("source"))})
    return dd.dedupe_results(r, "result_no").select("key", "result_no", "score", "first_ord")


PAIR_KEYS = rf"""n AS (SELECT paper_id AS ord, {NORM_SQL.format('title')} AS norm, list_sort(list_distinct({TOKENS.format('title')})) AS toks,
 list_sort(list_distinct(list_filter(list_transform(coalesce(authors, []), lambda a: regexp_replace(lower(CASE WHEN contains(a, ',') THEN string_split(a, ',')[1] ELSE coalesce(list_filter(regexp_split_to_array({STRIP_SQL.format('a')}, '{WS}+'), lambda w: w <> '')[-1], '') END), '[^a-z0-9]', '', 'g')), lambda w: w <> ''))) AS names,
 {YEAR_SQL.format('published')} AS year, lower({STRIP_SQL.format("coalesce(doi, '')")}) AS doi, coalesce(canonical_id, '') AS cid FROM papers WHERE {NORM_SQL.format('title')} <> '')"""
SCORED = f"""r AS (SELECT min(ord) AS ord, norm, toks, names, year, doi, cid FROM n GROUP BY norm, toks, names, year, doi, cid),
 c AS (SELECT a.ord AS paper_a, b.ord AS paper_b, a.toks AS ta, b.toks AS tb, a.names AS na, b.names AS nb, a.year AS ya, b.year AS yb, a.doi AS da, b.doi AS db, a.cid AS ca, b.cid AS cb
 FROM r a JOIN r b ON a.ord < b.ord AND (a.doi = b.doi AND a.doi NOT IN ('', 'unknown', 'none', 'null', 'n/a', 'na', '-') OR left(a.norm, 1) = left(b.norm, 1))),
 t AS (SELECT *, CASE WHEN len(ta) > 0 AND len(tb) > 0 THEN len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb))) ELSE 0.0 END AS t, CASE WHEN len(na) > 0 AND len(nb) > 0 THEN len(list_intersect(na, nb)) / (len(na) + len(nb) - len(list_intersect(na, nb))) ELSE 0.0 END AS au,
  CASE WHEN ya > 0 AND yb > 0 THEN CASE abs(ya - yb) WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.0 END ELSE 0.0 END AS y, da <> '' AND da = db AND da NOT IN ('unknown', 'none', 'null', 'n/a', 'na', '-') AS sd, ca <> '' AND ca = cb AS sc FROM c),
 s AS (SELECT *, least(1.0, 0.65 * t + 0.25 * au + 0.10 * y + greatest(CASE WHEN sd THEN 0.25 ELSE 0.0 END, CASE WHEN sc THEN 0.30 ELSE 0.0 END)) AS total FROM t)"""


@query(sql=f"""
WITH {PAIR_KEYS}, {SCORED}
SELECT paper_a, paper_b, round(t, 4) AS title_similarity, round(au, 4) AS author_similarity, round(y, 4) AS year_similarity, round(total, 4) AS combined_score,
 array_to_string(list_filter([CASE WHEN sd THEN 'exact_doi' END, CASE WHEN sc THEN 'exact_canonical_id' END, CASE WHEN t >= 0.92 THEN 'title_near_exact' END, CASE WHEN au >= 0.6 THEN 'author_overlap' END, CASE WHEN y >= 0.7 THEN 'year_close' END], lambda r: r IS NOT NULL), ',') AS reasons
FROM s WHERE total >= 0.84
""")
def dup_pairs_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives scored without the sequence ratio, at the threshold of the duplicate scan."""
    pairs = dd.candidate_pairs(dd.representatives(dd.pair_keys(papers(spark, d), "paper_id")), 0.84)
    return dd.score_pairs(pairs, sequence=False).where("combined_score >= 0.84")


@query()
def dup_pairs_full(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of class representatives scored with the sequence ratio too, at the threshold of the duplicate scan."""
    pairs = dd.full_pairs(dd.representatives(dd.pair_keys(papers(spark, d), "paper_id")), 0.84)
    return dd.score_pairs(pairs).where("combined_score >= 0.84")


@query(sql=f"WITH {PAIR_KEYS} SELECT ord AS paper_id, min(ord) OVER (PARTITION BY norm, toks, names, year, doi, cid) AS class_id FROM n")
def dup_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of each record with a title: records alike in all that pairs are judged by."""
    return dd.duplicate_classes(dd.pair_keys(papers(spark, d), "paper_id")).select(F.col("ord").alias("paper_id"), "class_id")


GROUPS = """e AS (SELECT DISTINCT paper_a AS a, paper_b AS b FROM duplicate_pairs WHERE paper_a IS NOT NULL AND paper_b IS NOT NULL AND paper_a <> paper_b),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS member, a AS reach FROM u UNION SELECT r.member, u.b FROM r JOIN u ON r.reach = u.a),
g AS (SELECT member, min(reach) AS group_id FROM r GROUP BY member)"""


@query(sql=f"WITH RECURSIVE {GROUPS} SELECT member, group_id FROM g")
def dup_components(spark: SparkSession, d: str) -> DataFrame:
    """Groups of the ids as the pairs write them."""
    return dd.group_pairs(table(spark, d, "duplicate_pairs"), "paper_a", "paper_b")


COMPLETE = f"(CASE WHEN NOT {MISSING_SQL.format('doi')} THEN 10 ELSE 0 END + CASE WHEN NOT {MISSING_SQL.format('published')} THEN 5 ELSE 0 END + CASE WHEN len(coalesce(authors, [])) > 0 THEN 5 ELSE 0 END + CASE WHEN NOT {MISSING_SQL.format('venue')} THEN 2 ELSE 0 END + CASE WHEN {FLAG_SQL.format('is_favorite')} THEN 1 ELSE 0 END + CASE WHEN coalesce(in_reading_list, false) THEN 1 ELSE 0 END)"


@query(sql=f"SELECT paper_id, {COMPLETE} AS completeness FROM papers")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    return p.select("paper_id", dd.completeness(p).alias("completeness"))


@query(sql=f"""
WITH p AS (SELECT *, {COMPLETE} AS score FROM papers WHERE canonical_id IS NOT NULL),
b AS (SELECT canonical_id, count(*) AS members, arg_min(paper_id, (-score, paper_id)) AS keep, max(score) AS completeness, bool_or({FLAG_SQL.format('is_favorite')}) AS is_favorite, bool_or(coalesce(in_reading_list, false)) AS in_reading_list FROM p GROUP BY 1 HAVING count(*) > 1),
f AS (SELECT canonical_id, arg_min(doi, paper_id) FILTER (NOT {MISSING_SQL.format('doi')}) AS doi, arg_min(venue, paper_id) FILTER (NOT {MISSING_SQL.format('venue')}) AS venue FROM p GROUP BY 1),
g AS (SELECT canonical_id, paper_id, generate_subscripts(tl, 1) AS k, unnest(tl) AS tag FROM (SELECT canonical_id, paper_id, {TAGS_SQL.format('tags')} AS tl FROM p)),
h AS (SELECT DISTINCT canonical_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, lower(tag) ORDER BY k) AS r FROM g) WHERE r = 1),
t AS (SELECT canonical_id, string_agg(tag, ', ' ORDER BY tag) AS tags FROM h GROUP BY 1)
SELECT b.*, coalesce(CASE WHEN NOT {MISSING_SQL.format('k.doi')} THEN k.doi END, f.doi) AS doi, coalesce(CASE WHEN NOT {MISSING_SQL.format('k.venue')} THEN k.venue END, f.venue) AS venue, coalesce(t.tags, '') AS tags
FROM b JOIN p k ON k.paper_id = b.keep LEFT JOIN f ON f.canonical_id = b.canonical_id LEFT JOIN t ON t.canonical_id = b.canonical_id
""")
def merge_proposal(spark: SparkSession, d: str) -> DataFrame:
    return dd.merge_groups(papers(spark, d), "canonical_id", "paper_id")


@query(sql=f"""
WITH p AS (SELECT canonical_id, paper_id, {COMPLETE} AS score FROM papers WHERE canonical_id IS NOT NULL), k AS (SELECT canonical_id, arg_min(paper_id, (-score, paper_id)) AS keep, count(*) AS n FROM p GROUP BY 1)
SELECT p.paper_id FROM p JOIN k USING (canonical_id) WHERE n > 1 AND p.paper_id <> keep
""")
def merged_away(spark: SparkSession, d: str) -> DataFrame:
    """The records that a merge of all groups deletes."""
    p = papers(spark, d).where("canonical_id is not null")
    keep = dd.merge_groups(papers(spark, d), "canonical_id", "paper_id").select("canonical_id", "keep")
    return p.join(keep, "canonical_id").where("paper_id <> keep").select("paper_id")
