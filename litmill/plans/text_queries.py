"""Queries over scalar functions of titles, names, identifiers and texts, and document preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import text as tx
from litmill.functions.rules import STOPWORDS
from litmill.operators import layout
from litmill.plans.catalog import query
from litmill.plans.library_queries import MISSING_SQL, STRIP_SQL, YEAR_SQL, papers
from litmill.session import spread, table
from litmill.sources.responses import abstract_of, similar_titles

WS = r"[ \t\n\v\f\r]"
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
STOP_LIST = ", ".join(f"'{w}'" for w in STOPWORDS)
COLLAPSE = rf"regexp_replace(regexp_replace({{0}}, '{WS}+', ' ', 'g'), '^ +| +$', '', 'g')"


@query(sql=rf"""
WITH p AS (SELECT paper_id, title, published, entry_id, CASE WHEN NOT {MISSING_SQL.format('doi')} THEN doi END AS doi FROM papers),
q AS (SELECT *, lower({STRIP_SQL.format("replace(replace(replace(" + STRIP_SQL.format('doi') + ", 'https://doi.org/', ''), 'http://doi.org/', ''), 'doi:', '')")}) AS d FROM p)
SELECT paper_id, CASE WHEN coalesce(d, '') <> '' THEN 'doi:' || d WHEN regexp_matches(entry_id, '[0-9]{{4}}\.[0-9]{{4,5}}') THEN 'arxiv:' || regexp_extract(entry_id, '([0-9]{{4}}\.[0-9]{{4,5}})(v[0-9]+)?', 1)
  WHEN contains(lower(entry_id), 'openalex.org') THEN 'openalex:' || string_split(rtrim(entry_id, '/'), '/')[-1]
  ELSE 'title:' || substr(sha1(lower({STRIP_SQL.format("coalesce(title, '')")}) || ':' || coalesce(published, '')), 1, 12) END AS canonical FROM q
""")
def canonical_id(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("paper_id", tx.canonical_id(F.col("title"), F.col("published"), F.col("doi"), F.col("entry_id")).alias("canonical"))


@query(sql=rf"""
SELECT paper_id, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g') AS norm, {YEAR_SQL.format('published')} AS year,
  lower({STRIP_SQL.format("replace(replace(replace(" + STRIP_SQL.format("coalesce(doi, '')") + ", 'https://doi.org/', ''), 'http://doi.org/', ''), 'doi:', '')")}) AS doi_norm,
  array_to_string({TOKENS.format('title')}, ' ') AS toks FROM papers
""")
def normalized_fields(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("paper_id", tx.normalize_title(F.col("title")).alias("norm"), tx.extract_year(F.col("published")).alias("year"), tx.normalize_doi(F.col("doi")).alias("doi_norm"), F.array_join(tx.tokens(F.col("title")), " ").alias("toks"))


@query(sql=rf"""
WITH a AS (SELECT paper_id, unnest(authors) AS a FROM papers),
n AS (SELECT paper_id, regexp_replace(lower(CASE WHEN contains(a, ',') THEN string_split(a, ',')[1] ELSE coalesce(list_filter(regexp_split_to_array({STRIP_SQL.format('a')}, '{WS}+'), lambda w: w <> '')[-1], '') END), '[^a-z0-9]', '', 'g') AS name FROM a)
SELECT DISTINCT paper_id, name FROM n WHERE name <> ''
""")
def author_last_names(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("paper_id", F.explode(tx.last_names(F.col("authors"))).alias("name"))


@query(sql=rf"""
WITH t AS (SELECT item_id, {TOKENS.format('text')} AS ts FROM eval_items),
u AS (SELECT item_id, generate_subscripts(ts, 1) AS k, unnest(ts) AS term FROM t)
SELECT item_id, term, min(k) AS first_pos FROM u WHERE term NOT IN ({STOP_LIST}) AND length(term) >= 3 GROUP BY ALL
""")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_items")
    wanted = e.select("item_id", F.explode(tx.query_terms(F.col("text"))).alias("term"), tx.tokens(F.col("text")).alias("ts"))
    return wanted.select("item_id", "term", F.array_position("ts", F.col("term")).alias("first_pos"))


@query(sql=rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_min(list_filter([strpos(lower(coalesce(text, '')), 'market'), strpos(lower(coalesce(text, '')), 'evidence')], lambda p: p > 0)) AS p FROM documents),
e AS (SELECT *, CASE WHEN p IS NULL THEN 0 ELSE greatest(0, p - 1 - 180) END AS s FROM d), f AS (SELECT *, least(length(t), s + 360) AS e FROM e)
SELECT doc_id, CASE WHEN s > 0 THEN '...' ELSE '' END || {STRIP_SQL.format('substr(t, s + 1, e - s)')} || CASE WHEN e < length(t) THEN '...' ELSE '' END AS snippet FROM f
""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array(F.lit("market"), F.lit("evidence"))
    return table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text"), terms).alias("snippet"))


@query(sql="""
SELECT doc_id, regexp_replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '(evidence|market)', '<mark>\\1</mark>', 'gi') AS marked FROM documents
""")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.highlight(F.col("text"), ("market", "evidence")).alias("marked"))


@query(sql=rf"""
WITH t AS (SELECT doc_id, {COLLAPSE.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 220 THEN t ELSE regexp_replace(substr(t, 1, 220), '{WS}+$', '') || '...' END AS short FROM t
""")
def short_snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.short_snippet(F.col("text")).alias("short"))


@query(sql=r"""
SELECT paper_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(documents, chr(0), ''), '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS digest
FROM papers WHERE documents IS NOT NULL
""")
def cleaned_text(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).where("documents is not null").select("paper_id", F.md5(F.encode(tx.clean_extracted(F.col("documents")), "UTF-8")).alias("digest"))


LINES = "l AS (SELECT paper_id, unnest(string_split(documents, chr(10))) AS line FROM papers WHERE documents IS NOT NULL), s AS (SELECT *, " + STRIP_SQL.format("line") + " AS s FROM l)"
KIND = rf"""CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '(?i)^(figure|fig\.){WS}*[0-9]+') THEN 'figure_caption' WHEN regexp_matches(s, '(?i)^table{WS}*[0-9]+') THEN 'table_caption'
 WHEN length(s) >= 10 AND ((regexp_matches(s, '{WS}{{2,}}') AND length(regexp_replace(s, '[^0-9]', '', 'g')) >= 2) OR length(regexp_replace(s, '[^|]', '', 'g')) >= 2 OR regexp_matches(s, '^[A-Za-z].{{0,30}}{WS}+[0-9]+(\.[0-9]+)?{WS}+[0-9]+(\.[0-9]+)?')) THEN 'table'
 WHEN length(s) >= 6 AND (regexp_matches(s, '\\(frac|sum|int|alpha|beta|gamma|theta|lambda)') OR (length(regexp_replace(s, '[^=<>+\-*/^∑∫√]', '', 'g')) >= 2 AND regexp_matches(s, '[0-9]|\p{{L}}')) OR regexp_matches(s, '^\(?[0-9]+(\.[0-9]+)?\)?{WS}*[).-]?{WS}*[A-Za-z].*=')) THEN 'formula'
 ELSE 'plain' END"""


@query(sql=f"WITH {LINES} SELECT paper_id, {KIND} AS kind, count(*) AS n FROM s GROUP BY ALL")
def layout_tags(spark: SparkSession, d: str) -> DataFrame:
    return layout.tag_lines(papers(spark, d), "paper_id", "documents").groupBy("paper_id", "kind").agg(F.count("*").alias("n"))


@query(sql=rf"""
WITH {LINES}, k AS (SELECT paper_id, count(*) FILTER (({KIND}) = 'figure_caption') AS figs, count(*) FILTER (({KIND}) = 'table') AS tabs FROM s GROUP BY 1),
p AS (SELECT paper_id, coalesce(parse_ocr_pages, 0) AS ocr, string_split(documents, chr(12)) AS pages FROM papers WHERE documents IS NOT NULL),
m AS (SELECT *, greatest(1, len(pages)) AS n, {STRIP_SQL.format("array_to_string(pages, chr(10) || chr(10))")} AS merged FROM p),
x AS (SELECT *, length(merged) AS total, len(list_filter(pages, lambda q: length({STRIP_SQL.format('q')}) < 80)) / n AS low,
  CASE WHEN length(merged) > 0 THEN length(regexp_replace(merged, '[\x09\x0A\x0D\x20-\x7E]', '', 'g')) / length(merged) ELSE 1.0 END AS bad FROM m)
SELECT paper_id, score, CASE WHEN score >= 0.75 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS label, total_chars, bad_ratio FROM (
SELECT paper_id, round(greatest(0.0, least(1.0, 1.0 - CASE WHEN total < 600 THEN 0.35 ELSE 0 END - CASE WHEN total / n < 250 THEN 0.20 ELSE 0 END - CASE WHEN low > 0.5 THEN 0.20 ELSE 0 END
  - CASE WHEN ocr / n > 0.7 THEN 0.10 ELSE 0 END - CASE WHEN bad > 0.08 THEN 0.10 ELSE 0 END + CASE WHEN figs > 0 OR tabs > 0 THEN 0.05 ELSE 0 END))::DOUBLE, 4) AS score, total AS total_chars, round(bad, 4)::DOUBLE AS bad_ratio FROM x JOIN k USING (paper_id))
""")
def parse_quality(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d).where("documents is not null")
    k = layout.layout_counts(p, "paper_id", "documents")
    q = layout.parse_quality(F.split("documents", "\f"), F.col("figure_captions"), F.col("table_lines"), F.coalesce("parse_ocr_pages", F.lit(0)))
    return p.join(k, "paper_id").select("paper_id", q.alias("q")).select("paper_id", "q.*")


@query()
def chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    c = layout.chunk_texts(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"))


@query(sql="SELECT doc_id, CAST(ceil(length(text) / 500.0) AS INTEGER) AS pieces, substr(text, CAST((ceil(length(text) / 500.0) - 1) * 500 AS INTEGER) + 1, 500) AS last FROM documents WHERE length(text) > 0")
def fixed_slices(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").where("length(text) > 0").select("doc_id", tx.split_fixed(F.col("text"), 500).alias("p"))
    return s.select("doc_id", F.size("p").alias("pieces"), F.element_at("p", -1).alias("last"))


@query(sql=rf"SELECT doc_id, {COLLAPSE.format('text')} AS summary FROM documents WHERE text IS NOT NULL AND {COLLAPSE.format('text')} <> ''")
def inverted_abstract(spark: SparkSession, d: str) -> DataFrame:
    """An inverted index made of each text, and read back."""
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.filter(F.split(tx.collapse(F.col("text")), " "), lambda x: x != "")).alias("p", "w"))
    index = w.groupBy("doc_id", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", abstract_of(F.col("index")).alias("summary"))


@query(sql=rf"SELECT doc_id, {COLLAPSE.format(chr(123) + '0' + chr(125)).format("regexp_replace(text, '<[^>]+>', ' ', 'g')")} AS plain FROM documents")
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.strip_tags(F.col("text")).alias("plain"))


@query(sql=r"""
WITH c AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(coalesce(text, ''), '10\.[0-9]{4,9}/[-._;()/:a-zA-Z0-9]+')), '[.,;)\]]+$', '') AS doi FROM documents)
SELECT DISTINCT doc_id, doi FROM c WHERE length(doi) >= 7
""")
def doi_candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(tx.doi_candidates(F.col("text"))).alias("doi"))


@query(sql=rf"""
WITH p AS (SELECT paper_id, {TOKENS.format('title')} AS w, list_distinct({TOKENS.format('documents')}) AS b FROM papers WHERE documents IS NOT NULL AND title IS NOT NULL)
SELECT paper_id, len(w) > 0 AND len(list_filter(w, lambda x: list_contains(b, x))) / greatest(1, len(w)) >= 0.6 AS verified FROM p
""")
def title_verify(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d).where("documents is not null and title is not null")
    return p.select("paper_id", tx.title_in_text(F.col("title"), F.col("documents")).alias("verified"))


TITLE_WORDS = f"list_distinct(list_filter({TOKENS}, lambda t: length(t) > 2 AND NOT regexp_matches(t, '^[0-9]+$')))"


@query(sql=rf"""
WITH r AS (SELECT result_no, {TITLE_WORDS.format('title')} AS a FROM resolved WHERE found AND result_no % 100 = 0), p AS (SELECT DISTINCT title AS pt, {TITLE_WORDS.format('title')} AS b FROM papers WHERE title IS NOT NULL),
j AS (SELECT result_no, pt, len(list_intersect(a, b)) AS c, len(a) AS la, len(b) AS lb FROM r JOIN p ON len(list_intersect(a, b)) > 0)
SELECT result_no, count(*) AS similar_titles FROM j WHERE c / (la + lb - c) >= 0.2 OR c / least(la, lb) >= 0.8 GROUP BY 1
""")
def title_similar(spark: SparkSession, d: str) -> DataFrame:
    """How many of all titles are similar to each answer with a number divisible by 100."""
    q = table(spark, d, "resolved").where("found and result_no % 100 = 0").select(F.col("result_no").alias("query_id"), F.col("title").alias("text"))
    t = papers(spark, d).where("title is not null").select(F.col("title").alias("text")).distinct().withColumn("title_id", F.monotonically_increasing_id())
    return similar_titles(q, t).groupBy(F.col("query_id").alias("result_no")).agg(F.count("*").alias("similar_titles"))


@query(sql=rf"""
WITH t AS (SELECT paper_id, {STRIP_SQL.format("regexp_replace(translate(regexp_replace(coalesce(title, 'paper'), '(?i)\\.pdf$', ''), '/\\', '  '), '" + WS + "+', ' ', 'g')")} AS t FROM papers),
u AS (SELECT paper_id, regexp_replace(regexp_replace(t, '[^a-zA-Z0-9 \-_().,\[\]]', '', 'g'), '^[ .]+|[ .]+$', '', 'g') AS u FROM t)
SELECT paper_id, substr(CASE WHEN u = '' THEN 'paper' ELSE u END, 1, 150) AS stem FROM u
""")
def safe_filenames(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).select("paper_id", tx.safe_filename(F.col("title")).alias("stem"))


@query(sql=rf"SELECT paper_id, {STRIP_SQL.format("translate(regexp_replace(string_split(source, '/')[-1], '(?i)\\.pdf$', ''), '_-', '  ')")} AS title_guess FROM papers WHERE lower(source) LIKE '%.pdf'")
def filename_titles(spark: SparkSession, d: str) -> DataFrame:
    return papers(spark, d).where("lower(source) like '%.pdf'").select("paper_id", tx.title_of_filename(F.col("source")).alias("title_guess"))


@query(sql="SELECT doc_id, CASE WHEN length(t) <= 1000 THEN t ELSE substr(t, 1, 700) || ' ... ' || right(t, 300) END AS snippet FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def article_snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.article_snippet(F.col("text")).alias("snippet"))
