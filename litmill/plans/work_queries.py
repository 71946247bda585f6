"""Queries over the work queue, watches, exports, sources, article queries and streams.

Tasks are made of events: the kind of event stands for the status, the event's number for the task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litmill.functions import text as tx
from litmill.operators import discovery as dc
from litmill.operators import export as ex
from litmill.operators import library as lib
from litmill.operators import tasks as tk
from litmill.plans.catalog import query
from litmill.plans.library_queries import FLAG_SQL, STRIP_SQL, TAGS_SQL, YEAR_SQL, papers
from litmill.plans.text_queries import COLLAPSE, TITLE_WORDS, WS
from litmill.session import scratch, table
from litmill.sources import responses as rs
from litmill.streaming import streams as st

STATUS = {"signup": "pending", "view": "running", "click": "completed", "error": "failed", "purchase": "cancelled"}
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
TASKS_SQL = f"t AS (SELECT event_id AS id, {STATUS_SQL} AS status, ts AS created_at, ts AS updated_at, CAST(json_extract(props, '$.k') AS INTEGER) AS retries, event_id % 7 = 0 AS cancel_requested FROM events)"


def _status(c: str = "event_type"):
    return F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col(c)]


def tasks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), _status().alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.get_json_object("props", "$.k").cast("int").alias("retries"), (F.col("event_id") % 7 == 0).alias("cancel_requested"))


@query(sql=f"WITH {TASKS_SQL} SELECT s.status, count(t.id) AS n FROM (VALUES ('pending'), ('running'), ('completed'), ('failed'), ('cancelled')) s(status) LEFT JOIN t USING (status) GROUP BY 1")
def task_summary(spark: SparkSession, d: str) -> DataFrame:
    return tk.summary(tasks(spark, d))


@query(sql=f"WITH {TASKS_SQL} SELECT id, CASE status WHEN 'running' THEN 'pending' ELSE status END AS status FROM t")
def task_recovery(spark: SparkSession, d: str) -> DataFrame:
    return tk.recovered(tasks(spark, d)).select("id", "status")


@query(sql=f"WITH {TASKS_SQL} SELECT id, created_at FROM t ORDER BY created_at DESC, id DESC LIMIT 200")
def task_listing(spark: SparkSession, d: str) -> DataFrame:
    return tk.listed(tasks(spark, d)).select("id", "created_at")


@query(sql=f"WITH {TASKS_SQL} SELECT id, 'running' AS status FROM t WHERE status = 'pending' AND NOT cancel_requested ORDER BY created_at, id LIMIT 1")
def fifo_pick(spark: SparkSession, d: str) -> DataFrame:
    return tk.next_pending(tasks(spark, d)).select("id", "status")


@query(sql=f"WITH {TASKS_SQL} SELECT id FROM t WHERE status NOT IN ('completed', 'failed', 'cancelled') UNION ALL SELECT id FROM (SELECT id FROM t WHERE status IN ('completed', 'failed', 'cancelled') ORDER BY updated_at DESC, id DESC LIMIT 200)")
def prune_terminal(spark: SparkSession, d: str) -> DataFrame:
    return tk.prune_terminal(tasks(spark, d)).select("id")


@query(sql=f"WITH {TASKS_SQL} SELECT 'retry-' || id AS id, 'pending' AS status, coalesce(retries, 0) + 1 AS retries, 'Bulk retry from task ' || left(id::VARCHAR, 8) || '.' AS message FROM t WHERE status IN ('failed', 'cancelled')")
def bulk_retry(spark: SparkSession, d: str) -> DataFrame:
    return tk.retry_failed(tasks(spark, d), include_cancelled=True)


@query(sql=f"WITH {TASKS_SQL} SELECT CASE status WHEN 'pending' THEN 'cancelled' ELSE status END AS status, count(*) AS n FROM t GROUP BY 1")
def bulk_cancel(spark: SparkSession, d: str) -> DataFrame:
    return tk.cancel_all_pending(tasks(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@query(sql=f"WITH {TASKS_SQL} SELECT id, CASE WHEN id % 3 = 0 AND status = 'pending' THEN 'cancelled' ELSE status END AS status, cancel_requested OR (id % 3 = 0 AND status = 'running') AS cancel_requested FROM t")
def cancel_some(spark: SparkSession, d: str) -> DataFrame:
    return tk.request_cancel(tasks(spark, d), F.col("id") % 3 == 0).select("id", "status", "cancel_requested")


@query(sql="SELECT event_id AS seq, ts FROM events ORDER BY event_id DESC LIMIT 100")
def history_ring(spark: SparkSession, d: str) -> DataFrame:
    return tk.history_ring(table(spark, d, "events").select(F.col("event_id").alias("seq"), "ts"))


@query(sql=f"SELECT user_id, max({STATUS_SQL}) FILTER (event_id = m) AS status FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1")
def last_states(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", _status().alias("status"))
    return tk.last_state(e, "user_id", "event_id").select("user_id", "status")


NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def watches(spark: SparkSession, d: str) -> DataFrame:
    """A watch of each user: last run at the last event, weekly for odd users."""
    w = table(spark, d, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp")).alias("last_run"))
    freq = F.when(F.col("user_id") % 2 == 0, "daily").otherwise("weekly")
    step = F.when(F.col("user_id") % 2 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 7 DAY"))
    return w.select(F.col("user_id").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("query"), freq.alias("frequency"), (F.col("user_id") % 5 != 0).alias("enabled"), "last_run", (F.col("last_run") + step).alias("next_run"))


@query(sql=f"""
WITH w AS (SELECT user_id AS id, max(ts)::TIMESTAMP AS last_run FROM events GROUP BY 1)
SELECT id, strftime({NOW} + CASE WHEN id % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END, '%Y-%m-%d %H:%M:%S') AS next_run FROM w
WHERE id % 5 <> 0 AND last_run + CASE WHEN id % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END <= {NOW}
""")
def due_watches(spark: SparkSession, d: str) -> DataFrame:
    return tk.due(watches(spark, d), F.expr(NOW)).select("id", F.date_format("next_run", "yyyy-MM-dd HH:mm:ss").alias("next_run"))


@query(sql=f"""
WITH w AS (SELECT user_id AS id, max(ts)::TIMESTAMP AS last_run FROM events GROUP BY 1), due AS (SELECT id FROM w WHERE id % 5 <> 0 AND last_run + CASE WHEN id % 2 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 7 DAY END <= {NOW}),
f AS (SELECT user_id AS id, event_id, event_type FROM events)
SELECT id, 0 AS line_no, '## user ' || id || ' (' || (SELECT count(*) FROM f WHERE f.id = due.id) || ' new)' AS line FROM due
UNION ALL SELECT id, row_number() OVER (PARTITION BY id ORDER BY event_id)::INTEGER, '- ' || event_type FROM f WHERE id IN (SELECT id FROM due)
""")
def watch_digests(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.col("event_type").alias("title"))
    return tk.digest(tk.due(watches(spark, d), F.expr(NOW)), found)


@query(sql="SELECT paper_id, coalesce(CASE WHEN source LIKE 'inbox/%' THEN source END, CASE WHEN lower(source) = 'preprint_feed' AND coalesce(entry_id, '') <> '' THEN 'https://arxiv.org/pdf/' || string_split(entry_id, '/')[-1] || '.pdf' END) AS url FROM papers")
def download_urls(spark: SparkSession, d: str) -> DataFrame:
    p = papers(spark, d)
    given = F.when(F.startswith(F.col("source"), F.lit("inbox/")), F.col("source"))
    feed = F.when(F.lower("source") == "preprint_feed", F.lit("arxiv"))
    return p.select("paper_id", tx.download_url(given, feed, F.col("entry_id")).alias("url"))


# ---------- exports

LAST = f"(CASE WHEN contains(fa, ',') THEN string_split(fa, ',')[1] ELSE coalesce(regexp_split_to_array({STRIP_SQL.format('fa')}, '{WS}+')[-1], 'Unknown') END)"
KEYS = f"""b AS (SELECT *, coalesce(authors[1], 'Unknown') AS fa FROM papers), l AS (SELECT *, regexp_replace({LAST}, '[^a-zA-Z]', '', 'g') AS ln FROM b),
 k AS (SELECT *, CASE WHEN ln = '' THEN 'Unknown' ELSE ln END || coalesce({YEAR_SQL.format('published')}::VARCHAR, 'Unknown') AS base FROM l), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY paper_id) AS n FROM k),
 c AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || chr((96 + n)::INTEGER) END AS cite_key FROM n)"""


@query(sql=f"WITH {KEYS} SELECT paper_id, cite_key FROM c")
def bibtex_keys(spark: SparkSession, d: str) -> DataFrame:
    return ex.with_cite_keys(papers(spark, d), "paper_id").select("paper_id", "cite_key")


LATEX = "replace(replace(replace(replace(replace(replace(replace(replace(replace({0}, '&', '\\&'), '%', '\\%'), '$', '\\$'), '#', '\\#'), '_', '\\_'), '{{', '\\{{'), '}}', '\\}}'), '~', '\\textasciitilde{{}}'), '^', '\\textasciicircum{{}}')"


@query(sql=rf"""WITH {KEYS} SELECT paper_id, array_to_string(list_filter(['@article{{' || cite_key || ',', '  title = {{' || {LATEX.format("coalesce(title, 'Unknown Title')")} || '}},', '  author = {{' || {LATEX.format("coalesce(array_to_string(authors, ' and '), 'Unknown')")} || '}},',
 '  year = {{' || coalesce({YEAR_SQL.format('published')}::VARCHAR, 'Unknown') || '}},', CASE WHEN coalesce(venue, '') <> '' AND {STRIP_SQL.format('venue')} NOT IN ('Unknown', 'None', 'N/A') THEN '  journal = {{' || {LATEX.format('venue')} || '}},' END,
 CASE WHEN coalesce(doi, '') <> '' AND {STRIP_SQL.format('doi')} NOT IN ('Unknown', 'None') THEN '  doi = {{' || doi || '}},' END, '}}'], lambda x: x IS NOT NULL), chr(10)) AS entry FROM c""")
def bibtex_entries(spark: SparkSession, d: str) -> DataFrame:
    return ex.bibtex(papers(spark, d), "paper_id")


VEN = f"CASE WHEN coalesce(venue, '') <> '' AND {STRIP_SQL.format('venue')} NOT IN ('Unknown', 'None', 'N/A', '') THEN venue END"
DOI = f"CASE WHEN coalesce(doi, '') <> '' AND {STRIP_SQL.format('doi')} NOT IN ('Unknown', 'None') THEN doi END"


@query(sql=f"""
WITH t AS (SELECT paper_id, list(tag ORDER BY k) AS tags FROM (SELECT paper_id, k, tag, row_number() OVER (PARTITION BY paper_id, lower(tag) ORDER BY k) AS r FROM (SELECT paper_id, generate_subscripts(tl, 1) AS k, unnest(tl) AS tag FROM (SELECT paper_id, {TAGS_SQL.format('tags')} AS tl FROM papers))) WHERE r = 1 GROUP BY 1)
SELECT p.paper_id, array_to_string(list_filter(list_concat(['TY  - JOUR', CASE WHEN coalesce(title, '') <> '' THEN 'TI  - ' || title END],
 list_transform(list_filter(list_transform(coalesce(authors, []), lambda a: {STRIP_SQL.format('a')}), lambda a: a <> ''), lambda a: 'AU  - ' || a),
 ['PY  - ' || {YEAR_SQL.format('published')}, 'DO  - ' || {DOI}, 'JO  - ' || {VEN}], list_transform(coalesce(t.tags, []), lambda x: 'KW  - ' || x),
 [CASE WHEN {FLAG_SQL.format('is_favorite')} THEN 'N1  - Favorite: true' END, CASE WHEN in_reading_list THEN 'N1  - ReadingList: true' END, 'ER  - ']), lambda x: x IS NOT NULL), chr(10)) AS entry FROM papers p LEFT JOIN t ON t.paper_id = p.paper_id
""")
def ris_export(spark: SparkSession, d: str) -> DataFrame:
    return ex.ris(papers(spark, d), "paper_id")


@query(sql=f"""
SELECT paper_id, coalesce(nullif(canonical_id, ''), nullif(entry_id, ''), title) AS id, {DOI} AS doi, {VEN} AS container, {YEAR_SQL.format('published')} AS year, len(coalesce(authors, []))::INTEGER AS authors FROM papers
""")
def csl_export(spark: SparkSession, d: str) -> DataFrame:
    """The entries, read back from their JSON."""
    e = ex.csl(papers(spark, d), "paper_id")
    j = F.from_json("entry", "id string, DOI string, `container-title` string, issued struct<`date-parts`:array<array<int>>>, author array<struct<literal:string>>")
    return e.select("paper_id", j.alias("j")).select("paper_id", "j.id", F.col("j.DOI").alias("doi"), F.col("j.container-title").alias("container"), F.get(F.get(F.col("j.issued.date-parts"), 0), 0).alias("year"), F.size("j.author").alias("authors"))


@query(sql=f"""
WITH a AS (SELECT paper_id, list_filter(list_transform(coalesce(authors, []), lambda a: {STRIP_SQL.format('a')}), lambda a: a <> '') AS l FROM papers), u AS (SELECT paper_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS a FROM a), w AS (SELECT *, regexp_split_to_array(a, '{WS}+') AS w FROM u)
SELECT paper_id, pos, CASE WHEN contains(a, ',') THEN {STRIP_SQL.format("split_part(a, ',', 1)")} WHEN len(w) >= 2 THEN w[-1] END AS last_name,
 CASE WHEN contains(a, ',') THEN {STRIP_SQL.format("substr(a, strpos(a, ',') + 1)")} WHEN len(w) >= 2 THEN array_to_string(w[1:len(w) - 1], ' ') END AS first_name, CASE WHEN NOT contains(a, ',') AND len(w) < 2 THEN a END AS name FROM w
""")
def zotero_creators(spark: SparkSession, d: str) -> DataFrame:
    return ex.creators(papers(spark, d), "paper_id")


@query(sql=f"SELECT paper_id, coalesce(title, '') AS title, coalesce(venue, '') AS venue, coalesce({YEAR_SQL.format('published')}::VARCHAR, '') AS date, array_to_string(list_filter([CASE WHEN {FLAG_SQL.format('is_favorite')} THEN 'Favorite: true' END, CASE WHEN in_reading_list THEN 'ReadingList: true' END, CASE WHEN coalesce(canonical_id, '') <> '' THEN 'CanonicalID: ' || canonical_id END], lambda x: x IS NOT NULL), '; ') AS extra FROM papers")
def zotero_export(spark: SparkSession, d: str) -> DataFrame:
    e = ex.zotero(papers(spark, d), "paper_id")
    j = F.from_json("entry", "title string, publicationTitle string, date string, extra string")
    return e.select("paper_id", j.alias("j")).select("paper_id", "j.title", F.col("j.publicationTitle").alias("venue"), "j.date", "j.extra")


@query(sql=f"SELECT paper_id, '- ' || coalesce(array_to_string(authors, ', '), 'Unknown') || ' (' || coalesce({YEAR_SQL.format('published')}::VARCHAR, 'Unknown') || '). ' || coalesce(title, 'Unknown') || '.' || coalesce(' DOI: ' || {DOI} || '.', '') AS line FROM papers")
def reference_list(spark: SparkSession, d: str) -> DataFrame:
    return ex.reference_lines(papers(spark, d), "paper_id")


# ---------- sources, discovery, streams


@query(sql=f"SELECT result_no::VARCHAR AS entry_id, coalesce(title, 'Unknown Title') AS title, coalesce({YEAR_SQL.format('published')}::VARCHAR, 'Unknown') AS published, coalesce(nullif(venue, ''), '') AS venue, len(list_filter(coalesce(authors, []), lambda a: a IS NOT NULL))::INTEGER AS authors FROM resolved WHERE found")
def semantic_scholar_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Responses made of the resolved answers, and flattened."""
    r = table(spark, d, "resolved").where("found")
    work = F.struct(
        "title", F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors"), F.col("result_no").cast("string").alias("paperId"), tx.extract_year(F.col("published")).alias("year"),
        F.struct(F.col("doi").alias("DOI")).alias("externalIds"), F.struct(F.col("venue").alias("name")).alias("publicationVenue"),
    )
    body = r.select(F.to_json(F.struct(F.array(work).alias("data"))).alias("body"))
    return rs.semantic_scholar(body).select("entry_id", "title", "published", "venue", F.size("authors").alias("authors"))


@query(sql=f"SELECT doc_id::VARCHAR AS entry_id, {COLLAPSE.format('text')} AS summary FROM documents WHERE coalesce({COLLAPSE.format('text')}, '') <> ''")
def openalex_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Responses with inverted indexes made of the documents, and flattened."""
    t = tx.collapse(F.col("text"))
    words = F.filter(F.split(t, " "), lambda w: w != "")
    index = F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.filter(F.transform(words, lambda x, k: F.when(x == w, k)), lambda k: k.isNotNull()))))
    docs = table(spark, d, "documents").where(F.coalesce(t, F.lit("")) != "")
    work = F.struct(F.col("doc_id").cast("string").alias("id"), index.alias("abstract_inverted_index"))
    return rs.openalex(docs.select(F.to_json(F.struct(F.array(work).alias("results"))).alias("body")), "OpenAlex").select("entry_id", "summary")


@query(sql=r"""
WITH RECURSIVE x AS (SELECT 1) SELECT result_no, '(' || title || ') AND cat:' || source || ' AND submittedDate:[' || coalesce(CASE WHEN regexp_matches(published, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN replace(published, '-', '') END, '19000101') || '0000 TO 202601012359]' AS q
FROM resolved WHERE found AND title IS NOT NULL
""".replace("WITH RECURSIVE x AS (SELECT 1) ", ""))
def arxiv_queries(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "resolved").where("found and title is not null")
    begin = F.when(F.col("published").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.col("published")).try_cast("date")
    return r.select("result_no", rs.arxiv_query(F.col("title"), F.array("source"), begin, F.lit("2026-01-01").cast("date")).alias("q"))


RESOLVED = f"concat_ws(' ', title, array_to_string(authors, ' '))"


@query(sql=f"""
WITH q AS (SELECT paper_id AS query_id, {TITLE_WORDS.format('title')} AS a FROM papers WHERE title IS NOT NULL AND substr(paper_id, 2)::BIGINT % 100 = 0),
r AS (SELECT result_no AS ord, source, title, doi, {TITLE_WORDS.format(RESOLVED)} AS b FROM resolved WHERE found),
j AS (SELECT q.query_id, r.*, len(list_intersect(a, b)) AS c, len(a) AS la, len(b) AS lb FROM q JOIN r ON len(list_intersect(a, b)) > 0),
m AS (SELECT j.*, coalesce(-trust, 0) AS rank FROM j LEFT JOIN paper_sources s ON s.source = j.source WHERE c / (la + lb - c) >= 0.2 OR c / least(la, lb) >= 0.8)
SELECT query_id, source, title, doi FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, ord) = 1
""")
def resolver_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The titles of the papers with an id divisible by 100, each resolved by all answers, the sources in order of trust."""
    trust = table(spark, d, "paper_sources").select("source", (-F.col("trust")).alias("priority"))
    wanted = papers(spark, d).where("title is not null and cast(substring(paper_id, 2) as bigint) % 100 = 0").select(F.col("paper_id").alias("query_id"), F.col("title").alias("query"))
    found = table(spark, d, "resolved").where("found").select(F.col("result_no").alias("ord"), "source", "title", "authors", "doi").join(trust, "source", "left").fillna({"priority": 0})
    return rs.resolve_titles(wanted, found)


@query()
def article_queries(spark: SparkSession, d: str) -> DataFrame:
    return dc.article_queries(table(spark, d, "documents"), "doc_id", "text")


@query()
def topic_clusters(spark: SparkSession, d: str) -> DataFrame:
    return dc.topic_clusters(table(spark, d, "embeddings"))


@query(sql="""
WITH t AS (SELECT label AS cluster, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, count(*) OVER (PARTITION BY label) AS size FROM embeddings)
SELECT cluster, any_value(size) AS size, string_agg('v' || vec_id, '; ' ORDER BY rn) FILTER (rn <= 5) || CASE WHEN any_value(size) > 5 THEN '; ... and ' || (any_value(size) - 5) || ' more' ELSE '' END AS titles FROM t GROUP BY 1
""")
def cluster_summary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"))
    return dc.cluster_summary(e, e.select("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("title")))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    import os

    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).format("parquet")
    return reader.load(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").load(d)


def _finished(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """The stream run to its end into a table of the shared folder."""
    out = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/data")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data")

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{out}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


@query(sql=f"SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, {STATUS_SQL} AS status, count(*) AS n FROM events GROUP BY ALL")
def stream_task_counts(spark: SparkSession, d: str) -> DataFrame:
    e = _stream(spark, d, "events").withColumn("status", _status())
    return _finished(spark, st.status_counts(e, "ts", "status"), "complete").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "status", "n")


@query(sql=f"SELECT result_no FROM resolved WHERE found AND regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g') NOT IN (SELECT regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g') FROM papers WHERE regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]', '', 'g') <> '')")
def stream_novelty(spark: SparkSession, d: str) -> DataFrame:
    new = st.new_titles(_stream(spark, d, "resolved").where("found"), papers(spark, d)).select("result_no")
    return _finished(spark, new, "append")


@query(sql="SELECT paper_id FROM papers WHERE coalesce(entry_id, '') NOT IN (SELECT entry_id FROM papers WHERE ingested_at < TIMESTAMP '2020-01-01' AND entry_id IS NOT NULL) AND ingested_at >= TIMESTAMP '2020-01-01'")
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Records that arrive from 2020 on and whose entry id the library does not have by then."""
    p = papers(spark, d)
    old = p.where("ingested_at < TIMESTAMP_NTZ '2020-01-01 00:00:00' and entry_id is not null").select("entry_id")
    return lib.delete(p.where("ingested_at >= TIMESTAMP_NTZ '2020-01-01 00:00:00'").withColumn("entry_id", F.coalesce("entry_id", F.lit(""))), old, "entry_id").select("paper_id")

