import json

from pyspark.sql import functions as F

from litmill.operators import discovery as dc
from litmill.operators import export as ex
from litmill.operators import library as lib
from litmill.operators import patterns as pt
from litmill.operators import tasks as tk
from litmill.sources import documents as sd
from litmill.sources import responses as rs
from litmill.sources.replay import ReplaySource
from litmill.streaming import streams as st

STATUSES = ["pending"] * 2 + ["failed"] + ["cancelled"] + ["completed"] * 12


def queue(spark, statuses=STATUSES):
    rows = [(f"id{k:02}", s, f"2024-01-{k + 1:02}", f"2024-01-{k + 1:02}", 0, False) for k, s in enumerate(statuses)]
    return spark.createDataFrame(rows, "id string, status string, created_at string, updated_at string, retries int, cancel_requested boolean")


def test_bulk_operations(spark):
    q = queue(spark)
    c = tk.cancel_all_pending(q)
    assert c.where("status = 'cancelled'").count() == 3
    assert tk.retry_failed(c).count() == 1
    assert tk.retry_failed(c, include_cancelled=True).count() == 4
    assert tk.prune_terminal(c, keep=2).where(F.col("status").isin(*tk.TERMINAL)).count() == 10
    assert tk.next_pending(q).first().id == "id00"
    assert {r.status: r.n for r in tk.summary(q).collect()} == {"pending": 2, "running": 0, "completed": 12, "failed": 1, "cancelled": 1}


def test_watches(spark):
    w = spark.createDataFrame([("1", "q", "author", "arxiv", "odd", True, None), ("2", "r", "x", "nowhere", "weekly", False, None)], "id string, query string, watch_type string, source string, frequency string, enabled boolean, next_run timestamp")
    n = tk.normalize_watch(w)
    assert [r.search for r in n.orderBy("id").collect()] == ['au:"q"', "r"]
    due = tk.due(n, F.expr("TIMESTAMP '2024-01-01'"))
    assert [r.id for r in due.collect()] == ["1"]
    found = spark.createDataFrame([("1", 1, "A"), ("1", 2, None)], "id string, ord int, title string")
    assert [r.line for r in tk.digest(due, found).orderBy("id", "line_no").collect()] == ["## q (2 new)", "- A", "- Unknown"]
    assert [r.line for r in tk.digest(due, found.limit(0)).collect()] == ["## q (0 new)"]


def test_novelty(spark):
    lib_ = spark.createDataFrame([("Known Title", "10.1/A"), (None, None), ("", "Unknown")], "title string, doi string")
    r = spark.createDataFrame([(1, "known title!", None), (2, "new", "10.1/a "), (3, "new", "Unknown"), (4, None, None)], "id int, title string, doi string")
    assert sorted(x.id for x in lib.novel(r, lib_).collect()) == [3, 4]


PAPER = [("p1", "On A & B", ["Doe, Jane", "Ada Lovelace"], "2020-01-02", "10.1/x", "J. X", "yes", True, "t1; T1, t2", "http://s", "c1", "arxiv.org/abs/1234.56789"), ("p2", None, None, None, None, None, None, None, None, None, None, None), ("p3", "On C", ["Doe, Jane"], "2020", "Unknown", "N/A", "no", False, "", "", "", "")]
SCHEMA = "paper_id string, title string, authors array<string>, published string, doi string, venue string, is_favorite string, in_reading_list boolean, tags string, source string, canonical_id string, entry_id string"


def test_exports(spark):
    p = spark.createDataFrame(PAPER, SCHEMA)
    b = {r.paper_id: r.entry for r in ex.bibtex(p, "paper_id").collect()}
    assert b["p1"].startswith("@article{Doe2020,") and "title = {On A \\& B}" in b["p1"] and "eprint = {1234.56789}" in b["p1"]
    assert b["p3"].startswith("@article{Doe2020b,")
    ris = {r.paper_id: r.entry.split("\n") for r in ex.ris(p, "paper_id").collect()}
    assert ris["p1"] == ["TY  - JOUR", "TI  - On A & B", "AU  - Doe, Jane", "AU  - Ada Lovelace", "PY  - 2020", "DO  - 10.1/x", "JO  - J. X", "UR  - http://s", "KW  - t1", "KW  - t2", "N1  - Favorite: true", "N1  - ReadingList: true", "ER  - "]
    csl = {r.paper_id: json.loads(r.entry) for r in ex.csl(p, "paper_id").collect()}
    assert csl["p1"]["issued"] == {"date-parts": [[2020]]} and csl["p1"]["id"] == "c1" and "DOI" not in csl["p3"]
    z = {r.paper_id: json.loads(r.entry) for r in ex.zotero(p, "paper_id").collect()}
    assert z["p1"]["creators"][1] == {"creatorType": "author", "lastName": "Lovelace", "firstName": "Ada"}
    assert z["p1"]["extra"] == "Favorite: true; ReadingList: true; CanonicalID: c1"


def test_responses(spark):
    s2 = json.dumps({"data": [{"title": "T", "authors": [{"name": "Ann"}], "paperId": "1", "year": 2020, "externalIds": {"DOI": "10.1/x"}, "publicationVenue": {"name": "Journal X"}}]})
    assert rs.semantic_scholar(spark.createDataFrame([(s2,), (None,), ("broken",)], "body string")).first().venue == "Journal X"
    oa = json.dumps({"results": [{"id": "W1", "title": "T", "authorships": [{"author": {"display_name": "Bob"}}], "publication_year": 2023, "doi": "https://doi.org/10.2000/ABC", "abstract_inverted_index": {"world": [1], "hello": [0]}, "host_venue": {"display_name": "Venue Y"}}]})
    r = rs.openalex(spark.createDataFrame([(oa,)], "body string"), "NBER").first()
    assert (r.venue, r.doi, r.summary, r.authors, r.published) == ("Venue Y", "10.2000/abc", "hello world", ["Bob"], "2023")


def test_resolve_takes_the_first_source_that_matches(spark):
    w = spark.createDataFrame([(1, "Optimal auction design"), (2, "DOI:10.1/ABC")], "query_id int, query string")
    r = spark.createDataFrame([(1, "b", 1, "Optimal auction design", ["A"], ""), (1, "a", 2, "Something else entirely", ["A"], ""), (2, "a", 1, "x", [], "https://doi.org/10.1/abc")], "query_id int, source string, ord int, title string, authors array<string>, doi string")
    assert sorted((x.query_id, x.source) for x in rs.resolve(w, r, {"a": 0, "b": 1}).collect()) == [(1, "b"), (2, "a")]


def test_replay_source(spark, tmp_path):
    (tmp_path / "q1.openalex.json").write_text('{"results": []}')
    (tmp_path / "q2.s2.json").write_text("{}")
    spark.dataSource.register(ReplaySource)
    got = spark.read.format("literature_replay").option("path", str(tmp_path)).option("service", "openalex").load().collect()
    assert [(r.file, r.body) for r in got] == [("q1.openalex.json", '{"results": []}')]


def test_folder_of_documents(spark, tmp_path):
    (tmp_path / "my_paper.PDF").write_bytes(b"page one\fpage two")
    (tmp_path / "note.txt").write_text("no")
    files = sd.listing(spark, str(tmp_path))
    pages = sd.extract(files, lambda b: b.decode().split("\f"))
    assert [(r.page_no, r.page_text) for r in pages.orderBy("page_no").collect()] == [(0, "page one"), (1, "page two")]
    assert files.first().title == "my paper"
    assert sd.empty_documents(pages, "path", "page_text").first().chars == 16
    assert sd.extract(files, lambda b: 1 / 0).first().page_text is None


def test_state_file(spark, tmp_path):
    (tmp_path / "tasks.json").write_text('[{"id": "1", "status": "running", "payload": {"paper": {"title": "T"}}}]')
    t = sd.load_state(spark, str(tmp_path / "tasks.json"), sd.TASKS)
    assert tk.recovered(t).first().status == "pending" and t.first().payload.paper.title == "T"


def test_patterns(spark):
    df = spark.createDataFrame([(1, "However, we show that markets clear in any case. It follows that prices fall. We show that rents rise at last.")], "k int, t string")
    s = pt.sentences(df, "k", "t")
    counts = {r.pattern: r.n for r in pt.pattern_counts(pt.phrase_matches(s, "k")).collect()}
    assert counts[pt.PHRASES[0]] == 2 and counts[pt.PHRASES[1]] == 1
    assert {r.template: r.n for r in pt.template_counts(s).collect()} == {"[LOGIC] [CONTRAST], [COUNTERPOINT]": 1}
    assert {r.phrase: r.n for r in pt.that_trigrams(s).collect()} == {"we show that": 2, "it follows that": 1}
    assert pt.category_of(pt.PHRASES[0]) == "Argumentation"


def test_article_queries_cover_new_words(spark):
    text = "auction design theory " * 20 + "budget limits " * 10 + "other words appear here now and again"
    got = [r.query for r in dc.article_queries(spark.createDataFrame([(1, text), (2, None), (3, "")], "k int, t string"), "k", "t").orderBy("pos").collect()]
    assert len(got) == 3 and len(set(" ".join(got).split())) >= 3


def test_topics_of_few_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id int, embedding array<float>")
    assert dc.topic_clusters(v).first().cluster == -1


def test_task_state_machine_stream(spark, tmp_path):
    rows = [(1, 1, "pending"), (2, 1, "running"), (3, 1, "completed"), (4, 1, "running"), (5, 2, "pending")]
    spark.createDataFrame(rows, "event_id long, user_id long, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("event_id long, user_id long, status string").parquet(str(tmp_path / "in"))
    out = st.run_to_end(st.task_states(s), "states", "update", str(tmp_path / "cp"))
    assert sorted((r.task_id, r.status) for r in out.collect()) == [(1, "completed"), (2, "pending")]
