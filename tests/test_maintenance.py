from pyspark.sql import functions as F

from litmill.operators import dedupe as dd
from litmill.operators import maintenance as mt
from litmill.sources import responses as rs

PAPER = "paper_id string, title string, authors array<string>, published string, doi string, venue string, entry_id string, canonical_id string, documents string, is_favorite string, in_reading_list boolean, tags string, key string, updated string"
ANSWER = "ord bigint, priority int, found boolean, title string, authors array<string>, published string, doi string, venue string"


def paper(n, title, authors=None, published=None, doi=None, venue=None, entry=None, cid=None, text=None):
    return (n, title, authors, published, doi, venue, entry, cid, text, "no", False, "", "clash", "clash")


def test_ids_are_computed_anew(spark):
    p = spark.createDataFrame([paper("1", "Test Paper", entry="https://arxiv.org/abs/2401.00001"), paper("2", " test paper "), paper("3", None), paper("4", "", doi="10.1/x")], PAPER).drop("key", "updated")
    a = spark.createDataFrame([(1, 0, True, "Test Paper", ["A"], "2024", "10.1000/ABC", "V"), (2, -9, False, "Test Paper", None, None, None, None), (3, 0, True, None, None, None, None, None)], ANSWER)
    got = {r.paper_id: r for r in mt.with_metadata(p, a).collect()}
    assert len(got) == 4 and [k for k, r in sorted(got.items()) if r.updated] == ["1", "2"]
    assert got["1"].doi == "10.1000/abc" and got["1"].canonical_id == "doi:10.1000/abc" and got["1"].venue == "V" and got["1"].authors == ["A"]
    assert got["4"].doi == "10.1/x" and mt.with_metadata(p, a.limit(0)).where("updated").count() == 0


def test_maintenance_after_one_paper(spark):
    lacking = spark.createDataFrame([paper(str(k), "Some Title", entry=f"e{k}") for k in range(3)] + [paper("9", "Quite another one", ["B C"], "2020", "10.9/z", "V", cid="z")], PAPER)
    a = spark.createDataFrame([(1, 0, True, "Some Title", ["X Smith"], "2024", "10.1/x", "J")], ANSWER)
    report = lambda seeds, p: mt.maintenance_report(seeds, p, a, dd.pair_keys(p, "paper_id")).collect()
    r = report(lacking.where("paper_id = '0'"), lacking)[0]
    assert (r.metadata_updates, r.dedupe_groups, r.dedupe_removed, r.reindexed_chunks) == (3, 0, 0, 3)
    two = spark.createDataFrame([paper("a", "Paper A", ["X Smith"], "2024", "10.1/x", "V", "e1", "c1"), paper("b", "Paper A v2", ["Smith, X"], "2024", "10.1/x", "V", "e2", "c2")], PAPER)
    r = report(two.where("paper_id = 'a'"), two)[0]
    assert (r.metadata_updates, r.dedupe_groups, r.dedupe_removed) == (0, 1, 1)
    assert report(two.limit(0), two) == []


def test_one_against_all_like_all_pairs(spark, sf):
    keys = dd.pair_keys(spark.read.parquet(f"{sf}/papers.parquet"), "paper_id").where(F.col("ord").endswith("1")).limit(60)
    side = lambda s: keys.select(*[F.col(c).alias(f"{c}_{s}") for c in keys.columns])
    want = dd.score_pairs(side("a").crossJoin(side("b")).where("ord_a <> ord_b")).where("combined_score >= 0.84")
    rows = lambda df: sorted((r.paper_a, r.paper_b, r.combined_score) for r in df.collect())
    assert rows(mt.one_against_all(keys, keys)) == rows(want)


def test_merging_keeps_one_record_a_group(spark):
    p = spark.createDataFrame([paper("1", "A", cid="c"), paper("2", "A", ["X"], "2020", "10.1/y", "V", cid="c"), paper("3", "B", cid="d"), paper("4", "C")], PAPER).drop("key", "updated")
    got = {r.paper_id: r for r in mt.merge_duplicates(p, "canonical_id", "paper_id").collect()}
    assert set(got) == {"2", "3", "4"} and got["2"].doi == "10.1/y" and got["2"].is_favorite == "false" and got["3"].is_favorite == "no"


def test_title_candidates(spark):
    page = "arXiv:1\n2024-0115\nOn Bounded Rent*\nA Study\nAnn B\nAbstract\nNot this"
    df = spark.createDataFrame([(page,), (None,), ("",), ("Only Title",), ("x\n" * 19 + "line 20 is read\nline 21 is not",)], "t string")
    got = [r.c for r in df.select(mt.title_candidates(F.col("t")).alias("c")).collect()]
    assert got == [["On Bounded Rent*", "On Bounded Rent* A Study", "On Bounded Rent A Study Ann B"], [], [], ["Only Title"], ["line 20 is read"]]


def test_systematic_sample_and_first_seen(spark):
    df = spark.range(23).withColumn("x", F.col("id") % 3)
    assert sorted(r.id for r in mt.systematic_sample(df, "id", 5).collect()) == list(range(0, 23, 4))
    assert mt.systematic_sample(df.limit(0), "id").count() == 0
    assert sorted(r.id for r in mt.first_seen(df, ["x"], "id").collect()) == [0, 1, 2]


def test_service_responses(spark):
    page = '{"data":[{"citedPaper":{"paperId":"b","title":"B","year":2020,"citationCount":3}},{"citedPaper":null},{}]}'
    df = spark.createDataFrame([("a", page), ("a", None), ("c", "no json")], "paper_id string, body string")
    assert [(r.src, r.dst, r.citation_count) for r in rs.cited_works(df).collect()] == [("a", "b", 3)]
    assert [(r.src, r.dst) for r in rs.cited_works(df.withColumn("body", F.replace("body", F.lit("cited"), F.lit("citing"))), citing=True).collect()] == [("b", "a")]
    atom = '<feed xmlns:arxiv="u"><entry><id>http://arxiv.org/abs/2401.1</id><title>A\n  B</title><published>2024-01-01</published><author><name>X Y</name></author><arxiv:doi>10.1/z</arxiv:doi></entry></feed>'
    r = rs.arxiv(spark.createDataFrame([(atom,)], "body string")).first()
    assert (r.title, r.authors, r.doi, r.pdf_url, r.published) == ("A B", ["X Y"], "10.1/z", "http://arxiv.org/pdf/2401.1", "2024-01-01")
    bib = "bib struct<title:string,author:array<string>,pub_year:string,abstract:string,venue:string>, pub_url string, eprint_url string"
    one = spark.createDataFrame([(("T", ["A"], "2020", None, "V"), "u", "e")], bib)
    other = rs.arxiv(spark.createDataFrame([(atom,)], "body string"))
    assert [(x.title, x.source) for x in rs.scholar(one, other).collect()] == [("T", "Google Scholar")]
    assert [(x.title, x.source) for x in rs.scholar(one.limit(0), other).collect()] == [("A B", "Google Scholar (OpenAlex)")]
