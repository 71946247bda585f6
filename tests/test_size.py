"""What is shuffled does not grow with pairs that are no result."""

import random

from pyspark.sql import functions as F

from litmill.functions.text import titles_similar
from litmill.operators import dedupe as dd
from litmill.operators import graph as gr
from litmill.operators import maintenance as mt
from litmill.sources import responses as rs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def titles_of(spark, n, name, seed):
    r = random.Random(seed)
    words = ["deep", "reef", "fishes", "halo", "gene", "shock", "waves", "orbit"]
    return spark.createDataFrame([(k, " ".join(r.choices(words, k=r.randint(0, 6)))) for k in range(n)] + [(n, None)], f"{name} int, text string")


def test_similar_titles_meet_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(rs, "QUERY_BLOCK", 7)
    q, t = titles_of(spark, 20, "query_id", 1), titles_of(spark, 40, "title_id", 2)
    got = rs.similar_titles(q, t)
    assert "Exchange" not in plan_of(got)
    all_pairs = q.withColumnRenamed("text", "a").crossJoin(t.withColumnRenamed("text", "b")).where(titles_similar(F.col("a"), F.col("b"))).select("query_id", "title_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, all_pairs.collect()))


def test_titles_are_resolved_without_joining_the_hits(spark):
    w = spark.createDataFrame([(1, "reef fishes halo"), (2, "nothing alike")], "query_id int, query string")
    found = spark.createDataFrame([(5, "s", "Reef Fishes", ["A"], "d5", 1), (6, "s", "reef fishes halo", [], "d6", -2), (7, "s", "reef fishes halo", [], "d7", -2)], "ord int, source string, title string, authors array<string>, doi string, priority int")
    got = rs.resolve_titles(w, found)
    assert [tuple(r) for r in got.collect()] == [(1, "s", "reef fishes halo", "d6")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def random_keys(spark, n, seed):
    r = random.Random(seed)
    words, names = ["reef", "fishes", "halo", "gene", "shock", "waves", "orbit"], ["Ng", "Lee", "Roe", "Poe"]
    rows = [(f"p{k:04}", " ".join(r.choices(words, k=r.randint(1, 5))), [f"A. {x}" for x in r.choices(names, k=r.randint(0, 3))], r.choice(["2001", "2002", ""]), r.choice(["10.1/a", "10.1/b", "unknown", "", None]), r.choice(["c1", "c2", "", None])) for k in range(n)]
    return dd.pair_keys(spark.createDataFrame(rows, "paper_id string, title string, authors array<string>, published string, doi string, canonical_id string"), "paper_id")


def scores(pairs):
    return sorted(map(tuple, dd.score_pairs(pairs, sequence=False).where("combined_score >= 0.84").collect()))


def exchanges(df):
    return sum("Exchange " in x and "Reused" not in x for x in plan_of(df).splitlines())


def test_one_against_all_shuffles_no_pairs(spark):
    keys = random_keys(spark, 90, 5)
    seeds = keys.where("ord like '%0'")
    side = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])
    got = mt.one_against_all(seeds, keys, sequence=False)
    assert exchanges(got) <= 2  # one for each side of the join
    assert sorted(map(tuple, got.collect())) == scores(side(seeds, "a").crossJoin(side(keys, "b")).where("ord_a <> ord_b"))


def test_candidate_pairs_shuffle_no_pairs(spark):
    keys = random_keys(spark, 120, 6)
    got = dd.candidate_pairs(keys, 0.84)
    assert exchanges(got) <= 2
    assert scores(got) == scores(dd.candidate_pairs(keys)) != []


def test_degrees_by_hubs_make_no_pairs_of_kinds(spark):
    r = random.Random(3)
    links = {(k, "all") for k in range(300)} | {(k, f"h{r.randrange(40)}") for k in range(400) for _ in range(3)}
    hubs = spark.createDataFrame(sorted(links), "node int, hub string")
    pairs = spark.createDataFrame([(0, 1), (390, 391), (500, 501)], "a int, b int")
    of = {}
    for n, h in links:
        of.setdefault(h, set()).add(n)
    near = {n: set() for n, _ in links} | {500: {501}, 501: {500}}
    for n, h in links:
        near[n] |= of[h] - {n}
    near[390].add(391), near[391].add(390)
    for span in (64, 1 << 18):
        got = gr.linked(pairs, hubs, span)
        assert {x.node: x.degree for x in got.collect()} == {n: len(x) for n, x in near.items() if x}
        assert "CoGroupsInArrow" in plan_of(got)


def test_stated_order_runs_no_fit(spark, sf, monkeypatch):
    from litmill.llm import fusion, queries

    fitted = fusion.paper_fusion(spark.read.parquet(f"{sf}/papers.parquet"), spark.read.parquet(f"{sf}/paper_sources.parquet")).survivors(keep=0.0).drop("posterior")
    want = sorted(map(tuple, fitted.collect()))
    monkeypatch.setattr(fusion.Fusion, "resolve", None)
    assert sorted(map(tuple, queries.p1_found(spark, sf).collect())) == want


def test_unread_papers_make_no_pairs(spark, monkeypatch):
    r = random.Random(8)
    ids = [f"p{k:03}" for k in range(200)]
    e = {(x, "hub") for x in ids[:150]} | {(r.choice(ids), r.choice(ids[:40] + ["x", "y", "z"])) for _ in range(500)} | {("out", "p001"), ("p002", "p002")}
    papers = spark.createDataFrame([(x, f"T{x}", r.choice([True, False, None])) for x in ids] + [(None, "no id", None)], "paper_id string, title string, in_reading_list boolean")
    edges = spark.createDataFrame(sorted(e) + [(None, "p003"), ("p003", None)], "src string, dst string")
    cit = {x for x in e if {*x} <= {*ids}}
    near = lambda links: {x: {y for y, b in links for z, a in links if z == x and a == b} - {x} for x in ids}
    coc, cou = near({(b, a) for a, b in cit}), near({x for x in e if x[0] in ids})
    score = lambda x: round(2.0 * sum((a == x) + (b == x) for a, b in cit) + 1.2 * len(coc[x]) + len(cou[x]), 3)
    outside = [x.paper_id for x in papers.where("paper_id is not null and in_reading_list is not true").collect()]
    want = sorted(((x, score(x)) for x in outside), key=lambda x: (-x[1], x[0]))
    monkeypatch.setattr(gr, "_pairs", None)
    c = gr.in_library(edges, papers)
    got = gr.unread(papers, c, gr.cocited_at(c), gr.coupled_at(edges, papers), k=70, rounds=(1,))
    assert [(x.paper_id, x.score) for x in got.collect()] == want[:70]
    every = gr.unread(papers, c, gr.cocited_at(c), gr.coupled_at(edges, papers), k=300).collect()
    assert sorted(x.paper_id or "" for x in every) == ["", *outside]


def test_each_task_gives_one_title_to_a_query(spark, monkeypatch):
    monkeypatch.setattr(rs, "QUERY_BLOCK", 7)
    q, t = titles_of(spark, 20, "query_id", 1), titles_of(spark, 60, "n", 4).repartition(3)
    t = t.select(F.struct((F.col("n") % 3 - 1).alias("priority"), F.col("n").alias("ord")).alias("title_id"), "text")
    every, first = rs.similar_titles(q, t), rs.similar_titles(q, t, first=True)
    least = lambda df: sorted(map(tuple, df.groupBy("query_id").agg(F.min("title_id")).collect()))
    assert least(first) == least(every) != []
    assert first.count() <= 3 * 21 < every.count()


def test_full_pairs_are_made_only_if_they_can_reach_the_score(spark):
    r = random.Random(9)
    typo = lambda x: x[: (k := r.randrange(len(x)))] + r.choice("aeiou") + x[k + 1 :]
    bases = ["the structural rent of rulkvik", "the uniform oscillation of waves", "reef fishes of the halo zone"]
    rows = [(f"p{k:03}", typo(typo(r.choice(bases))), [f"A. {x}" for x in r.choices(["Ng", "Lee", "Roe"], k=r.randint(0, 3))], r.choice(["2001", "2002", ""]), r.choice(["10.", "10.1/b", "unknown", None]), r.choice(["c1", "c2", "", None])) for k in range(90)]
    keys = dd.pair_keys(spark.createDataFrame(rows, "paper_id string, title string, authors array<string>, published string, doi string, canonical_id string"), "paper_id")
    full = lambda pairs: sorted(map(tuple, dd.score_pairs(pairs).where("combined_score >= 0.84").collect()))
    want = full(dd.candidate_pairs(keys))
    for tile in (4, 2048):
        got = dd.full_pairs(keys, 0.84, tile)
        assert full(got) == want != []
    n = keys.where("doi = '10.'").count()
    assert got.where("doi_a = '10.' and doi_b = '10.'").count() < n * (n - 1) // 2


def test_the_library_is_sifted_by_the_blocks_of_the_seeds(spark):
    keys = dd.pair_keys(spark.createDataFrame([(f"p{k:03}", f"title{k} word{k % 50}", [f"A. Name{k % 40}"], "2001", f"10.1/{k % 60}", f"c{k}") for k in range(200)], "paper_id string, title string, authors array<string>, published string, doi string, canonical_id string"), "paper_id")
    seeds = keys.where("ord = 'p007'")
    mine, every = dd.blocked(seeds, keys, 0.84, F.lit("")), dd.blocked(keys, keys, 0.84, F.lit(""))
    passed = dd.blocked(keys, keys, 0.84, F.lit(""), dd.sieve(mine, "block"))
    assert passed.count() < every.count() / 10
    met = lambda df: sorted(x.ord_b for x in dd.met(mine, df, 0.84).collect())
    assert met(passed) == met(every) == ["p067", "p127", "p187"]
