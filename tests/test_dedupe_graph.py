import random
from types import SimpleNamespace

import networkx_free as nx
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litmill.operators import dedupe as dd
from litmill.operators import graph as gr
from litmill.plans.library_queries import papers


def test_pair_score(spark):
    p = spark.createDataFrame([("a", "Paper A", ["X Smith"], "2024", "10.1/x", ""), ("b", "Paper A v2", ["Smith, X"], "2024", "10.1/x", "")], "id string, title string, authors array<string>, published string, doi string, canonical_id string")
    r = dd.score_pairs(dd.candidate_pairs(dd.pair_keys(p, "id"))).first()
    assert (r.title_similarity, r.author_similarity, r.year_similarity, r.combined_score) == (0.8571, 1.0, 1.0, 1.0)
    assert r.reasons == "exact_doi,author_overlap,year_close"


def test_pairs_that_only_the_ratio_lifts(spark, sf):
    rows = [("a", "{T}he structural rent of Rulkvik", ["X Smith"], "2024", None, None), ("b", "The structural rent of Rulkvik", ["Smith, X"], "2024", None, None), ("c", "The structurel rents of Rulkvik", ["Y Smith"], "2024", None, None), ("d", "The structural rent of Rulkvik", ["Z Other"], "2024", None, None)]
    small = spark.createDataFrame(rows, "paper_id string, title string, authors array<string>, published string, doi string, canonical_id string")
    scored = lambda pairs: {r.paper_a + r.paper_b: r.combined_score for r in dd.score_pairs(pairs).where("combined_score >= 0.84").collect()}
    for p in (small, papers(spark, sf)):
        keys = dd.pair_keys(p, "paper_id")
        assert scored(dd.full_pairs(keys, 0.84)) == scored(dd.candidate_pairs(keys))
    assert {"ab", "ac", "bc"} == set(scored(dd.full_pairs(dd.pair_keys(small, "paper_id"), 0.84)))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_groups_like_union_find(spark, pairs):
    df = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs] + [(None, "001")], "a string, b string")
    got = {r.member: r.group_id for r in dd.group_pairs(df, "a", "b").collect()}
    assert got == nx.components([(f"{a:03}", f"{b:03}") for a, b in pairs if a != b])


def test_merge_keeps_the_most_complete(spark):
    rows = [("1", "c", None, ["A"], "2020", "V", "no", False, "x"), ("2", "c", "10.1/y", ["A"], "2020", "Unknown", "yes", False, "y, X"), ("3", "d", None, None, None, None, None, None, None)]
    p = spark.createDataFrame(rows, "id string, canonical_id string, doi string, authors array<string>, published string, venue string, is_favorite string, in_reading_list boolean, tags string")
    r = dd.merge_groups(p, "canonical_id", "id").collect()
    assert [(x.keep, x.doi, x.venue, x.is_favorite, x.tags) for x in r] == [("2", "10.1/y", "V", True, "X, x, y")]


def test_bridge_of_a_path(spark):
    g = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0)], "a string, b string, weight double")
    r = gr.bridges(g).collect()
    assert [(x.node, x.bridge_score, x.betweenness, x.is_articulation, x.path) for x in r] == [("B", 2.26, 1.0, True, "A -> B -> C")]


@settings(max_examples=5, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)).filter(lambda e: e[0] < e[1]), min_size=2, max_size=20))
def test_betweenness_and_cut_vertices_by_brute_force(spark, edges):
    rows = [(f"n{a}", f"n{b}", 1.0 + (a * b) % 3) for a, b in edges]
    got = {r.node: r for r in gr.centrality(spark.createDataFrame(rows, "a string, b string, weight double")).collect()}
    want, cut = nx.betweenness(rows), nx.cut_vertices(rows)
    assert {k: round(v.betweenness, 9) for k, v in got.items()} == pytest.approx(want)
    assert {k for k, v in got.items() if v.is_articulation} == cut


def test_a_large_component_is_measured_like_a_small_one(spark):
    rnd = random.Random(3)
    ends = {tuple(sorted(rnd.sample(range(40), 2))) for _ in range(60)} | {(k, 40 + k) for k in range(5)} | {(90, 91), (91, 92)}
    g = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", rnd.choice([0.8, 1.0, 1.6, 1.8, 2.3])) for a, b in sorted(ends)], "a string, b string, weight double")
    rows = lambda **at: {r.node: (pytest.approx(r.betweenness, abs=1e-9), r.degree, r.is_articulation, r.path) for r in gr.centrality(g, **at).collect()}
    whole, blocks = rows(), rows(largest=2, block=7)
    assert len(whole) == len(blocks) == 48 - sum(all(k not in e for e in ends) for k in range(40))
    assert {k: (v[0].expected, *v[1:]) for k, v in blocks.items()} == whole
    assert [r.node for r in gr.bridges(g, largest=2).collect()] == [r.node for r in gr.bridges(g).collect()]


def test_paths_of_one_length_are_equal_whatever_their_size():
    rows = [("n0", "n1", 100000.1), ("n1", "n3", 200000.2), ("n0", "n2", 100000.2), ("n2", "n3", 200000.1), ("n3", "n4", 0.000001), ("n4", "n5", 70.7), ("n3", "n5", 70.700001)]
    at = lambda c: np.array([int(r[c][1:]) for r in rows], np.int32)
    got = gr._betweenness(gr._Links(6, at(0), at(1), np.array([r[2] for r in rows])), range(6)) / 20
    want = nx.betweenness([(*r[:2], round(r[2] * 1e6)) for r in rows])
    assert {f"n{k}": round(x, 9) for k, x in enumerate(got)} == pytest.approx(want)


@settings(max_examples=20, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)).filter(lambda e: e[0] < e[1]), min_size=1, max_size=10), st.sampled_from([(0.82, 0.94, 1.64), (0.1234567891, 0.7, 1.4), (1.0, 3000.0, 20000.0), (0.000001, 9000.0)]))
def test_betweenness_of_any_tiles_and_lengths_by_brute_force(ends, lengths):
    ends = sorted(ends | {(k, k + 1) for k in range(6)})  # one component
    rows = [(f"n{a}", f"n{b}", lengths[(3 * a + b) % len(lengths)]) for a, b in ends]
    a, b, w = (np.array(x) for x in zip(*[(*e, r[2]) for e, r in zip(ends, rows)]))
    with pytest.MonkeyPatch.context() as m:
        for name, value in (("TILE", 3), ("HEAVY", 3), ("AT_ONCE", 5), ("RUN", 4)):
            m.setattr(gr, name, value)
        got = gr._betweenness(gr._Links(7, a, b, w), range(7)) / 30
    want = nx.betweenness([(*r[:2], round(r[2] * 1e10)) for r in rows])
    assert {f"n{k}": round(x, 9) for k, x in enumerate(got)} == pytest.approx(want)


def test_a_block_of_sources_looks_for_no_cut_vertices(monkeypatch):
    monkeypatch.setattr(gr, "cut_vertices", None)  # they are found once, not once a block
    ends = [np.array(x, np.int32).tobytes() for x in ([0, 1], [1, 2])]
    r = SimpleNamespace(group_id="g", size=3, a=ends[0], b=ends[1], weight=np.array([1.0, 1.0]).tobytes(), first=0, after=1)
    assert gr._measure_block(r)[["pos", "betweenness"]].values.tolist() == [[1, 1.0]]


def test_bridges_do_not_depend_on_what_counts_as_a_hub(spark):
    rnd = random.Random(5)
    ids = [f"p{k:02}" for k in range(40)]
    ends = {(x, "hub") for x in ids[:12]} | {(x, "hub2") for x in ids[8:16]} | {("p30", x) for x in ids[14:22]} | {(rnd.choice(ids), rnd.choice(ids + ["x", "y"])) for _ in range(25)} | {("p38", "p39"), ("p39", "p37")}
    e, papers = spark.createDataFrame(sorted(ends), "src string, dst string"), spark.createDataFrame([(x,) for x in ids], "paper_id string")

    def rows(hub, **at):
        g = gr.combined(gr.in_library(e, papers), gr.cocitation(e, papers, hub), gr.coupling(e, papers, hub))
        return {r.node: (pytest.approx(r.betweenness, abs=1e-9), r.degree, r.is_articulation, r.path) for r in gr.centrality(g, **at).collect()}, gr.bridges(g, **{k: x for k, x in at.items() if k == "largest"}).collect()

    whole, best = rows(100)
    for hub, at in ((2, {}), (6, {}), (6, {"largest": 2, "block": 7})):
        got, top = rows(hub, **at)
        assert {k: (v[0].expected, *v[1:]) for k, v in got.items()} == whole
        assert top == best


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 6), min_size=2), st.booleans()), min_size=1, max_size=4), st.dictionaries(st.tuples(st.integers(0, 6), st.integers(0, 6)).filter(lambda e: e[0] < e[1]), st.sampled_from([12, 82, 100]), max_size=10), st.sampled_from([gr.SURE, 0]))
def test_links_by_hubs_count_as_if_each_were_made(hubs, own, sure):
    made = {}
    for a, b in ((a, b) for b in range(7) for a in range(b)):
        n = [sum({a, b} <= x for x, coupled in hubs if coupled is mark) for mark in (False, True)]
        by_hubs = sum(round(100 * base + min(200, 100 * k * each)) for k, (base, each) in zip(n, gr.SOFT.values()) if k)
        if by_hubs or (a, b) in own or a + 1 == b:
            made[a, b] = by_hubs + own.get((a, b), 0 if by_hubs else 100)
    given_ = [e for e in made if e in own or not any(set(e) <= x for x, _ in hubs)]
    links = lambda ends, *more: gr._Links(7, *np.array(ends, np.int32).reshape(-1, 2).T, np.array([made[e] / 100 for e in ends]), *more)
    members = [(v, k) for k, (x, _) in enumerate(hubs) for v in x]
    some = links(given_, (*np.array(members, np.int32).T, np.array([coupled for _, coupled in hubs])))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(gr, "SURE", sure)
        got = gr._betweenness(some, range(7)) / 30
    want = nx.betweenness([(f"n{a}", f"n{b}", w) for (a, b), w in made.items()])
    assert {f"n{k}": round(x, 9) for k, x in enumerate(got)} == pytest.approx(want)
    assert gr._joints(some).equals(gr._joints(links(list(made))))


def test_a_member_with_links_of_its_own_to_all_waits_for_other_members():
    # n0 is linked to n1 and n2, dearer than by the hub: no path to it has the hub's length
    a, b, w = np.array([0, 0], np.int32), np.array([1, 2], np.int32), np.array([1.82, 1.82])
    hubs = np.array([0, 1, 2], np.int32), np.zeros(3, np.int32), np.array([True])
    paths = gr._Paths(gr._Links(3, a, b, w, hubs))
    assert paths.distances(np.array([1]))[paths.row].ravel().tolist() == [91, 0, 41]


def test_missing_papers(spark):
    ext = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], "src string, dst string")
    info = spark.createDataFrame([("x", "Missing X", 2022, 120), ("y", "Y", 2021, 45)], "ref_id string, title string, pub_year int, citation_count int")
    papers = spark.createDataFrame([("a", "Alpha"), ("b", "Beta")], "paper_id string, title string")
    r = gr.missing(ext, info, papers).collect()
    assert [(x.title, x.support_count, x.score, x.path_examples) for x in r] == [("Missing X", 2, 8.4, "Alpha -> Missing X <- Beta")]


def test_a_hub_keeps_its_links_without_pairs(spark):
    papers = spark.createDataFrame([(f"p{k}",) for k in range(6)], "paper_id string")
    e = spark.createDataFrame([(f"p{k}", "hub") for k in range(5)] + [("p0", "r"), ("p1", "r"), (None, "r")], "src string, dst string")
    rows = gr.coupling(e, papers, hub=4).collect()
    assert [(r.a, r.b, r.weight) for r in rows if r.kind == "pair"] == [("p0", "p1", 2)]  # the common hub counts too
    assert sorted(r.a for r in rows if r.kind == "hub") == [f"p{k}" for k in range(5)]
    assert {r.node: r.degree for r in gr.degrees(gr.coupling(e, papers, hub=4)).collect()} == {f"p{k}": 4 for k in range(5)}
    full = gr.coupling(e, papers, hub=10).where(F.col("kind") == "pair")
    assert full.count() == 10


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 6)), min_size=1, max_size=40))
def test_degrees_do_not_depend_on_what_counts_as_a_hub(spark, links):
    papers = spark.createDataFrame([(f"p{k:02}",) for k in range(13)], "paper_id string")
    e = spark.createDataFrame([(f"p{a:02}", f"x{b}") for a, b in links], "src string, dst string")
    rows = lambda hub: {r.node: r.degree for r in gr.degrees(gr.coupling(e, papers, hub)).collect()}
    graph = lambda hub: gr.degrees(gr.combined(e.limit(0), gr.cocitation(e, papers, hub), gr.coupling(e, papers, hub)))
    assert rows(1) == rows(3) == rows(100) == {r.node: r.degree for r in graph(2).collect()}


def test_weights_count_the_hubs_that_only_one_relation_has(spark):
    papers = spark.createDataFrame([(f"p{k}",) for k in range(6)], "paper_id string")
    cit = spark.createDataFrame([("p0", "p1")], "src string, dst string")
    e = spark.createDataFrame([(f"p{k}", "hub") for k in range(5)], "src string, dst string")
    rows = lambda hub: {(r.kind, r.a, r.b): r.weight for r in gr.combined(cit, gr.cocitation(cit, papers, hub), gr.coupling(e, papers, hub)).collect()}
    assert rows(4)["pair", "p0", "p1"] == rows(10)["pair", "p0", "p1"] == 1.82
    assert ("hub", "p4", "coupling:hub") in rows(4) and len(rows(4)) == 6


def test_search_results_dedupe(spark):
    rows = [(1, "A", "10.1/X", "2020", "", None), (2, "a", "10.1/x ", "Unknown", "s" * 300, "u"), (3, "T!", None, None, None, None), (4, "t", "", "2020", None, None), (5, "t", "", "2021", None, None)]
    r = dd.dedupe_results(spark.createDataFrame(rows, "ord int, title string, doi string, published string, summary string, pdf_url string"), "ord").collect()
    assert sorted((x.key, x.ord, x.first_ord) for x in r) == [("doi:10.1/x", 2, 1), ("title:t", 4, 3)]
