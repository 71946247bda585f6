import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litmill.llm import components, fusion, splitting
from litmill.operators.packed_values import parse_packed

SOURCES = [("high", 3), ("low", 1), ("low", 1), (None, 9)]


def papers(spark, rows):
    schema = "canonical_id string, source string, updated_at timestamp_ntz, doi string, venue string, tags string, is_favorite string, k int, value string, claim int, field int"
    full = [(*r, 1, "x", 2, 3) for r in rows]
    return spark.createDataFrame(full, schema)


def survivors(spark, rows, keep=0.0):
    s = spark.createDataFrame(SOURCES, "source string, trust int")
    out = fusion.paper_fusion(papers(spark, rows), s).survivors(keep)
    return sorted((r.canonical_id, r.field_name, r.field_value) for r in out.collect())


def at(n):
    from datetime import datetime

    return datetime(2020, 1, n) if n else None


def test_trust_then_time_then_value(spark):
    rows = [
        ("c", "low", at(9), "doi:10.1234/LOW", "Low", "A; b", "no"),
        ("c", "high", at(1), " https://doi.example/10.1234/Old. ", "Cut…", "B|c", None),
        ("c", "high", at(2), "10.1234/new", "Unknown", None, "YES"),
        ("c", "high", None, "10.1234/none", " Good ", "", ""),
        ("single", "high", at(1), "10.1234/x", "V", "t", "yes"),
        (None, "high", at(1), "10.1234/x", "V", "t", "yes"),
        (None, "high", at(1), "10.1234/x", "V", "t", "yes"),
    ]
    assert survivors(spark, rows) == [("c", "doi", "10.1234/new"), ("c", "is_favorite", "true"), ("c", "tags", "a"), ("c", "tags", "b"), ("c", "tags", "c"), ("c", "venue", "Good")]


def test_no_usable_value_and_repeated_rows(spark):
    rows = [("c", None, None, "10.", "N/A", None, None)] * 3
    assert survivors(spark, rows) == [("c", "is_favorite", "false")]


def test_ties_take_the_smallest_value(spark):
    rows = [("c", "high", at(1), "10.1234/b", "AB", None, "n"), ("c", "high", at(1), "10.1234/a", "A", None, "n")]
    assert survivors(spark, rows) == [("c", "doi", "10.1234/a"), ("c", "is_favorite", "false"), ("c", "venue", "A")]


def test_empty_tables(spark):
    assert survivors(spark, []) == []
    s = spark.createDataFrame([], "source string, trust int")
    out = fusion.paper_fusion(papers(spark, [("c", "x", at(1), "10.1234/a", "V", "t", "n")] * 2), s).survivors(0.0)
    assert out.count() == 4


def made_by_known_sources(spark, n=4000):
    """n groups with a true value each; source k names it with SENSITIVITY[k], and each of three false ones with 1 - SPECIFICITY[k]."""
    import random

    rnd = random.Random(11)
    rows, truth = [], set()
    for g in range(n):
        truth |= {(f"g{g}", "t0"), (f"g{g}", "t1")}
        for k, (sens, spec) in enumerate(zip(SENSITIVITY, SPECIFICITY)):
            said = [v for v in ("t0", "t1") if rnd.random() < sens] + [v for v in ("f0", "f1", "f2") if rnd.random() > spec]
            rows.append((f"g{g}", f"s{k}" if k else None, None, None, None, "|".join(said), None))
    return rows, truth


SENSITIVITY, SPECIFICITY = (0.9, 0.6, 0.8, 0.5) + (0.7,) * 8, (0.95, 0.9, 0.6, 0.95) + (0.9,) * 8


def test_the_model_recovers_known_qualities_and_chooses_by_them(spark):
    rows, truth = made_by_known_sources(spark)
    trust = spark.createDataFrame([(f"s{k}", 1) for k in range(1, 12)], "source string, trust int")
    f = fusion.paper_fusion(papers(spark, rows), trust)
    got = {r.source: r for r in f.source_quality().where("field_name = 'tags'").collect()}
    assert len(got) == 12  # more sources than any fixed number of classes
    for k in range(12):
        # a source covers the groups in which it names anything, so its sensitivity is that among these
        named = [set(r[5].split("|")) for r in rows if r[1] == (f"s{k}" if k else None) and r[5]]
        assert abs(got[f"s{k}" if k else None].sensitivity - sum(len(v & {"t0", "t1"}) for v in named) / (2 * len(named))) < 0.05
    assert got["s2"].specificity < min(got[s].specificity for s in (None, "s1", "s3", "s4"))
    kept = {(r.canonical_id, r.field_value) for r in f.survivors(by_trust=False).where("field_name = 'tags'").collect()}
    assert len(kept & truth) > 0.95 * len(truth) and len(kept & truth) > 0.95 * len(kept)
    claimed = {(r.canonical_id, r.field_value) for r in f.survivors(keep=0.0).where("field_name = 'tags'").collect()}
    assert len(claimed & truth) < 0.6 * len(claimed)


def test_the_fit_is_the_same_on_the_driver_and_distributed(spark):
    rows, _ = made_by_known_sources(spark, 300)
    f = fusion.paper_fusion(papers(spark, rows), spark.createDataFrame([("s1", 1)], "source string, trust int"))
    one, two = ({(r.k, r.field, r.value): r.posterior for r in f.resolve(n)[0].collect()} for n in (10**9, 0))
    assert one.keys() == two.keys() and max(abs(one[k] - two[k]) for k in one) < 1e-6


def test_like_brute_force(spark, sf):
    d = spark.read.parquet(f"{sf}/papers.parquet")
    trust = {r.source: r.trust for r in spark.read.parquet(f"{sf}/paper_sources.parquet").collect()}
    groups = {}
    for r in d.where("canonical_id is not null").collect():
        groups.setdefault(r.canonical_id, []).append(r)
    want = set()
    bad = {"", "-", "n/a", "none", "null", "unknown"}
    for c, rs in groups.items():
        if len(rs) < 2:
            continue
        key = lambda r: (trust.get(r.source, 0), r.updated_at is not None, r.updated_at or at(1))
        dois = [(key(r), m[1]) for r in rs if r.doi and (m := re.match(r"\s*(?:doi:\s*|info:doi/|https?://[^/\s]+/)*(10\.\d{4,9}/\S*[^\s.])\.?\s*$", r.doi.lower()))]
        venues = [(key(r), r.venue.strip()) for r in rs if r.venue and r.venue.strip().lower() not in bad and not r.venue.rstrip().endswith(("…", "..."))]
        for f, v in (("doi", dois), ("venue", venues)):
            if v:
                best = max(k for k, _ in v)
                want.add((c, f, min(x for k, x in v if k == best)))
        want.add((c, "is_favorite", str(any((r.is_favorite or "").strip().lower() in ("1", "on", "true", "y", "yes") for r in rs)).lower()))
        want |= {(c, "tags", v.lower()) for r in rs for _, v, _ in parse_packed(r.tags)}
    out = fusion.paper_fusion(d, spark.read.parquet(f"{sf}/paper_sources.parquet")).survivors(0.0)
    assert {(r.canonical_id, r.field_name, r.field_value) for r in out.collect()} == want


def union_find(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(parent)}


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=50))
def test_components_like_union_find(spark, pairs):
    rows = [(f"{a:02}", f"{b:02}", 1, "z") for a, b in pairs]
    df = spark.createDataFrame([*rows, *rows[:3], (None, "01", 1, "z"), ("02", None, 1, "z")], "a string, b string, label int, u string")
    got = {r.id: r.label for r in components.connected_components(df, "a", "b").collect()}
    assert got == union_find([(a, b) for a, b, *_ in rows if a != b])


def test_long_chain_and_hub(spark):
    chain = [(f"n{k:04}", f"n{k + 1:04}") for k in range(300)]
    star = [("hub", f"s{k:04}") for k in range(300)]
    df = spark.createDataFrame(chain + star, "a string, b string")
    got = {r.id: r.label for r in components.connected_components(df, "a", "b").collect()}
    assert len(got) == 602 and set(got.values()) == {"n0000", "hub"}


def test_canonical_groups(spark):
    p = spark.createDataFrame([("doi:10.1/b", 1), ("doi:10.1/b", 2), ("arxiv:1", 3), ("openalex:W1", 4), (None, 5), ("alone", 6), ("", 7)], "canonical_id string, group_id int")
    e = spark.createDataFrame([(" DOI:10.1/B ", "ARXIV:1\t"), ("arxiv:1", "doi:10.1/b"), ("openalex:w1", "unknown"), ("unknown", "arxiv:1"), ("alone", "alone"), ("alone", "gone"), (None, "alone")], "paper_a string, paper_b string")
    got = sorted((r.canonical_id, r.group_id) for r in components.canonical_groups(p, e).collect())
    assert got == [("arxiv:1", "arxiv:1"), ("doi:10.1/b", "arxiv:1"), ("openalex:W1", "arxiv:1")]
    assert components.canonical_groups(p.limit(0), e).count() == 0
    assert components.canonical_groups(p, e.limit(0)).count() == 0


def pieces(spark, text, limit, overlap):
    df = spark.createDataFrame([("a", text, "x", 1)], "key string, t string, piece string, start int")
    return splitting.split_oversized(df, "key", "t", limit, overlap).orderBy("piece_no").collect()


@settings(max_examples=25, deadline=None)
@given(st.text("ab .!?\nü漢 ", min_size=0, max_size=300), st.integers(8, 60), st.integers(0, 7))
def test_pieces_cover_the_text(spark, text, limit, overlap):
    got = pieces(spark, text, limit, overlap)
    if len(text) <= limit or not text.strip():
        assert got == [] or len(text) > limit
        return
    seen = set()
    for k, r in enumerate(got):
        own = r.piece[len(r.piece) - r.body_length :]
        assert len(r.piece) <= limit and text[r.start - 1 : r.start - 1 + r.body_length] == own
        assert r.piece == text[max(0, r.start - 1 - overlap) : r.start - 1 + r.body_length]
        seen |= set(range(r.start - 1, r.start - 1 + r.body_length))
    assert all(text[k].isspace() for k in set(range(len(text))) - seen)


def needed(text, limit):
    for kind, sep in (("paragraph", r"\n\s*\n"), ("sentence", r"\n\s*\n|(?<=[.!?])\s+"), ("word", r"\s+")):
        if all(len(u.strip()) <= limit for u in re.split(sep, text)):
            return kind
    return "none"


@settings(max_examples=40, deadline=None)
@given(st.text("ab .!\n", min_size=21, max_size=200))
def test_boundary_like_brute_force(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(splitting.boundary_needed(F.col("t"), 20).alias("b")).first().b
    assert got == needed(text, 20)


def test_boundaries_of_papers(spark, sf):
    d = spark.read.parquet(f"{sf}/papers.parquet").where("length(documents) > 1000")
    want = {r.paper_id: needed(r.documents, 1000) for r in d.collect()}
    got = splitting.split_oversized(spark.read.parquet(f"{sf}/papers.parquet"), "paper_id", "documents").where("piece_no = 1")
    assert {r.paper_id: r.boundary for r in got.collect()} == want


def test_splitting_time_is_linear(spark):
    import time

    def took(n):
        df = spark.range(1).select(F.lit("a").alias("key"), F.concat(F.expr(f"repeat('The price of a thing. It rose again\n\n', {n // 40})"), F.expr(f"repeat('x', {n // 10})")).alias("t"))
        began = time.perf_counter()
        splitting.split_oversized(df, "key", "t").agg(F.sum(F.length("piece"))).collect()
        return time.perf_counter() - began

    took(1_000_000)
    assert took(16_000_000) < 8 * took(4_000_000) + 1


def test_splitting_edges(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", " " * 2000), ("d", "x" * 5000), ("e", "short"), ("f", "y " * 200_000)], "key string, t string")
    got = splitting.split_oversized(df, "key", "t")
    assert {r.key for r in got.select("key").distinct().collect()} == {"d", "f"}
    assert got.where("key = 'd'").first().boundary == "none"
    assert got.where("key = 'f'").agg(F.max(F.length("piece"))).first()[0] <= 1000
    assert splitting.split_oversized(df.limit(0), "key", "t").count() == 0
    with pytest.raises(ValueError):
        splitting.split_oversized(df, "key", "t", 100, 100)
