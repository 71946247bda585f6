"""Networks of papers: citation, co-citation, coupling and co-authors, and what is recommended from them.

Pair relations are quadratic in the degree of the node they share. A node of more than `hub` links
is not expanded: its links are returned as they are, as rows of kind `hub`, from which every pair
of it follows; pairs are made of the other nodes, and their weights count common hubs too. No link
is lost, and no task holds a hub. Degrees and scores count the pairs that only hubs make as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.operators.dedupe import group_pairs
from litmill.operators.ordering import numbered
from litmill.session import materialize

HUB = 200


def citations(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of observed citations; rows with a null end are no citation."""
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def in_library(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """Citations between papers of the library; one of itself stays."""
    ids = papers.select("paper_id").distinct()
    e = citations(edges)
    return e.join(ids.withColumnRenamed("paper_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("paper_id", "dst"), "dst", "left_semi")


def external_refs(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(src, dst) of citations of works outside the library."""
    return citations(edges).join(papers.select(F.col("paper_id").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def _pairs(links: DataFrame, member: str, shared: str, hub: int) -> DataFrame:
    degree = links.groupBy(shared).agg(F.count("*").alias("n"))
    marked = links.join(degree, shared)
    cool = marked.where(F.col("n") <= hub).select(F.col(shared).alias("s"), F.col(member).alias("m"))
    pairs = cool.toDF("s", "a").join(cool.toDF("s", "b"), "s").where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))
    hubs = marked.where(F.col("n") > hub).select(F.col(member).alias("a"), F.col(shared).alias("b"), F.col("n").alias("weight"))
    both = _with_hubs(pairs, hubs.select(F.col("a").alias("node"), F.col("b").alias("hub")))
    pairs = both.select("a", "b", (F.col("weight") + F.size(F.array_intersect("hubs_a", "hubs_b"))).alias("weight"))
    return pairs.withColumn("kind", F.lit("pair")).unionByName(hubs.withColumn("kind", F.lit("hub"))).select("kind", "a", "b", "weight")


def _with_hubs(pairs: DataFrame, hubs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with the hubs of both ends; a node's hubs are no more than its own links."""
    of = hubs.groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    none = F.array().cast(of.schema["hubs"].dataType)
    for end in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(end), F.col("hubs").alias(f"hubs_{end}")), end, "left").withColumn(f"hubs_{end}", F.coalesce(f"hubs_{end}", none))
    return pairs


#: Nodes that one task counts the reach of hubs over, and kinds of nodes that it counts them for.
SPAN, KINDS = 1 << 18, 1 << 16


def linked(pairs: DataFrame, hubs: DataFrame, span: int = SPAN) -> DataFrame:
    """(node, degree): how many others each node is paired with, in pairs (a, b) or by a hub of both (node, hub).

    Nodes with the same hubs are counted as one kind; a kind reaches the union of its hubs' nodes. So
    no pair of a hub or of kinds is made, and none is counted twice.
    """
    own = _with_hubs(pairs.select("a", "b").distinct(), hubs).where(~F.arrays_overlap("hubs_a", "hubs_b")).select("a", "b")
    sets = materialize(hubs.groupBy("node").agg(F.array_sort(F.collect_set(F.xxhash64("hub"))).alias("hubs")).withColumn("kind", F.xxhash64("hubs")))
    reach = _reach(sets, span)
    return degree(own).unionByName(sets.join(reach, "kind").select("node", "degree")).groupBy("node").agg(F.sum("degree").alias("degree")).where("degree > 0")


def _reach(sets: DataFrame, span: int) -> DataFrame:
    """(kind, degree) of (node, hubs, kind): how many other nodes have one of its hubs, counted in spans of nodes."""
    kinds = materialize(sets.groupBy("kind").agg(F.first("hubs").alias("hubs")))
    spans = -(-max(sets.count(), 1) // span)
    tiles = max(-(-kinds.count() // KINDS), -(-sets.sparkSession.sparkContext.defaultParallelism // spans))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = kinds.select(every(spans).alias("span"), F.pmod("kind", F.lit(tiles)).cast("int").alias("tile"), "kind", "hubs").groupBy("span", "tile")
    there = sets.select(F.pmod(F.xxhash64("node"), F.lit(spans)).cast("int").alias("span"), every(tiles).alias("tile"), "hubs").groupBy("span", "tile")
    return asked.cogroup(there).applyInArrow(_reached, "kind bigint, degree bigint").groupBy("kind").agg((F.sum("degree") - 1).alias("degree"))


def _reached(asked: pa.Table, there: pa.Table) -> pa.Table:
    """How many of the nodes `there` have a hub of each kind: nodes of large hubs as bits, of small ones as lists."""
    lists = there["hubs"].combine_chunks() if len(there) else pa.array([], pa.list_(pa.int64()))
    hub, at = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()) if len(lists) else [])
    order = np.argsort(hub, kind="stable")
    names, first = np.unique(hub[order], return_index=True)
    few = dict(zip(names.tolist(), np.split(at[order], first[1:])))
    many = {h: few.pop(h) for h in [h for h, x in few.items() if len(x) > len(lists) / 64]}
    for h, x in many.items():
        mask = np.zeros(-(-len(lists) // 64) * 64, bool)
        mask[x] = True
        many[h] = np.packbits(mask).view(np.uint64)
    known: dict[tuple, tuple] = {(): (None, 0)}
    degrees = []
    for hubs in asked["hubs"].to_pylist() if len(asked) else ():
        large, small = tuple(h for h in hubs if h in many), [few[h] for h in hubs if h in few]
        if large not in known:
            if len(known) > 256:
                known = {(): (None, 0)}
            bits = np.bitwise_or.reduce([many[h] for h in large])
            known[large] = bits.view(np.uint8), int(np.bitwise_count(bits).sum())
        bits, n = known[large]
        if small:
            x = np.unique(np.concatenate(small)) if len(small) > 1 else small[0]
            n += len(x) if bits is None else int(((bits[x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 0).sum())
        degrees.append(n)
    return pa.table({"kind": asked["kind"] if len(asked) else pa.array([], pa.int64()), "degree": pa.array(degrees, pa.int64())})


def cocitation(edges: DataFrame, papers: DataFrame, hub: int = HUB) -> DataFrame:
    """(kind, a, b, weight): pairs of library papers cited by the same paper, and in how many papers."""
    return _pairs(in_library(edges, papers), "dst", "src", hub)


def coupling(edges: DataFrame, papers: DataFrame, hub: int = HUB) -> DataFrame:
    """(kind, a, b, weight): pairs of library papers that cite the same works, and how many."""
    e = citations(edges).join(papers.select(F.col("paper_id").alias("src")).distinct(), "src", "left_semi")
    return _pairs(e, "src", "dst", hub)


def cocited_at(cit: DataFrame) -> DataFrame:
    """(node, at): what links nodes by co-citation, the paper that cites them."""
    return cit.select(F.col("dst").alias("node"), F.col("src").alias("at"))


def coupled_at(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """(node, at): what links nodes by coupling, the work that they cite."""
    e = citations(edges).join(papers.select(F.col("paper_id").alias("src")).distinct(), "src", "left_semi")
    return e.select(F.col("src").alias("node"), F.col("dst").alias("at"))


def coauthors(papers: DataFrame, hub: int = HUB) -> DataFrame:
    """(kind, a, b, weight): pairs of names on the same paper, and on how many."""
    names = papers.select("paper_id", F.explode("authors").alias("name")).where("name is not null and trim(name) <> ''").distinct()
    return _pairs(names, "name", "paper_id", hub)


def combined(cit: DataFrame, coc: DataFrame, cou: DataFrame) -> DataFrame:
    """(kind, a, b, weight) of one undirected graph: citations weigh 1 each, the others by their softened counts.

    Rows of kind `pair` have the whole weight of a pair that a citation or an ordinary node makes.
    Rows of kind `hub` are (member, hub), the hubs marked `cocitation:` or `coupling:`: two members
    without a row of kind `pair` weigh what `soft_weight` gives for their common hubs of each mark.
    """
    marks = {"cocitation": coc, "coupling": cou}
    hubs = [df.where("kind = 'hub'").select("a", F.concat(F.lit(f"{mark}:"), "b").alias("b"), F.lit(None).cast("double").alias("weight")) for mark, df in marks.items()]
    hubs = hubs[0].unionByName(hubs[1])
    ends = cit.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.lit(1.0).alias("w"), F.lit("citation").alias("mark"))
    for mark, df in marks.items():
        ends = ends.unionByName(df.where("kind = 'pair'").select("a", "b", soft_weight(F.lit(mark), F.col("weight")).alias("w"), F.lit(mark).alias("mark")))
    pairs = ends.groupBy("a", "b").agg(F.sum("w").alias("w"), F.collect_set("mark").alias("marks"))
    # a relation that made no row for the pair may still join it by hubs
    both = _with_hubs(pairs, hubs.select(F.col("a").alias("node"), F.col("b").alias("hub")))
    common = F.array_intersect("hubs_a", "hubs_b")
    for mark in marks:
        n = F.size(F.filter(common, _marked(mark)))
        both = both.withColumn("w", F.col("w") + F.when((n > 0) & ~F.array_contains("marks", mark), soft_weight(F.lit(mark), n)).otherwise(0.0))
    return both.select(F.lit("pair").alias("kind"), "a", "b", F.round("w", 6).alias("weight")).unionByName(hubs.select(F.lit("hub").alias("kind"), "a", "b", "weight"))


def _marked(mark: str) -> Callable[[Column], Column]:
    return lambda hub: hub.startswith(f"{mark}:")


#: What a relation weighs at least and for each time that it links a pair, up to 2.
SOFT = {"cocitation": (0.8, 0.15), "coupling": (0.7, 0.12)}


def soft_weight(mark: Column, count: Column) -> Column:
    of = {k: base + F.least(F.lit(2.0), count * each) for k, (base, each) in SOFT.items()}
    return F.when(mark == "cocitation", of["cocitation"]).otherwise(of["coupling"])


def degrees(graph: DataFrame) -> DataFrame:
    """(node, degree) of a combined graph, hubs included."""
    return linked(graph.where("kind = 'pair'"), graph.where("kind = 'hub'").select(F.col("a").alias("node"), F.col("b").alias("hub")))


def degree(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, degree) of an undirected relation; a loop counts twice."""
    return pairs.select(F.col(a).alias("node")).unionAll(pairs.select(F.col(b).alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


#: Papers whose links are counted at once in the first, second and later rounds of `unread`, in words of 64.
ROUNDS = (1, 16, 64)


def unread(papers: DataFrame, cit: DataFrame, coc: DataFrame, cou: DataFrame, k: int = 10, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """The k papers outside the reading list with the most links.

    cit: citations (src, dst). coc, cou: distinct links (node, at); two nodes at the same place are
    linked. A paper has no more links than its places have other nodes, one by one; papers are
    counted in the order of that bound until none that is left can come among the k. No pair is made.
    """
    places = [materialize(x.select("node", "at")) for x in (coc, cou)]
    p = papers.where(~F.coalesce("in_reading_list", F.lit(False)))
    own = p.select("paper_id").distinct().join(degree(cit, "src", "dst").withColumnsRenamed({"node": "paper_id", "degree": "cit"}), "paper_id", "left")
    for name, links in zip(("coc", "cou"), places):
        others = links.join(links.groupBy("at").agg((F.count("*") - 1).alias("n")), "at").groupBy(F.col("node").alias("paper_id")).agg(F.sum("n").alias(name))
        own = own.join(others, "paper_id", "left")
    own = own.fillna(0, ["cit", "coc", "cou"])
    bound = materialize(own.select("paper_id", "cit", F.round(2.0 * F.col("cit") + 1.2 * F.col("coc") + 1.0 * F.col("cou"), 3).alias("bound")))
    best: list[tuple] = []
    order = lambda r: (-r[-1], r[0] is not None, r[0])
    rest, turn = bound, 0
    while True:
        n = 64 * rounds[min(turn, len(rounds) - 1)]
        batch = rest.orderBy(F.desc("bound"), "paper_id").limit(n).collect()
        if turn and len(best) == k:  # those behind the last of the k are neither counted nor in the result
            batch = [r for r in batch if order((r["paper_id"], r["bound"])) < order(best[-1])]
        counted = [_others([r["paper_id"] for r in batch], links) for links in places] if batch else []
        scored = [(r["paper_id"], r["cit"], x, y, round(2.0 * r["cit"] + 1.2 * x + 1.0 * y, 3)) for r, x, y in zip(batch, *counted)] if batch else []
        best = sorted(best + scored, key=order)[:k]
        if len(batch) < n:
            break
        last, turn = batch[-1], turn + 1
        after = F.col("paper_id").isNotNull() if last["paper_id"] is None else F.col("paper_id") > last["paper_id"]
        rest = bound.where((F.col("bound") < last["bound"]) | ((F.col("bound") == last["bound"]) & after))
    top = p.sparkSession.createDataFrame(best, f"top_id {dict(p.dtypes)['paper_id']}, citation_links bigint, cocitation_links bigint, coupling_links bigint, score double")
    j = p.select("paper_id", "title").join(F.broadcast(top), F.col("paper_id").eqNullSafe(F.col("top_id")))  # k rows
    return j.drop("top_id").orderBy(F.desc("score"), "paper_id").limit(k)


def _others(nodes: list, links: DataFrame) -> list[int]:
    """For each of these nodes how many others have a place (node, at) in common with it, by one bit a node."""
    asked = links.sparkSession.createDataFrame([(x, i // 64, (1 << i % 64) - (1 << 64 if i % 64 == 63 else 0)) for i, x in enumerate(nodes)], f"node {dict(links.dtypes)['node']}, word int, bit bigint")
    words = range(-(-len(nodes) // 64))
    bits = [F.bit_or(F.when(F.col("word") == j, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"m{j}") for j in words]
    at = links.join(F.broadcast(asked), "node").groupBy("at").agg(*bits)
    met = links.join(at, "at").groupBy("node").agg(*[F.bit_or(f"m{j}").alias(f"m{j}") for j in words]).drop("node")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(64 * len(words), np.int64)
        for batch in batches:
            for j, x in enumerate(batch.columns):
                n[64 * j : 64 * j + 64] += np.unpackbits(x.to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["i", "n"])

    n = {r["i"]: r["n"] for r in met.mapInArrow(count, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return [max(0, n.get(i, 0) - 1) for i in range(len(nodes))]


def missing(external: DataFrame, info: DataFrame, papers: DataFrame, k: int = 12) -> DataFrame:
    """The k works outside the library that most library papers cite, at least two, with who supports them."""
    named = external.join(papers.select(F.col("paper_id").alias("src"), F.coalesce("title", F.lit("Unknown")).alias("t")), "src")
    support = named.groupBy("dst").agg(F.count_distinct("src").alias("support_count"))
    i = info.select(F.col("ref_id").alias("dst"), F.col("title").alias("ref_title"), F.coalesce("pub_year", F.lit(0)).alias("y"), F.coalesce("citation_count", F.lit(0)).alias("c"))
    s = support.where("support_count >= 2").join(i, "dst", "left").fillna({"y": 0, "c": 0})
    score = 2.5 * F.col("support_count") + F.least(F.lit(3.0), F.log1p(F.greatest(F.lit(0), F.col("c")))) + F.when(F.col("y") >= 2018, 0.4).otherwise(0.0)
    top = s.withColumn("score", F.round(score, 4)).orderBy(F.desc("score"), F.desc("support_count"), "dst").limit(k)
    # six supporters of each of the k works, by title; a work's supporters are ranked, never listed whole
    from pyspark.sql import Window as W

    first = named.join(top.select("dst"), "dst", "left_semi").withColumn("rn", F.row_number().over(W.partitionBy("dst").orderBy(F.lower("t"), "src"))).where("rn <= 6")
    lists = first.groupBy("dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "t"))), lambda x: x["t"]).alias("supporters"))
    r = top.join(lists, "dst").withColumn("title", F.coalesce("ref_title", "dst"))
    return r.select(F.col("dst").alias("paper_id"), "title", "score", "support_count", F.array_join("supporters", "|").alias("supporting_titles"), F.array_join(_paths("supporters", "title", 3), "|").alias("path_examples"))


def _paths(names: str, title: str, most: int) -> Column:
    """`A -> X <- B` of pairs of names in order."""
    arrow = F.flatten(F.transform(names, lambda x, i: F.transform(F.slice(F.col(names), i + 2, F.lit(6)), lambda y: F.concat(x, F.lit(" -> "), F.col(title), F.lit(" <- "), y))))
    return F.when(F.size(names) > 1, F.slice(arrow, 1, most)).otherwise(F.array(F.concat(F.get(F.col(names), 0), F.lit(" -> "), F.col(title))))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges and density of a directed graph."""
    n = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
    return n.withColumn("density", F.round(F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0)), 8))


BRIDGE = "node string, betweenness double, degree int, is_articulation boolean, path string"


#: Source nodes whose shortest paths one task follows, at least, in a component that is measured in blocks; rows of
#: partial sums that a component has beyond which its blocks are made larger, as long as each core has four of them.
BLOCK, SUMS = 512, 1 << 24

PART = "group_id string, pos int, betweenness double, degree int, is_articulation boolean, left int, right int"


def centrality(graph: DataFrame, largest: int = 3000, block: int = BLOCK) -> DataFrame:
    """(node, betweenness, degree, is_articulation, path) of each node, component by component.

    Any two members of a hub are linked too, as combined() says, without a row for them; weights are
    multiples of 1e-6 then. Betweenness takes weights as path lengths and is normalised by the whole
    graph. It is exact in every component: one of up to `largest` nodes is measured in one task, a
    larger one in blocks of source nodes, which together cover all sources; one task more finds its
    cut vertices. Each task of a block holds its component's links, 16 bytes a link as they are sent
    and some 60 in work, 9 bytes for each hub of a member, and distances of up to `CELLS` pairs of
    nodes at once; the time grows as nodes x links, and for hubs as nodes x pairs of kinds of members.
    """
    if "kind" not in graph.columns:
        graph = graph.withColumn("kind", F.lit("pair"))
    rows = materialize(graph.select("kind", "a", "b", "weight"))
    g, hubs = rows.where("kind = 'pair'"), rows.where("kind = 'hub'")
    # for the components a member stands beside the first one of its hub
    star = hubs.join(hubs.groupBy("b").agg(F.min("a").alias("first")), "b").select("a", F.col("first").alias("b"))
    ends = g.select("a", "b").unionByName(star)
    nodes = ends.select(F.col("a").alias("node")).union(ends.select("b")).distinct()
    label = group_pairs(ends, "a", "b")
    size = label.groupBy("group_id").agg(F.count("*").alias("size"))
    label = label.join(size, "group_id")
    total = nodes.agg(F.count("*").alias("total"))
    rows = rows.where("kind = 'hub' or a <> b")
    small = rows.join(label.where(F.col("size") <= largest).withColumnRenamed("member", "a"), "a").crossJoin(total)

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs, hubs = pdf[pdf["kind"] == "pair"], pdf[pdf["kind"] == "hub"]
        nodes = np.unique(np.concatenate([pairs["a"], pairs["b"], hubs["a"]]))
        at = lambda x: np.searchsorted(nodes, x).astype(np.int32)
        links = _Links(len(nodes), at(pairs["a"]), at(pairs["b"]), pairs["weight"].to_numpy(float), _hubs_of(at(hubs["a"]), hubs["b"]))
        n, total = _joints(links), int(pdf["total"].iloc[0])
        between = _betweenness(links, range(len(nodes))) / (max(total - 1, 1) * (total - 2) if total > 2 else 1)
        name = lambda c: [None if pd.isna(k) else nodes[k] for k in n[c]]
        path = [None if x is None else f"{x} -> {v} -> {y}" for x, v, y in zip(name("left"), name("pos"), name("right"))]
        return pd.DataFrame({"node": nodes, "betweenness": between, "degree": n["degree"].astype(int), "is_articulation": n["is_articulation"].astype(bool), "path": path})

    exact = small.groupBy("group_id").applyInPandas(measure, BRIDGE)
    cores = g.sparkSession.sparkContext.defaultParallelism
    blocks = []
    for r in size.where(F.col("size") > largest).collect():
        step = max(block, min(r["size"] // (4 * cores), r["size"] ** 2 // SUMS))
        blocks += [(r["group_id"], -1, -1)] + [(r["group_id"], k, min(r["size"], k + step)) for k in range(0, r["size"], step)]
    return exact.unionByName(_in_blocks(rows, label.where(F.col("size") > largest), blocks, total)) if blocks else exact


def _in_blocks(rows: DataFrame, large: DataFrame, blocks: list[tuple], total: DataFrame) -> DataFrame:
    """The rows of centrality() for the components of `large`: members with their group_id and size."""
    at = materialize(numbered(large.select("group_id", F.col("member").alias("node"), "size"), "group_id", "node", "pos").withColumn("pos", F.col("pos") - 1))
    end = lambda c: at.select(F.col("node").alias(c), F.col("pos").alias(f"{c}_pos"))
    links = rows.join(at.select(F.col("node").alias("a"), F.col("pos").alias("a_pos"), "group_id", "size"), "a")
    pairs = links.where("kind = 'pair'").join(end("b"), "b").withColumn("hub", F.lit(None).cast("string"))
    members = links.where("kind = 'hub'").withColumns({"b_pos": F.lit(-1), "hub": F.col("b")})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        a, pairs = pdf["a_pos"].to_numpy(np.int32), pdf["b_pos"].to_numpy() >= 0
        ends = [a[pairs].tobytes(), pdf["b_pos"].to_numpy(np.int32)[pairs].tobytes(), pdf["weight"].to_numpy(np.float64)[pairs].tobytes()]
        members = [x.tobytes() for x in _hubs_of(a[~pairs], pdf["hub"][~pairs])]
        return pd.DataFrame([(pdf["group_id"].iloc[0], int(pdf["size"].iloc[0]), *ends, *members)], columns=["group_id", "size", "a", "b", "weight", "member", "hub", "coupled"])

    both = [x.select("group_id", "size", "a_pos", "b_pos", "weight", "hub") for x in (pairs, members)]
    packed = both[0].unionByName(both[1]).groupBy("group_id").applyInPandas(pack, "group_id string, size int, a binary, b binary, weight binary, member binary, hub binary, coupled binary")
    spark = rows.sparkSession
    # a task for each block, -1 is that of the cut vertices; the links go to the executors once, not once a block
    todo = spark.createDataFrame(blocks, "group_id string, first int, after int").coalesce(1).repartition(len(blocks))

    def measure(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for r in pdf.itertuples():
                yield _measure_block(r)

    parts = todo.join(F.broadcast(materialize(packed)), "group_id").mapInPandas(measure, PART)
    one = parts.groupBy("group_id", "pos").agg(F.sum("betweenness").alias("sum"), F.max("degree").alias("degree"), F.bool_or("is_articulation").alias("is_articulation"), F.max("left").alias("left"), F.max("right").alias("right"))
    name = lambda c: at.select("group_id", F.col("pos").alias(c), F.col("node").alias(f"{c}_node"))
    named = one.join(name("pos"), ["group_id", "pos"]).join(name("left"), ["group_id", "left"], "left").join(name("right"), ["group_id", "right"], "left").crossJoin(total)
    scale = F.when(F.col("total") > 2, 1.0 / ((F.col("total") - 1) * (F.col("total") - 2))).otherwise(1.0)
    path = F.concat("left_node", F.lit(" -> "), "pos_node", F.lit(" -> "), "right_node")
    return named.select(F.col("pos_node").alias("node"), (F.col("sum") * scale).alias("betweenness"), "degree", "is_articulation", path.alias("path"))


def bridges(graph: DataFrame, k: int = 10, largest: int = 3000) -> DataFrame:
    """The k papers that hold the graph together: of degree two or more, on shortest paths or cut vertices."""
    c = centrality(graph, largest).where("degree >= 2 and (betweenness > 0 or is_articulation or path is not null)")
    score = 2.0 * F.coalesce("betweenness", F.lit(0.0)) + F.when(F.coalesce("is_articulation", F.lit(False)), 0.20).otherwise(0.0) + F.least(F.lit(0.25), F.col("degree") * 0.03)
    return c.select("node", F.round(score, 4).alias("bridge_score"), F.round("betweenness", 4).alias("betweenness"), "degree", "is_articulation", "path").orderBy(F.desc("bridge_score"), "node").limit(k)


def _hubs_of(member: np.ndarray, hub: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members, numbers of their hubs, and whether each hub is one of coupling."""
    names, number = np.unique(hub.to_numpy(str), return_inverse=True)
    return member, number.astype(np.int32), np.strings.startswith(names, "coupling:")


class _Links:
    """The links of a component as arrays: the neighbours of v are near[ptr[v]:ptr[v + 1]], in order.

    Members of its hubs are linked as well, see _Hubs; those links are not in the arrays.
    """

    def __init__(self, size: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, hubs: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.a, self.b, self.weight = a, b, weight
        here, near = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((near, here))
        self.near, self.link = near[order], (order % max(len(a), 1)).astype(np.int32)
        self.ptr = np.searchsorted(here[order], np.arange(size + 1))
        self.degree = np.diff(self.ptr)
        self.hubs = _Hubs(size, *hubs) if hubs and len(hubs[0]) else None

    def __iter__(self) -> Iterator[int]:
        return iter(range(len(self.degree)))

    def __getitem__(self, v: int) -> list[int]:
        return self.near[self.ptr[v] : self.ptr[v + 1]].tolist()

    def degrees(self) -> np.ndarray:
        """How many neighbours each node has, those by hubs too."""
        if not self.hubs:
            return self.degree
        return self.degree + self.hubs.reached() - np.bincount(np.concatenate(self.within()[:2]), minlength=len(self.degree))

    def within(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ends of the links between members of one hub, and how many hubs of each mark both are in."""
        kinds = self.hubs.kind_of[self.a], self.hubs.kind_of[self.b]
        some = np.flatnonzero((kinds[0] >= 0) & (kinds[1] >= 0))
        pairs, at = np.unique(kinds[0][some] * len(self.hubs.sets) + kinds[1][some], return_inverse=True)
        pairs = np.stack(np.divmod(pairs, len(self.hubs.sets)))
        common = np.zeros((2, pairs.shape[1]), np.int64)
        for first, after in _runs(pairs[0]):
            near, *n = self.hubs.near(int(pairs[0][first]))
            k = np.minimum(np.searchsorted(near, pairs[1][first:after]), len(near) - 1)
            common[:, first:after] = np.where(near[k] == pairs[1][first:after], np.stack(n)[:, k], 0)
        n = common[:, at]
        on = np.flatnonzero(n.sum(0))
        return self.a[some[on]], self.b[some[on]], n[0, on], n[1, on]

    def joined(self) -> _Links:
        """Links of the same cut vertices, sides and first two neighbours: a hub's members beside its first three,
        which leaves them together without any one of them, as all its pairs do."""
        if not self.hubs:
            return self
        size, at = len(self.degree), lambda x, y: np.minimum(x, y).astype(np.int64) * len(self.degree) + np.maximum(x, y)
        ends = [at(self.a, self.b)]
        order = np.lexsort((self.hubs.member, self.hubs.hub))
        for first, after in _runs(self.hubs.hub[order]):
            x = self.hubs.member[order[first:after]]
            ends += [at(x[k], x[k + 1 :]) for k in range(min(3, len(x)))]
        a, b = (x.astype(np.int32) for x in np.divmod(np.unique(np.concatenate(ends)), size))
        return _Links(size, a, b, np.ones(len(a)))


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """(first, after) of the runs of equal values."""
    cuts = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(cuts, cuts[1:])) if len(x) else []


#: Pairs of kinds of members that are kept once found; more are found anew each time.
KEPT = 1 << 21


class _Hubs:
    """Hubs of a component: any two of a hub's members are linked, at a weight that follows from how many
    hubs of each mark they share, unless a link of theirs is given. Members of the same hubs are one kind;
    `nodes` has them kind by kind, kind k from start[k] on, and no pair of members is made."""

    def __init__(self, size: int, member: np.ndarray, hub: np.ndarray, coupled: np.ndarray):
        self.member, self.hub = np.unique(np.stack([member, hub]), axis=1)
        self.coupled = coupled
        known: dict[bytes, int] = {}
        kind = np.full(size, -1)
        for first, after in _runs(self.member):
            kind[self.member[first]] = known.setdefault(self.hub[first:after].tobytes(), len(known))
        self.kind_of = kind
        self.nodes = np.flatnonzero(kind >= 0)
        self.nodes = self.nodes[np.argsort(kind[self.nodes], kind="stable")]
        self.kind = kind[self.nodes]
        self.start = np.searchsorted(self.kind, np.arange(len(known) + 1))
        self.sets = [np.frombuffer(x, self.hub.dtype) for x in known]
        hubs, self.set_ptr = np.concatenate(self.sets), np.cumsum([0, *map(len, self.sets)])
        order = np.argsort(hubs, kind="stable")
        self.set_hubs, self.kinds = hubs, np.repeat(np.arange(len(known)), np.diff(self.set_ptr))[order]
        self.kinds_ptr = np.searchsorted(hubs[order], np.arange(len(coupled) + 1))
        self.most = [max(int((coupled[x] == mark).sum()) for x in self.sets) for mark in (False, True)]

    def near(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The kinds that share a hub with kind k, itself too, and how many of co-citation and of coupling."""
        n = []
        for mark in (False, True):
            hubs = self.sets[k][self.coupled[self.sets[k]] == mark]
            n.append(np.bincount(np.concatenate([self.kinds[self.kinds_ptr[h] : self.kinds_ptr[h + 1]] for h in hubs] or [[]]).astype(np.intp), minlength=len(self.sets)))
        some = np.flatnonzero(n[0] + n[1])
        return some, n[0][some], n[1][some]

    def reached(self) -> np.ndarray:
        """How many other nodes each node shares a hub with."""
        sizes, n = np.diff(self.start), np.zeros(len(self.kind_of), np.int64)
        n[self.nodes] = np.array([sizes[self.near(k)[0]].sum() - 1 for k in range(len(sizes))])[self.kind]
        return n

    def weights(self) -> np.ndarray:
        """What members weigh that share i hubs of co-citation and j of coupling, at [i, j]."""
        of = [np.where(n := np.arange(most + 1), base + np.minimum(2.0, n * each), 0.0) for most, (base, each) in zip(self.most, (SOFT["cocitation"], SOFT["coupling"]))]
        return np.round(of[0][:, None] + of[1], 6)

    def highest(self, x: np.ndarray) -> np.ndarray:
        """For each kind the highest value of the members of its hubs."""
        of = np.maximum.reduceat(x, self.start[:-1])
        return np.maximum.reduceat(np.maximum.reduceat(of[self.kinds], self.kinds_ptr[:-1])[self.set_hubs], self.set_ptr[:-1])


#: Sources whose distances are taken at once, at most, and cells of their table, if four sources have no more.
AT_ONCE, CELLS = 64, 1 << 24
#: Nodes that are relaxed together, and links of a node beyond which it is relaxed by itself.
TILE, HEAVY = 1024, 256
#: Links that are looked at together for being on a shortest path.
RUN = 1 << 15
#: Kinds of members whose links are followed before it is asked again which others matter.
KINDS_AT_ONCE = 8
#: Shortest paths of a node up to which those of some members are taken off from those of all; else members are added one by one.
SURE = 1e9


class _Paths:
    """Shortest paths within a component. Nodes are rows, in the order of their degrees, so that
    nodes of a tile have links of the same rank: those are relaxed at once, for all sources at once.

    Weights that are multiples of 1e-6 are whole numbers of their common unit, so paths of one length
    compare exactly; others compare to 1e-12. Distances take the narrowest type that holds them.

    Links by hubs are followed from kind to kind. Two members with a link of their own have none by
    hubs; that one weighs less or the same, so what it would add to all others' is taken off.
    """

    def __init__(self, links: _Links):
        self.size = len(links.degree)
        self.row = np.empty(self.size, np.intp)
        self.row[np.argsort(-links.degree, kind="stable")] = np.arange(self.size)
        self.links, self.hubs, self.near_kinds, self.kept = links, links.hubs, {}, 0
        if self.hubs:
            table = self.hubs.weights()
            every = _units(np.concatenate([links.weight, table.ravel()]))
            if every.dtype == np.float64:
                raise ValueError("weights of a graph with hubs have to be multiples of 1e-6")
            self.weight, self.table = every[: len(links.weight)], every[len(links.weight) :].reshape(table.shape)
            self.at = np.full(self.size, -1)
            self.at[self.hubs.nodes] = np.arange(len(self.hubs.nodes))
            self.at_row = np.full(self.size, -1)
            self.at_row[self.row] = self.at
            self.within = (*(x := links.within())[:2], self.table[x[2], x[3]])
            a, b = (self.at[x] for x in self.within[:2])
            near = np.concatenate([b, a])
            order = np.argsort(np.concatenate([a, b]), kind="stable")
            self.beside, self.beside_ptr = near[order], np.searchsorted(np.sort(np.concatenate([a, b])), np.arange(len(self.hubs.nodes) + 1))
            self.most_beside = int(np.diff(self.beside_ptr).max())
        else:
            self.weight, self.table = _units(links.weight), np.zeros((1, 1))
        self.longest = max(self.weight.max(initial=0), self.table.max())
        self.kinds = [np.float64] if self.weight.dtype == np.float64 else [np.uint16, np.uint32, np.float64]
        while self.longest > self._most() / 4:
            self.kinds.pop(0)
        self._prepare()

    def _most(self) -> float:
        return np.inf if self.kinds[0] == np.float64 else int(np.iinfo(self.kinds[0]).max)

    def _prepare(self) -> None:
        links, weight = self.links, self.weight.astype(self.kinds[0])
        node = np.argsort(-links.degree, kind="stable")
        degree, ptr = links.degree[node], links.ptr[node]
        self.single, self.tiles = [], []
        heavy = int((degree > HEAVY).sum())
        for v in range(heavy):
            e = slice(ptr[v], ptr[v] + degree[v])
            self.single.append((v, self.row[links.near[e]], weight[links.link[e], None]))
        for first in range(heavy, self.size, TILE):
            falling = -degree[first : first + TILE]
            for rank in range(degree[first]):
                after = first + int(np.searchsorted(falling, -rank))
                e = ptr[first:after] + rank
                self.tiles.append((first, after, self.row[links.near[e]], weight[links.link[e], None]))
        a, b = self.row[links.a], self.row[links.b]
        some = np.lexsort((b, a))
        some = some[weight[some] > 0]  # a link of no length is on no path between its ends
        self.a, self.b, self.length = a[some], b[some], weight[some]
        width = self.length.min(initial=self.length.max(initial=1))
        if self.hubs:
            by_hubs = self.table[self.table > 0].min().astype(width.dtype)
            width = min(width, by_hubs) if len(self.length) else by_hubs
            self.less = (self.row[self.within[0]], self.row[self.within[1]], self.within[2].astype(self.kinds[0]))
            self.near_kinds, self.kept = {}, 0
        self.width = width * 0.999 if self.kinds[0] == np.float64 else width

    def distances(self, nodes: np.ndarray) -> np.ndarray:
        """From these nodes, a column each, to all rows."""
        far = np.inf if self.kinds[0] == np.float64 else self._most() - int(self.longest)
        dist = np.full((self.size, len(nodes)), far, self.kinds[0])
        dist[self.row[nodes], np.arange(len(nodes))] = 0
        through, before = np.empty((TILE, len(nodes)), dist.dtype), None
        while before is None or not np.array_equal(before, dist):
            before = dist.copy()
            for v, near, weight in self.single:
                np.minimum(dist[v], (dist[near] + weight).min(0), out=dist[v])
            for first, after, near, weight in self.tiles:
                x = np.take(dist, near, axis=0, out=through[: after - first], mode="clip")
                x += weight
                np.minimum(dist[first:after], x, out=dist[first:after])
            if self.hubs:
                rows = self.row[self.hubs.nodes]
                members = np.ascontiguousarray(dist[rows].T)
                for x in members:
                    self._by_hubs(x)
                dist[rows] = members.T
        if dist.max() <= self._most() / 2:
            return dist
        self.kinds.pop(0)
        self._prepare()
        return self.distances(nodes)

    def _near(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The kinds that share a hub with kind k and what their members weigh with its own."""
        if k in self.near_kinds:
            return self.near_kinds[k]
        near, i, j = self.hubs.near(k)
        found = near, self.table[i, j].astype(self.kinds[0])
        if self.kept + len(near) <= KEPT:
            self.kept += len(near)
            self.near_kinds[k] = found
        return found

    def _members(self, kinds: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All members of these kinds, by their places among the hubs' nodes, each with the weight of its kind."""
        first, n = self.hubs.start[kinds], self.hubs.start[kinds + 1] - self.hubs.start[kinds]
        return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(weight, n)

    def _across(self, row: int, dist: np.ndarray, way: int) -> np.ndarray:
        """Rows of the members whose links by hubs to this one are on shortest paths, before it (-1) or beyond it (1)."""
        k = self.at_row[row]
        to, weight = self._members(*self._near(int(self.hubs.kind[k])))
        far = dist[self.row[self.hubs.nodes[to]]].astype(np.int64) - int(dist[row])
        to = to[far == way * weight.astype(np.int64)]
        return self.row[self.hubs.nodes[np.setdiff1d(to, self.beside[self.beside_ptr[k] : self.beside_ptr[k + 1]])]]

    def _by_hubs(self, x: np.ndarray) -> None:
        """Shortens distances of members, in the order of the hubs' nodes, by the links from all members."""
        start, done = self.hubs.start, np.zeros(len(self.hubs.sets), bool)
        lowest = self.table[self.table > 0].min().astype(x.dtype)
        while True:  # the nearest kinds first; from most others nobody is nearer then
            least = np.minimum.reduceat(x, start[:-1])
            kinds = np.flatnonzero(~done & (least + lowest < self.hubs.highest(x)))
            if not len(kinds):
                return
            kinds = kinds[np.argsort(least[kinds], kind="stable")[:KINDS_AT_ONCE]]
            done[kinds] = True
            for k in kinds.tolist():
                self._from_kind(k, least[k], x)

    def _from_kind(self, k: int, least: np.number, x: np.ndarray) -> None:
        """Shortens distances of members by the links from those of kind k, the nearest of which is at `least`."""
        start = self.hubs.start
        near, weight = self._near(k)
        some = np.flatnonzero(np.maximum.reduceat(x, start[:-1])[near] > least + weight)  # others are near enough
        to, weight = self._members(near[some], weight[some])
        own, level, first = x[start[k] : start[k + 1]].copy(), None, int(start[k])
        while True:
            left = own if level is None else own[own > level]
            if not len(left):
                break
            level = left.min()
            nearer = level + weight < x[to]
            to, weight = to[nearer], weight[nearer]
            if not len(to):
                break
            # those with links of their own to all at this level wait for the next
            apart = ~np.isin(to, self._linked_to_all(first + np.flatnonzero(own == level)))
            x[to[apart]] = level + weight[apart]
            to, weight = to[~apart], weight[~apart]

    def _linked_to_all(self, members: np.ndarray) -> np.ndarray:
        """The members that are, or have a link of their own to, each of these."""
        if len(members) > self.most_beside + 1:  # nobody has links to as many
            return members[:0]
        first, n = self.beside_ptr[members], self.beside_ptr[members + 1] - self.beside_ptr[members]
        near = self.beside[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())]
        x, count = np.unique(np.concatenate([near, members]), return_counts=True)
        return x[count == len(members)]

    def _on(self, dist: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the links whose lengths the distances differ by, the nearer one first."""
        ends = []
        near, beyond = np.empty(RUN, dist.dtype), np.empty(RUN, dist.dtype)
        for k in range(0, len(a), RUN):
            x, y, w = a[k : k + RUN], b[k : k + RUN], length[k : k + RUN]
            d = np.take(dist, y, out=beyond[: len(w)], mode="clip")
            d -= np.take(dist, x, out=near[: len(w)], mode="clip")
            d = np.minimum(d, -d) if dist.dtype != np.float64 else np.abs(d)  # whole numbers have no sign here
            on = np.flatnonzero(d == w if dist.dtype != np.float64 else np.abs(d - w) < 1e-12)
            ends.append((x[on], y[on]))
        u, v = (np.concatenate(x) for x in zip(*ends)) if ends else (a, b)
        turned = dist[u] > dist[v]
        return np.where(turned, v, u), np.where(turned, u, v)

    def _classes(self, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Members of one kind at one distance are a class: that of each member, the classes' distances,
        and those from which and to which a link by hubs is on a shortest path."""
        d = dist[self.row[self.hubs.nodes]].astype(np.int64)
        span = int(d.max()) + 1
        keys, of = np.unique(self.hubs.kind * span + d, return_inverse=True)
        kind, level = keys // span, keys % span
        links = []
        for first, after in _runs(kind):
            near, weight = self._near(int(kind[first]))
            before = level[first:after, None] - weight.astype(np.int64)
            key = near * span + before
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            to, k = np.nonzero((keys[at] == key) & (before >= 0))
            links.append((at[to, k].astype(np.int32), (first + to).astype(np.int32)))
        return of, level, *(np.concatenate(x) for x in zip(*links))

    def shares(self, s: int, dist: np.ndarray, one_by_one: bool = False) -> np.ndarray:
        """What the shortest paths from row s, all at these distances, add to the betweenness of each row.

        A link on a path is longer than a band of distances is wide, so it leads to a later band: each
        link is taken once, band by band, for the number of paths and once more back for their shares.
        """
        u, v = self._on(dist, self.a, self.b, self.length)
        sign = None
        if self.hubs:
            less = self._on(dist, *self.less)
            own = np.zeros((2, self.size), bool)
            if one_by_one:
                own[0, less[1]] = own[1, less[0]] = True
                less = less[0][:0], less[1][:0]
            sign = np.repeat([1.0, -1.0], [len(u), len(less[0])])
            u, v = np.concatenate([u, less[0]]), np.concatenate([v, less[1]])
        band = dist // self.width
        band = band.astype(np.min_scalar_type(int(band.max())))[v]
        order = np.argsort(band, kind="stable")
        u, v, band, sign = u[order], v[order], band[order], None if sign is None else sign[order]
        cuts = np.unique(band)
        if self.hubs:
            rows = self.row[self.hubs.nodes]
            of, level, near, beyond = self._classes(dist)
            class_band = (level // self.width).astype(np.int64)
            order = np.argsort(class_band[of], kind="stable")
            rows, of = rows[order], of[order]
            order = np.argsort(class_band[beyond], kind="stable")
            near, beyond = near[order], beyond[order]
            cuts = np.unique(np.concatenate([cuts, class_band]))
            cut = lambda x: list(zip(np.searchsorted(x, cuts), np.searchsorted(x, cuts, "right")))
            members = [(rows[i:j], of[i:j], near[k:m], beyond[k:m]) for (i, j), (k, m) in zip(cut(class_band[of]), cut(class_band[beyond]))]
            sum_of = lambda at, x: np.bincount(at, x, len(level))
            into, out = np.zeros(len(level)), np.zeros(len(level))
        bands = [(u[i:j], v[i:j], None if sign is None else sign[i:j]) for i, j in zip(np.searchsorted(band, cuts), np.searchsorted(band, cuts, "right"))]
        paths = np.zeros(self.size)
        paths[s] = 1.0
        for k, (u, v, sign) in enumerate(bands):
            paths += np.bincount(v, paths[u] if sign is None else sign * paths[u], self.size)
            if self.hubs:
                rows, of, near, beyond = members[k]
                x = sum_of(beyond, into[near])[of]
                for i in np.flatnonzero(own[0, rows]):
                    x[i] = paths[self._across(rows[i], dist, -1)].sum()
                paths[rows] += x
                into += sum_of(of, paths[rows])
        if self.hubs and not one_by_one and paths.max() > SURE:
            return self.shares(s, dist, True)
        share = np.zeros(self.size)
        for k, (u, v, sign) in reversed(list(enumerate(bands))):
            if self.hubs:
                rows, of, near, beyond = members[k]
                x = out[of]
                for i in np.flatnonzero(own[1, rows]):
                    beyond_it = self._across(rows[i], dist, 1)
                    x[i] = ((1.0 + share[beyond_it]) / paths[beyond_it]).sum()
                share[rows] += paths[rows] * x
                out += sum_of(near, sum_of(of, (1.0 + share[rows]) / paths[rows])[beyond])
            x = paths[u] / paths[v] * (1.0 + share[v])
            share += np.bincount(u, x if sign is None else sign * x, self.size)
        share[s] = 0.0
        return np.maximum(share, 0.0)  # what is taken off for links of their own may leave -1e-13


def _units(weight: np.ndarray) -> np.ndarray:
    """Weights as whole numbers of their common unit, as they are if that is under 1e-6."""
    whole = np.rint(weight * 1e6)
    if not (np.abs(whole / 1e6 - weight) < 1e-12).all() or whole.min() < 0 or whole.max() >= 1 << 50:
        return weight.astype(np.float64)
    whole = whole.astype(np.int64)
    return whole // max(np.gcd.reduce(whole), 1)


def _betweenness(links: _Links, sources: range) -> np.ndarray:
    """The shares of all nodes from these sources."""
    paths, between = _Paths(links), np.zeros(len(links.degree))
    step = max(4, min(AT_ONCE, CELLS // len(between)))
    for k in range(sources.start, sources.stop, step):
        nodes = np.arange(k, min(k + step, sources.stop))
        for v, dist in zip(nodes, np.ascontiguousarray(paths.distances(nodes).T)):
            between += paths.shares(paths.row[v], dist)
    return between[paths.row]


def _measure_block(r) -> pd.DataFrame:
    hubs = [np.frombuffer(x, kind) for x, kind in ((r.member, np.int32), (r.hub, np.int32), (r.coupled, bool))] if hasattr(r, "member") else None
    links = _Links(r.size, np.frombuffer(r.a, np.int32), np.frombuffer(r.b, np.int32), np.frombuffer(r.weight, np.float64), hubs)
    if r.first < 0:
        out = _joints(links).assign(betweenness=0.0)
    else:
        between = _betweenness(links, range(r.first, r.after))
        some = np.flatnonzero(between)
        out = pd.DataFrame({"pos": some, "betweenness": between[some], "degree": None, "is_articulation": None, "left": None, "right": None})
    return out.assign(group_id=r.group_id)[["group_id", "pos", "betweenness", "degree", "is_articulation", "left", "right"]]


def _joints(links: _Links) -> pd.DataFrame:
    """A row for each node: its degree, whether it is a cut vertex, and two neighbours that it joins."""
    degree, links = links.degrees(), links.joined()
    cut = cut_vertices(links)
    two = [(None, None) if links.degree[v] < 2 else cut[v] if v in cut else tuple(links[v][:2]) for v in links]
    return pd.DataFrame({"pos": list(links), "degree": degree, "is_articulation": [v in cut for v in links], "left": pd.array([x for x, _ in two], "Int32"), "right": pd.array([x for _, x in two], "Int32")})


def cut_vertices(near: _Links) -> dict[int, tuple[int, int]]:
    """Nodes whose removal parts their component, by one depth-first search without recursion; each with
    two neighbours that it alone joins, its first and the first that cannot be reached from that one."""
    found, low, apart = {}, {}, {}
    for root in near:
        if root in found:
            continue
        found[root] = low[root] = len(found)
        stack = [(root, None, iter(near[root]))]
        while stack:
            v, parent, it = stack[-1]
            for u in it:
                if u == parent:
                    continue
                if u in found:
                    low[v] = min(low[v], found[u])
                else:
                    found[u] = low[u] = len(found)
                    stack.append((u, v, iter(near[u])))
                    break
            else:
                stack.pop()
                if stack:
                    p = stack[-1][0]
                    low[p] = min(low[p], low[v])
                    if low[v] >= found[p]:  # what was found from v on is cut off without p
                        apart.setdefault(p, []).append((found[v], len(found)))
        if len(apart.get(root, ())) == 1:
            del apart[root]
    cut = {}
    for v, parts in apart.items():
        side = [next((first for first, after in parts if first <= found[u] < after), None) for u in near[v]]
        other = next(k for k, x in enumerate(side) if x != side[0])
        cut[v] = near[v][0], near[v][other]
    return cut
