"""Consolidating pairwise matches into groups: connected components by minimum labels.

Each round gives every label the smallest label among itself and its neighbours and shortens the
resulting pointers by jumping - a pointer to a pointer becomes one pointer, which halves their
depth - until all point to local minima. Then all labels and all edges move along the pointers, and
edges inside a group and repeated ones are dropped. Only local minima remain as labels, at most half
of them, so rounds and jumps grow with the logarithm of the graph. Each step is written to the
shared checkpoint folder; the loop ends when no label changes, that is, when no edge between different labels is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.session import distinct_names, materialize, sized


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """(id, label) of every id that an edge to another id names; label is the smallest id of its group.

    Edges are undirected. Rows with a null end or with equal ends make no edge; repeated edges, also
    with exchanged ends, count once. An empty table gives no rows. Other columns are ignored.
    A hub of any degree is safe: minima and distinct edges are combined before the shuffle, and in
    every join the hub's side is the one that adaptive execution may split, since labels are unique
    on the other. Nothing of the graph is brought to the driver but the count of edges left.
    """
    pairs = distinct_names(edges, a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = materialize(pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    labels = materialize(e.select(F.col("u").alias("id")).union(e.select(F.col("v"))).distinct().withColumn("label", F.col("id")))
    for _ in range(max_rounds):
        if e.isEmpty():
            return labels
        # every end of an edge points to the smallest label around it
        p = e.select("u", "v").union(e.select(F.col("v"), F.col("u"))).groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("to"))
        p = _jumped(p)
        labels = materialize(labels.join(sized(p.drop("moved"), p), labels.label == F.col("x"), "left").select("id", F.coalesce("to", "label").alias("label")), labels)
        pu, pv = (sized(p.select(F.col("x").alias(x), F.col("to").alias(to)), p) for x, to in (("u", "a"), ("v", "b")))
        e = materialize(e.join(pu, "u").join(pv, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), e, p)
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def _jumped(p: DataFrame) -> DataFrame:
    """Pointers (x, to) with every `to` pointing to itself: jumped two at a time until none moves."""
    p = materialize(p.withColumn("moved", F.lit(True)))
    while not p.where("moved").isEmpty():
        q = sized(p.select(F.col("x").alias("to"), F.col("to").alias("next")), p)
        once = p.select("x", "to").join(q, "to").select("x", F.col("to").alias("was"), F.col("next").alias("to"))
        p = materialize(once.join(q, "to").select("x", F.col("next").alias("to"), (F.col("next") != F.col("was")).alias("moved")), p)
    return p


def id_key(c):
    """The form in which differently written ids are compared: no white space around, small letters."""
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def canonical_groups(papers: DataFrame, pairs: DataFrame) -> DataFrame:
    """(canonical_id, group_id) for every papers.canonical_id in a group of two or more different ones.

    group_id is the group's smallest canonical_id in character-code order. Ends are matched to
    papers.canonical_id without regard to case and surrounding white space; an end unknown to papers
    still links its neighbours but is not returned. Spellings of one id that differ in case or space
    only are members of one group if a pair names the id. Null and blank ids are in no group.
    """
    own = distinct_names(papers, "canonical_id").where("canonical_id is not null").distinct().withColumn("key", id_key(F.col("canonical_id"))).where("key <> ''")
    ends = distinct_names(pairs, "paper_a", "paper_b").select(id_key(F.col("paper_a")).alias("a"), id_key(F.col("paper_b")).alias("b")).where("a <> '' and b <> ''")
    labels = connected_components(ends, "a", "b")
    member = own.join(sized(labels), own.key == labels.id).select("canonical_id", "label")
    group = member.groupBy("label").agg(F.min("canonical_id").alias("group_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return member.join(group, "label").select("canonical_id", "group_id")
