"""Upkeep of a library as set operations: metadata filled from answers, one record against all, merging, reports.

What a queue of single updates would do to a mutable store is one plan here: an update gives the rows
anew, a merge keeps one row a group, and a report counts what either changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.rules import TITLE_JUNK, TITLE_STOPS
from litmill.functions.text import canonical_id, is_unknown, normalize_doi, strip, title_in_text
from litmill.operators.dedupe import blocked, doi_block, merge_groups, met, score_pairs, sieve
from litmill.operators.library import authors_unknown, needs_fix
from litmill.operators.ordering import numbered
from litmill.session import materialize


def title_key(c: Column) -> Column:
    return F.lower(strip(c))


def identity(canonical: str = "canonical_id", entry: str = "entry_id", title: str = "title") -> Column:
    """What tells records apart: the canonical id, else the entry id, else the title."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(some(canonical), some(entry), F.col(title), F.lit(""))


def first_answers(answers: DataFrame) -> DataFrame:
    """The answer to each title key, by priority and then ord: key, title, authors, published, doi, venue.

    answers: ord, priority, found, title, authors, published, doi, venue. Answers that found nothing
    and those without a title are none.
    """
    key = title_key(F.col("title"))
    a = answers.where("found").select(key.alias("key"), "priority", "ord", F.struct("title", "authors", "published", "doi", "venue").alias("x")).where("key <> ''")
    return a.groupBy("key").agg(F.min_by("x", F.struct("priority", "ord")).alias("x")).select("key", "x.*")


def with_metadata(papers: DataFrame, answers: DataFrame) -> DataFrame:
    """All papers with `updated`: where a field is unknown and an answer to the title knows it, the answer's, and the ids computed anew.

    An answered paper that lacks anything counts as updated. Rows, repeated ones too, stay as many.
    """
    a = first_answers(answers).toDF("key", *(f"a_{c}" for c in ("title", "authors", "published", "doi", "venue")))
    lacking = needs_fix(papers).select("paper_id").distinct().withColumn("lacking", F.lit(True))
    j = papers.join(lacking, "paper_id", "left").withColumn("key", title_key(F.col("title"))).join(a, "key", "left")
    j = j.withColumn("updated", F.coalesce(F.col("lacking") & F.col("a_title").isNotNull(), F.lit(False)))
    take = lambda c, unknown: F.when(F.col("updated") & unknown(F.col(c)) & ~unknown(F.col(f"a_{c}")), F.col(f"a_{c}")).otherwise(F.col(c))
    j = j.withColumns({"authors": take("authors", authors_unknown), "published": take("published", is_unknown), "doi": take("doi", is_unknown), "venue": take("venue", is_unknown)})
    doi = F.when(F.col("updated") & ~is_unknown(F.col("doi")), normalize_doi(F.col("doi"))).otherwise(F.col("doi"))
    j = j.withColumn("doi", doi)
    new_id = canonical_id(F.col("title"), F.col("published"), F.col("doi"), F.col("entry_id"))
    return j.withColumn("canonical_id", F.when(F.col("updated"), new_id).otherwise(F.col("canonical_id"))).select(*papers.columns, "updated")


def one_against_all(seeds: DataFrame, keys: DataFrame, least: float = 0.84, sequence: bool = True) -> DataFrame:
    """Scored pairs (paper_a a seed, paper_b any other record) with at least that combined score.

    seeds and keys are as `dedupe.pair_keys` gives them. Above 0.75 a pair shares a family name, the
    DOI or the id, so seeds meet the library there and nowhere else;
    without the sequence ratio, at one of the rarest title words with one of the rarest family names
    of both. No record is left out.
    """
    if least <= 0.75:
        raise ValueError("a score of 0.75 needs no shared name, DOI or id")
    if sequence:
        blocks = F.array_compact(F.concat(F.transform("names", lambda n: F.concat(F.lit("n:"), n)), F.array(doi_block(), F.when(F.col("cid") != "", F.concat(F.lit("i:"), F.col("cid"))))))
        side = lambda df, s: df.select(F.explode(F.array_distinct(blocks)).alias("block"), *[F.col(c).alias(f"{c}_{s}") for c in df.columns])
        pairs = side(seeds, "a").join(side(keys, "b"), "block").where("ord_a <> ord_b").drop("block").dropDuplicates(["ord_a", "ord_b"])
    else:
        keys = materialize(keys)
        mine = materialize(blocked(seeds, keys, least, F.lit("")))
        # of the library only the rows of blocks that a seed may be in are sent
        pairs = met(mine, blocked(keys, keys, least, F.lit(""), sieve(mine, "block")), least)
    return score_pairs(pairs, sequence).where(F.col("combined_score") >= least)


def merge_duplicates(papers: DataFrame, group: str, ord_: str) -> DataFrame:
    """The library after merging: of each group of two or more the kept record with the merged fields, all other records as they are."""
    m = merge_groups(papers, group, ord_).select(F.col("keep").alias(ord_), *[F.col(c).alias(f"m_{c}") for c in ("doi", "venue", "is_favorite", "in_reading_list", "tags")], F.col("members"))
    gone = papers.where(F.col(group).isNotNull()).join(m.select(ord_).join(papers.select(ord_, group), ord_).select(group, F.col(ord_).alias("kept")), group).where(F.col(ord_) != F.col("kept")).select(ord_)
    j = papers.join(gone, ord_, "left_anti").join(m, ord_, "left")
    merged = F.col("members").isNotNull()
    fields = {c: F.when(merged, F.col(f"m_{c}").cast(dict(papers.dtypes)[c])).otherwise(F.col(c)) for c in ("doi", "venue", "is_favorite", "in_reading_list", "tags")}
    return j.select(*[fields[c].alias(c) if c in fields else F.col(c) for c in papers.columns])


def maintenance_report(seeds: DataFrame, papers: DataFrame, answers: DataFrame, keys: DataFrame, least: float = 0.84, sequence: bool = True) -> DataFrame:
    """(paper_id, metadata_updates, dedupe_groups, dedupe_removed, reindexed_chunks) of the upkeep after each seed was added.

    seeds: paper_id and title. metadata_updates counts the rows under the seed's title if it lacks a
    field and has an answer; dedupe_removed the other records of the library, told apart by identity,
    that are duplicates of it; reindexed_chunks the rows under its title.
    """
    key = title_key(F.col("title"))
    s = seeds.select("paper_id", key.alias("key")).where("key <> ''")
    rows = papers.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    lacking = needs_fix(papers).select("paper_id").distinct().withColumn("lacking", F.lit(True))
    answered = first_answers(answers).select("key", F.lit(True).alias("answered"))
    own = papers.select(F.col("paper_id"), identity().alias("who"))
    pairs = one_against_all(keys.join(seeds.select(F.col("paper_id").alias("ord")), "ord", "left_semi"), keys, least, sequence).select("paper_a", "paper_b")
    others = pairs.join(own.toDF("paper_a", "who_a"), "paper_a").join(own.toDF("paper_b", "who_b"), "paper_b").where("who_a <> who_b").groupBy(F.col("paper_a").alias("paper_id")).agg(F.count_distinct("who_b").alias("removed"))
    j = s.join(rows, "key", "left").join(lacking, "paper_id", "left").join(answered, "key", "left").join(others, "paper_id", "left")
    removed = F.coalesce("removed", F.lit(0))
    return j.select(
        "paper_id", F.when(F.col("lacking") & F.col("answered"), F.col("n")).otherwise(0).alias("metadata_updates"), F.when(removed > 0, 1).otherwise(0).alias("dedupe_groups"),
        removed.alias("dedupe_removed"), F.coalesce("n", F.lit(0)).alias("reindexed_chunks"),
    )


def enrichment_report(papers: DataFrame, answers: DataFrame) -> DataFrame:
    """(paper_id, success): whether the title of each paper has an answer whose title its text bears out."""
    a = first_answers(answers).select("key", F.col("title").alias("answer"))
    j = papers.select("paper_id", title_key(F.col("title")).alias("key"), "documents").join(a, "key", "left")
    return j.select("paper_id", (F.col("answer").isNotNull() & title_in_text(F.col("answer"), F.coalesce("documents", F.lit("")))).alias("success"))


def title_candidates(text: Column) -> Column:
    """What may be the title of a first page: its first good line, the first two, and the first four without asterisks.

    Only the first twenty lines are looked at, up to an abstract or introduction. Short lines, lines
    with words that titles lack, and codes of more than two fifths digits are passed over.
    """
    lines = F.filter(F.transform(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 20), strip), lambda x: F.length(x) >= 3)
    junk = lambda x: F.exists(F.array(*map(F.lit, TITLE_JUNK)), lambda w: F.contains(F.lower(x), w))
    lines = F.filter(lines, lambda x: ~junk(x))
    stop = lambda x: F.contains(F.lower(x), F.lit(TITLE_STOPS[0])) | F.startswith(F.lower(x), F.lit(TITLE_STOPS[1]))
    lines = F.aggregate(lines, F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("stop")), lambda s, x: F.struct(F.when(s["stop"] | stop(x), s["out"]).otherwise(F.concat(s["out"], F.array(x))).alias("out"), (s["stop"] | stop(x)).alias("stop")), lambda s: s["out"])
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    good = F.filter(lines, lambda x: ~(x.rlike(r"^[\w\-.:\s,]+$") & (digits(x) > F.length(x) * 0.4)))
    two, four = F.array_join(F.slice(good, 1, 2), " "), F.translate(F.array_join(F.slice(good, 1, 4), " "), "*", "")
    return F.array_compact(F.array(F.get(good, F.lit(0)), F.when(F.size(good) > 1, two), F.when(F.size(good) > 2, four)))


def systematic_sample(df: DataFrame, order: str, most: int = 5000) -> DataFrame:
    """Every step-th row in the order of a distinct column, from the first, step being rows // most but at least 1."""
    n = df.count()
    step = max(1, n // max(1, min(n, most)))
    return numbered(df.withColumn("_all", F.lit(0)), "_all", order, "_no").where((F.col("_no") - 1) % step == 0).drop("_all", "_no")


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows with equal keys the first in order, as (keys, order); null keys are keys too."""
    return rows.groupBy(*keys).agg(F.min(order).alias(order))


def external_ids(papers: DataFrame, known: DataFrame) -> DataFrame:
    """(paper_id, ref_id): papers with the title of a known outside work, compared by letters and digits; unknown titles have none."""
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]", "")
    p = papers.where(~is_unknown(F.col("title"))).select("paper_id", plain("title").alias("key"))
    k = known.select("ref_id", plain("title").alias("key")).where("key not in ('', 'unknown')").groupBy("key").agg(F.min("ref_id").alias("ref_id"))
    return p.join(k, "key").select("paper_id", "ref_id")
