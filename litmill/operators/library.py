"""The library of papers: rolling records up, filtering, looking up, changing and novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.text import extract_year, is_unknown, normalize_title, parse_tags, strip, to_flag, to_int


def first(c: str, ord_: str) -> Column:
    return F.min_by(F.col(c), F.col(ord_))


def first_known(c: str, ord_: str) -> Column:
    """The first non-empty value in order."""
    return F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(ord_)))


def roll_up(chunks: DataFrame, ord_: str = "ord") -> DataFrame:
    """One row a title, in order of first appearance, from chunk rows.

    doi, source and published are those of the first row; venue the first non-empty; flags are true if
    any is; tags an ordered union without regard to case; parse_* counts the greatest; quality label
    of the row with the greatest score, the earliest among equals. Null titles form one group.
    """
    c = chunks.withColumn("q", F.struct(F.coalesce("parse_quality_score", F.lit(-1.0)).alias("s")))
    # a title's tags are made distinct before they are gathered, so a hot title gathers distinct tags only
    each = c.select("title", F.col(ord_).alias("o"), F.posexplode(parse_tags(F.col("tags"))).alias("k", "t"))
    once = each.groupBy("title", F.lower("t").alias("low")).agg(F.min(F.struct("o", "k", "t")).alias("x"))
    tags = once.groupBy(F.col("title").alias("tag_title")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ", ").alias("tags"))
    g = c.groupBy("title").agg(
        F.min(ord_).alias("first_ord"), F.count("*").alias("chunk_count"), first("doi", ord_).alias("doi"), first("source", ord_).alias("source"), first("published", ord_).alias("published"),
        first_known("venue", ord_).alias("venue"), F.bool_or(to_flag(F.col("is_favorite"))).alias("is_favorite"), F.bool_or(F.coalesce("in_reading_list", F.lit(False))).alias("in_reading_list"),
        F.max(to_int(F.col("parse_pages"))).alias("parse_pages"), F.max(to_int(F.col("parse_ocr_pages"))).alias("parse_ocr_pages"),
        F.max(F.coalesce("parse_quality_score", F.lit(0.0))).alias("parse_quality_score"), F.min_by("parse_quality_label", F.struct((-F.col("q.s")).alias("s"), F.col(ord_))).alias("parse_quality_label"),
    )
    return g.join(tags, g.title.eqNullSafe(tags.tag_title), "left").withColumn("tags", F.coalesce("tags", F.lit(""))).drop("tag_title")


def filter_library(papers: DataFrame, years: tuple[int, int] | None = None, source: str | None = None, author: str = "", tag: str = "", favorites: bool = False, reading: bool = False) -> DataFrame:
    """Papers that pass every given condition; papers without a year pass the years."""
    keep = F.lit(True)
    if years:
        y = extract_year(F.col("published"))
        keep &= y.isNull() | y.between(*years)
    if source:
        keep &= F.col("source") == source
    if author:
        keep &= F.coalesce(F.lower(F.array_join("authors", ", ")).contains(author.lower()), F.lit(False))
    if tag:
        keep &= F.coalesce(F.lower("tags").contains(tag.lower()), F.lit(False))
    if favorites:
        keep &= to_flag(F.col("is_favorite"))
    if reading:
        keep &= F.coalesce("in_reading_list", F.lit(False))
    return papers.where(keep)


def facets(papers: DataFrame) -> DataFrame:
    """(facet, value): least and greatest year, and each source that is not empty."""
    y = papers.agg(F.min(extract_year(F.col("published"))).alias("year_min"), F.max(extract_year(F.col("published"))).alias("year_max"))
    years = y.select(F.explode(F.map_from_arrays(F.array(F.lit("year_min"), F.lit("year_max")), F.array(F.col("year_min").cast("string"), F.col("year_max").cast("string")))).alias("facet", "value"))
    return years.unionByName(papers.where(F.coalesce("source", F.lit("")) != "").select(F.lit("source").alias("facet"), F.col("source").alias("value")).distinct())


def authors_unknown(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0) | ((F.size(c) == 1) & is_unknown(F.get(c, 0)))


def needs_fix(papers: DataFrame) -> DataFrame:
    """Papers of which authors, published, doi or venue is unknown."""
    return papers.where(authors_unknown(F.col("authors")) | is_unknown(F.col("published")) | is_unknown(F.col("doi")) | is_unknown(F.col("venue")))


def needs_enrichment(papers: DataFrame, recheck: bool = False) -> DataFrame:
    """Papers with a missing field, by the exact stand-ins Unknown, None and empty; on recheck also uploads."""
    miss = lambda c: F.col(c).isNull() | F.col(c).isin("Unknown", "None", "")
    lacking = F.col("authors").isNull() | (F.size("authors") == 0) | (F.array_join("authors", ", ").isin("Unknown", "None", "")) | miss("published") | miss("doi") | miss("venue")
    if recheck:
        lacking |= F.coalesce(F.startswith(F.col("entry_id"), F.lit("manual_")), F.lit(False)) | F.coalesce(F.endswith(F.col("source"), F.lit(".pdf")), F.lit(False))
    return papers.where(lacking)


def lookup(papers: DataFrame, titles: DataFrame, ord_: str = "paper_id") -> DataFrame:
    """(title_key, paper): the first paper of each wanted title, compared trimmed and in small letters."""
    key = F.lower(strip(F.col("title")))
    wanted = titles.select(key.alias("title_key")).distinct()
    return papers.withColumn("title_key", key).join(wanted, "title_key", "left_semi").groupBy("title_key").agg(F.min(ord_).alias(ord_))


def overlay(papers: DataFrame, match: Column, **new: Column) -> DataFrame:
    """All rows, those that match with the new values: the form an update takes on immutable data."""
    return papers.select(*[F.when(match, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in papers.columns])


def delete(papers: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return papers.join(keys.select(on).distinct(), on, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """old with new's values of `columns` where the key is known, and new's rows where it is not."""
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns], F.lit(True).alias("is_new"))
    j = old.join(n, key, "full_outer")
    return j.select(key, *[F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def novel(results: DataFrame, library: DataFrame) -> DataFrame:
    """Results of which neither the DOI nor the normalised title is in the library; stand-ins are no DOI."""
    doi = F.lower(strip(F.col("doi")))
    real = lambda df: df.where(~F.coalesce(F.col("doi"), F.lit("")).isin("Unknown", "", "None"))
    dois = real(library).select(doi.alias("known_doi")).distinct()
    titles = library.select(normalize_title(F.col("title")).alias("known_title")).where("known_title <> ''").distinct()
    r = results.withColumn("doi_key", F.when(~F.coalesce(F.col("doi"), F.lit("")).isin("Unknown", "", "None"), doi)).withColumn("title_key", normalize_title(F.col("title")))
    return r.join(dois, r.doi_key == dois.known_doi, "left_anti").join(titles, r.title_key == titles.known_title, "left_anti").drop("doi_key", "title_key")
