"""Bibliography formats: BibTeX, RIS, CSL-JSON, Zotero, reference lists. One text a paper, made in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.text import WS, arxiv_id, cite_key, extract_year, parse_tags, sanitize_latex, strings, strip, to_flag
from litmill.operators.ordering import numbered


def _given(c: str, *missing: str) -> Column:
    return F.when(F.col(c).isNotNull() & (F.col(c) != "") & ~strip(F.col(c)).isin(*missing), F.col(c))


def _names() -> Column:
    return F.filter(F.transform(F.coalesce("authors", strings()), strip), lambda a: a != "")


def with_cite_keys(papers: DataFrame, ord_: str) -> DataFrame:
    """papers with their cite_key; of equal keys the first stays, the second gets b, the third c and so on."""
    k = numbered(papers.withColumn("base", cite_key(F.col("authors"), F.col("published"))), "base", ord_)
    return k.withColumn("cite_key", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.char(96 + F.col("n"))))).drop("base", "n")


def bibtex(papers: DataFrame, ord_: str) -> DataFrame:
    """(ord, entry): a BibTeX entry of each paper."""
    p = with_cite_keys(papers, ord_)
    field = lambda name, v: F.concat(F.lit(f"  {name} = {{"), v, F.lit("},"))
    year = F.coalesce(extract_year(F.col("published")).cast("string"), F.lit("Unknown"))
    eprint = F.when(F.lower("entry_id").contains("arxiv"), arxiv_id(F.col("entry_id")))
    lines = F.array_compact(F.array(
        F.concat(F.lit("@article{"), F.col("cite_key"), F.lit(",")),
        field("title", sanitize_latex(F.coalesce("title", F.lit("Unknown Title")))),
        field("author", sanitize_latex(F.coalesce(F.array_join("authors", " and "), F.lit("Unknown")))),
        field("year", year), field("journal", sanitize_latex(_given("venue", "Unknown", "None", "N/A"))), field("doi", _given("doi", "Unknown", "None")),
        field("eprint", eprint), F.when(eprint.isNotNull(), F.lit("  archivePrefix = {arXiv},")), F.lit("}"),
    ))
    return p.select(ord_, F.array_join(lines, "\n").alias("entry"))


def ris(papers: DataFrame, ord_: str) -> DataFrame:
    """(ord, entry): a RIS record of each paper."""
    line = lambda tag, v: F.concat(F.lit(f"{tag}  - "), v)
    one = lambda tag, v: F.array(line(tag, v))
    many = lambda tag, a: F.transform(a, lambda x: line(tag, x))
    url = F.when(F.startswith(F.col("source"), F.lit("http")), F.col("source"))
    parts = F.array_compact(F.flatten(F.array(
        F.array(F.lit("TY  - JOUR")), one("TI", _given("title")), many("AU", _names()), one("PY", extract_year(F.col("published")).cast("string")),
        one("DO", _given("doi", "Unknown", "None")), one("JO", _given("venue", "Unknown", "None", "N/A", "")), one("UR", url), many("KW", parse_tags(F.col("tags"))),
        F.array(F.when(to_flag(F.col("is_favorite")), F.lit("N1  - Favorite: true"))), F.array(F.when(F.col("in_reading_list"), F.lit("N1  - ReadingList: true"))), F.array(F.lit("ER  - ")),
    )))
    return papers.select(ord_, F.array_join(parts, "\n").alias("entry"))


def csl(papers: DataFrame, ord_: str) -> DataFrame:
    """(ord, entry): CSL-JSON of each paper; unknown fields are left out."""
    year = extract_year(F.col("published"))
    entry = F.struct(
        F.coalesce(_given("canonical_id"), _given("entry_id"), F.col("title")).alias("id"), F.lit("article-journal").alias("type"), F.col("title"),
        F.transform(F.coalesce("authors", strings()), lambda a: F.struct(a.alias("literal"))).alias("author"),
        F.when(year.isNotNull(), F.struct(F.array(F.array(year)).alias("date-parts"))).alias("issued"), _given("doi", "Unknown", "None").alias("DOI"),
        _given("venue", "Unknown", "None", "N/A", "").alias("container-title"), F.when(F.startswith(F.col("source"), F.lit("http")), F.col("source")).alias("URL"),
    )
    return papers.select(ord_, F.to_json(entry).alias("entry"))


def creators(papers: DataFrame, ord_: str) -> DataFrame:
    """(ord, pos, last_name, first_name, name): the creators of each paper as Zotero splits them."""
    c = papers.select(ord_, F.posexplode(_names()).alias("pos", "a"))
    words = F.split("a", f"{WS}+")
    comma = F.col("a").contains(",")
    last = F.when(comma, strip(F.element_at(F.split("a", ",", 2), 1))).when(F.size(words) >= 2, F.element_at(words, -1))
    first = F.when(comma, strip(F.element_at(F.split("a", ",", 2), 2))).when(F.size(words) >= 2, F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    return c.select(ord_, "pos", last.alias("last_name"), first.alias("first_name"), F.when(last.isNull(), F.col("a")).alias("name"))


def zotero(papers: DataFrame, ord_: str) -> DataFrame:
    """(ord, entry): a Zotero item of each paper as JSON."""
    words = lambda a: F.split(a, f"{WS}+")
    split = lambda a: (
        F.when(a.contains(","), F.struct(F.lit("author").alias("creatorType"), strip(F.element_at(F.split(a, ",", 2), 1)).alias("lastName"), strip(F.element_at(F.split(a, ",", 2), 2)).alias("firstName"), F.lit(None).cast("string").alias("name")))
        .when(F.size(words(a)) >= 2, F.struct(F.lit("author").alias("creatorType"), F.element_at(words(a), -1).alias("lastName"), F.array_join(F.slice(words(a), 1, F.size(words(a)) - 1), " ").alias("firstName"), F.lit(None).cast("string").alias("name")))
        .otherwise(F.struct(F.lit("author").alias("creatorType"), F.lit(None).cast("string").alias("lastName"), F.lit(None).cast("string").alias("firstName"), a.alias("name")))
    )
    extra = F.array_compact(F.array(F.when(to_flag(F.col("is_favorite")), F.lit("Favorite: true")), F.when(F.col("in_reading_list"), F.lit("ReadingList: true")), F.concat(F.lit("CanonicalID: "), _given("canonical_id"))))
    s = lambda c: F.coalesce(c, F.lit(""))
    entry = F.struct(
        F.lit("journalArticle").alias("itemType"), s(F.col("title")).alias("title"), F.transform(_names(), split).alias("creators"), s(extract_year(F.col("published")).cast("string")).alias("date"),
        s(F.col("venue")).alias("publicationTitle"), s(F.col("doi")).alias("DOI"), s(F.when(F.startswith(F.col("source"), F.lit("http")), F.col("source"))).alias("url"),
        F.transform(parse_tags(F.col("tags")), lambda t: F.struct(t.alias("tag"))).alias("tags"), F.array_join(extra, "; ").alias("extra"),
    )
    return papers.select(ord_, F.to_json(entry).alias("entry"))


def reference_lines(papers: DataFrame, ord_: str) -> DataFrame:
    """(ord, line): `- authors (year). title. DOI: x.` of each paper."""
    a = F.coalesce(F.array_join("authors", ", "), F.lit("Unknown"))
    year = F.coalesce(extract_year(F.col("published")).cast("string"), F.lit("Unknown"))
    doi = F.coalesce(F.concat(F.lit(" DOI: "), _given("doi", "Unknown", "None"), F.lit(".")), F.lit(""))
    return papers.select(ord_, F.concat(F.lit("- "), a, F.lit(" ("), year, F.lit("). "), F.coalesce("title", F.lit("Unknown")), F.lit("."), doi).alias("line"))
