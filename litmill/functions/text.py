"""Scalar functions over text, titles, names and identifiers: Column in, Column out, all inside the JVM.

Patterns use explicit ASCII classes, so results do not depend on an engine's idea of \\w or \\s.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from litmill.functions.rules import ACADEMIC_WORDS, STOPWORDS, TRUE_WORDS

WS = r"[ \t\n\x0B\f\r]"
NO_STRINGS = "array<string>"


def strings() -> Column:
    return F.array().cast(NO_STRINGS)


def strip(c: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.regexp_replace(c, rf"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def is_unknown(c: Column, words: tuple[str, ...] = ("", "unknown", "none", "null")) -> Column:
    """Null, or one of the stand-ins for missing, without regard to case and blanks around."""
    return c.isNull() | F.lower(strip(c)).isin(*words)


def known(c: Column) -> Column:
    return F.when(~is_unknown(c), c)


def normalize_title(c: Column) -> Column:
    """Small letters and digits only; empty for null."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in small letters, in order, with repetition."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(c: Column, min_len: int = 3) -> Column:
    """Distinct tokens in order of appearance, without stop words and short ones."""
    return F.array_distinct(F.filter(tokens(c), lambda t: ~t.isin(*STOPWORDS) & (F.length(t) >= min_len)))


def content_tokens(c: Column, min_len: int = 4) -> Column:
    """Tokens that may carry a topic: no stop words, none of the words every paper has, none short."""
    return F.filter(tokens(c), lambda t: ~t.isin(*STOPWORDS, *ACADEMIC_WORDS) & (F.length(t) >= min_len))


def last_names(authors: Column) -> Column:
    """Distinct last names of an author list: before the comma, else the last word; small letters and digits."""

    def one(a: Column) -> Column:
        words = F.filter(F.split(strip(a), f"{WS}+"), lambda w: w != "")
        last = F.when(a.contains(","), F.element_at(F.split(a, ","), 1)).otherwise(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))
        return F.regexp_replace(F.lower(last), "[^a-z0-9]", "")

    return F.array_distinct(F.filter(F.transform(F.coalesce(authors, strings()), one), lambda w: w != ""))


def extract_year(c: Column) -> Column:
    """The first four digits in a row, as int; null if there are none."""
    return F.when(c.rlike("[0-9]{4}"), F.regexp_extract(c, "([0-9]{4})", 1)).cast("int")


def arxiv_id(c: Column) -> Column:
    return _found(c, r"([0-9]{4}\.[0-9]{4,5})(v[0-9]+)?", 1)


def openalex_id(c: Column) -> Column:
    """The last path segment of an address at openalex.org."""
    return F.when(F.lower(c).contains("openalex.org"), F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1))


def normalize_doi(c: Column) -> Column:
    """Without the resolver's or scheme's prefix, in small letters; prefixes are matched as written."""
    t = strip(F.coalesce(c, F.lit("")))
    bare = reduce(lambda x, p: F.replace(x, F.lit(p), F.lit("")), ("https://doi.org/", "http://doi.org/", "doi:"), t)
    return F.lower(strip(bare))


def canonical_id(title: Column, published: Column, doi: Column, entry: Column) -> Column:
    """DOI, else arXiv, else OpenAlex id, else a hash of title and date."""
    d = normalize_doi(F.when(~is_unknown(doi), doi))
    title_key = F.concat(F.lower(strip(F.coalesce(title, F.lit("")))), F.lit(":"), F.coalesce(published, F.lit("")))
    return F.coalesce(
        F.when(d != "", F.concat(F.lit("doi:"), d)),
        F.concat(F.lit("arxiv:"), arxiv_id(entry)),
        F.concat(F.lit("openalex:"), openalex_id(entry)),
        F.concat(F.lit("title:"), F.substring(F.sha1(title_key), 1, 12)),
    )


def _found(c: Column, pattern: str, group: int = 0) -> Column:
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def looks_like_identifier(c: Column) -> Column:
    t = strip(F.coalesce(c, F.lit("")))
    low = F.lower(t)
    return low.rlike(r"^[0-9]{4}\.[0-9]{4,5}(v[0-9]+)?$") | (low.startswith("10.") & low.contains("/")) | low.contains("arxiv:") | low.contains("doi:")


def snippet(text: Column, terms: Column, window: int = 360) -> Column:
    """A window of the text around the first term found, else its beginning; dots where it is cut."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    at = F.array_min(F.filter(F.transform(terms, lambda w: F.position(w, low)), lambda p: p > 0))
    start = F.when(at.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), at - 1 - window // 2))
    end = F.least(F.length(t), start + window)
    cut = strip(F.substring(t, start + 1, end - start))
    return F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), cut, F.when(end < F.length(t), F.lit("...")).otherwise(F.lit("")))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def highlight(text: Column, terms: tuple[str, ...]) -> Column:
    """Escaped for HTML, with the terms of three or more characters marked, longest first."""
    use = sorted({t for t in terms if len(t) >= 3}, key=lambda t: (-len(t), t))
    safe = html_escape(F.coalesce(text, F.lit("")))
    return F.regexp_replace(safe, "(?i)(" + "|".join(use) + ")", "<mark>$1</mark>") if use else safe


def short_snippet(c: Column, most: int = 220) -> Column:
    t = collapse(F.coalesce(c, F.lit("")))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most), rf"{WS}+$", ""), F.lit("...")))


def clean_extracted(c: Column) -> Column:
    """No NUL, one kind of line end, no blanks before it, at most one blank line in a row."""
    t = F.replace(F.coalesce(c, F.lit("")), F.lit("\0"), F.lit(""))
    t = F.regexp_replace(t, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(t, "[ \t]+\n", "\n"), "\n{3,}", "\n\n")


def strip_tags(c: Column) -> Column:
    """Text without markup tags, white space collapsed."""
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def doi_candidates(c: Column) -> Column:
    """Distinct DOIs in a text, sorted, without closing punctuation."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"10\.[0-9]{4,9}/[-._;()/:a-zA-Z0-9]+"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda d: F.regexp_replace(d, r"[.,;)\]]+$", "")), lambda d: F.length(d) >= 7)))


def title_words(c: Column) -> Column:
    """Distinct words of more than two characters that are no numbers."""
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) > 2) & ~t.rlike("^[0-9]+$")))


def titles_similar(q: Column, t: Column, threshold: float = 0.2) -> Column:
    """Word overlap of two titles: Jaccard at the threshold, or four fifths of the shorter one."""
    a, b = title_words(q), title_words(t)
    common = F.size(F.array_intersect(a, b))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.coalesce(some & ((jaccard(a, b) >= threshold) | (common / F.least(F.size(a), F.size(b)) >= 0.8)), F.lit(False))


def title_in_text(title: Column, text: Column, threshold: float = 0.6) -> Column:
    """Whether enough of the title's words, with repetition, occur in the text."""
    words, body = tokens(title), F.array_distinct(tokens(text))
    hit = F.size(F.filter(words, lambda w: F.array_contains(body, w)))
    return F.coalesce((F.size(words) > 0) & (hit / F.greatest(F.lit(1), F.size(words)) >= threshold), F.lit(False))


def parse_tags(c: Column) -> Column:
    """Tags split at commas and semicolons; of those alike but for case the first stays."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), strip), lambda t: t != "")
    lows = F.transform(parts, F.lower)
    return F.filter(F.transform(parts, lambda t, k: F.when(F.array_position(lows, F.lower(t)) == k + 1, t)), lambda t: t.isNotNull())


def to_flag(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def to_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))


def sanitize_latex(c: Column) -> Column:
    """Special characters of LaTeX, escaped one kind after the other."""
    for a, b in (("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cite_key(authors: Column, published: Column) -> Column:
    """Letters of the first author's last name and the year."""
    first = F.coalesce(F.try_element_at(F.coalesce(authors, strings()), F.lit(1)), F.lit("Unknown"))
    last = F.when(first.contains(","), F.element_at(F.split(first, ","), 1)).otherwise(F.coalesce(F.try_element_at(F.split(strip(first), f"{WS}+"), F.lit(-1)), F.lit("Unknown")))
    letters = F.regexp_replace(last, "[^a-zA-Z]", "")
    return F.concat(F.when(letters == "", F.lit("Unknown")).otherwise(letters), F.coalesce(extract_year(published).cast("string"), F.lit("Unknown")))


def article_snippet(c: Column) -> Column:
    """At most 1,000 characters; of longer texts the first 700 and the last 300."""
    t = F.coalesce(c, F.lit(""))
    return F.when(F.length(t) <= 1000, t).otherwise(F.concat(F.substring(t, 1, 700), F.lit(" ... "), F.right(t, F.lit(300))))


def safe_filename(c: Column) -> Column:
    """A file name from a title: no extension, no slashes, plain characters, at most 150 of them."""
    t = F.regexp_replace(F.coalesce(c, F.lit("paper")), r"(?i)\.pdf$", "")
    t = F.regexp_replace(F.translate(t, "/\\", "  "), rf"{WS}+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[^a-zA-Z0-9 \-_().,\[\]]", ""), r"^[ .]+|[ .]+$", "")
    return F.substring(F.when(t == "", F.lit("paper")).otherwise(t), 1, 150)


def title_of_filename(c: Column) -> Column:
    """File name without folder and extension, underscores and hyphens as blanks."""
    base = F.element_at(F.split(c, "/"), -1)
    return strip(F.translate(F.regexp_replace(base, r"(?i)\.pdf$", ""), "_-", "  "))


def download_url(pdf_url: Column, source: Column, entry: Column) -> Column:
    """The given address, else arXiv's for the last segment of the entry id."""
    made = F.concat(F.lit("https://arxiv.org/pdf/"), F.element_at(F.split(entry, "/"), -1), F.lit(".pdf"))
    return F.coalesce(F.when(pdf_url != "", pdf_url), F.when((F.lower(source) == "arxiv") & (F.coalesce(entry, F.lit("")) != ""), made))


def split_fixed(c: Column, width: int) -> Column:
    """Slices of a fixed width; none for an empty text."""
    n = F.ceil(F.length(c) / F.lit(width)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(c, k * width + 1, F.lit(width)))).otherwise(strings())


def fast_sentences(c: Column) -> Column:
    """Sentences by mark, blank and capital letter, without scraps, very long ones and formulas."""
    parts = F.split(F.translate(F.coalesce(c, F.lit("")), "\n\r", "  "), rf"(?<=[.!?]){WS}+(?=[A-Z])")
    return F.filter(
        F.transform(parts, strip),
        lambda s: F.length(s).between(20, 500) & s.rlike("[A-Za-z]") & (F.length(s) - F.length(F.translate(s, "=", "")) <= 3) & (F.length(s) - F.length(F.translate(s, "{", "")) <= 2),
    )


def plain_sentences(c: Column) -> Column:
    """Sentences by mark and blank, of more than 20 characters."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), rf"(?<=[.!?]){WS}+"), strip), lambda s: F.length(s) > 20)
