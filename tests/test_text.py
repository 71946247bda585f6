import pytest
from pyspark.sql import functions as F

from litmill.functions import text as tx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first().x


def test_canonical_id_of_title_and_of_doi(spark):
    df = spark.createDataFrame([("Test Paper", "2024", None, None), ("Test Paper", "2024", "https://doi.org/10.1000/ABC", "http://arxiv.org/abs/1234.56789v2"), ("T", "", "Unknown", "https://openalex.org/W12/"), ("T", "", "", "http://arxiv.org/abs/1234.56789v2")], "t string, p string, d string, e string")
    got = [r.x for r in df.select(tx.canonical_id(F.col("t"), F.col("p"), F.col("d"), F.col("e")).alias("x")).collect()]
    assert got == ["title:893bee9424bd", "doi:10.1000/abc", "openalex:W12", "arxiv:1234.56789"]


@pytest.mark.parametrize("value,year", [("2024-01-02", 2024), ("c. 1999", 1999), ("", None), (None, None), ("Unknown", None), ("12", None)])
def test_year(spark, value, year):
    assert one(spark, value, tx.extract_year) == year


def test_names_tokens_terms(spark):
    assert one(spark, ["Smith, John", "Ada B. Lovelace", " ", None], tx.last_names, "array<string>") == ["smith", "lovelace"]
    assert one(spark, "The Auction of auctions, why?", tx.query_terms) == ["auction", "auctions"]
    assert one(spark, None, tx.tokens) == []


def test_snippet(spark):
    text = "x" * 300 + " auction " + "y" * 300
    f = lambda c: tx.snippet(c, F.array(F.lit("auction")), 100)
    got = one(spark, text, f)
    assert got.startswith("...") and got.endswith("...") and "auction" in got
    assert one(spark, "short", f) == "short"
    assert one(spark, None, f) == ""


def test_highlight_and_tags(spark):
    assert one(spark, "A <b> auction", lambda c: tx.highlight(c, ("auction", "b"))) == "A &lt;b&gt; <mark>auction</mark>"
    assert one(spark, "a; B,b ,, A", tx.parse_tags) == ["a", "B"]


def test_identifier(spark):
    for v, ok in (("10.1000/xyz123", True), ("1234.56789v2", True), ("arXiv:1", True), ("auction design", False), (None, False)):
        assert one(spark, v, tx.looks_like_identifier) is ok


def test_latex_keys_files(spark):
    assert one(spark, "a & b_c", tx.sanitize_latex) == r"a \& b\_c"
    assert one(spark, "A/B: the *end*.pdf", tx.safe_filename) == "A B the end"
    assert one(spark, "inbox/my_file-name.PDF", tx.title_of_filename) == "my file name"
    df = spark.createDataFrame([(["Smith, J."], "2020"), (["Ada Lovelace"], None), ([], "x")], "a array<string>, p string")
    assert [r.x for r in df.select(tx.cite_key(F.col("a"), F.col("p")).alias("x")).collect()] == ["Smith2020", "LovelaceUnknown", "UnknownUnknown"]


def test_slices_rejoin(spark):
    assert "".join(one(spark, "abcdefg", lambda c: tx.split_fixed(c, 3))) == "abcdefg"
    assert one(spark, "", lambda c: tx.split_fixed(c, 3)) == []
