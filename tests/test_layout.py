import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litmill.operators import layout

LINES = "Figure 1: results\nTable 2: numbers\nx_i = y_i + z_i\nBidderA    10.2    0.33\nplain prose goes here"


def test_tags(spark):
    df = spark.createDataFrame([("a", LINES), ("b", None)], "k string, t string")
    assert [r.kind for r in layout.tag_lines(df, "k", "t").orderBy("line_no").collect()] == ["figure_caption", "table_caption", "formula", "table", "plain"]
    r = layout.layout_counts(df, "k", "t").first()
    assert (r.figure_captions, r.table_captions, r.table_lines, r.formula_lines) == (1, 1, 1, 1)
    assert df.where("k = 'a'").select(layout.annotate(F.col("t")).alias("x")).first().x.startswith("[FIGURE_CAPTION] Figure 1")


def quality(spark, pages, figures, tables, ocr):
    df = spark.createDataFrame([(pages, figures, tables, ocr)], "p array<string>, f int, t int, o int")
    return df.select(layout.parse_quality(F.col("p"), F.col("f"), F.col("t"), F.col("o")).alias("q")).first().q


def test_quality(spark):
    poor, good = quality(spark, ["", ""], 0, 0, 2), quality(spark, ["This is a short sentence. " * 120] * 2, 1, 1, 0)
    assert (poor.label, poor.score) == ("low", 0.05)
    assert (good.label, good.score) == ("high", 1.0)


def reference_chunks(text, size, overlap):
    """A plain rendering of the chunking rule, for comparison."""
    if not text:
        return []
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("-\n", "")
    units = []
    for p in re.split(r"\n[ \t\n\x0b\f\r]*\n+", text):
        p = re.sub(r"[ \t\n\x0b\f\r]+", " ", p).strip(" ")
        for s in [p] if len(p) <= size else re.split(r"(?<=[.!?]) +", p):
            units += [s[k : k + size] for k in range(0, len(s), size)]
    packed = []
    for u in units:
        if packed and len(packed[-1]) + 1 + len(u) <= size:
            packed[-1] += " " + u
        else:
            packed.append(u)
    return [p if k == 0 or not overlap else (packed[k - 1][-overlap:] + " " + p).strip(" ") for k, p in enumerate(packed)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab .!?\n-", max_size=900), min_size=1, max_size=12))
def test_chunks_like_plain_rule(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {}
    for r in layout.chunk_texts(df, "k", "t", 200, 40).orderBy("k", "chunk_index").collect():
        got.setdefault(r.k, []).append(r.chunk)
    for k, t in enumerate(texts):
        assert got.get(k, []) == reference_chunks(t, 200, 40)
