"""Document preparation: layout tags of lines, parse quality of texts, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.functions.text import WS, split_fixed, strip


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def is_table_row(line: Column) -> Column:
    s = strip(line)
    gaps = s.rlike(rf"{WS}{{2,}}") & (_count(s, "[0-9]") >= 2)
    return (F.length(s) >= 10) & (gaps | (_count(s, r"\|") >= 2) | s.rlike(rf"^[A-Za-z].{{0,30}}{WS}+[0-9]+(\.[0-9]+)?{WS}+[0-9]+(\.[0-9]+)?"))


def is_formula(line: Column) -> Column:
    s = strip(line)
    symbols = (_count(s, r"[=<>+\-*/^∑∫√]") >= 2) & s.rlike(r"[0-9]|\p{L}")
    return (F.length(s) >= 6) & (s.rlike(r"\\(frac|sum|int|alpha|beta|gamma|theta|lambda)") | symbols | s.rlike(rf"^\(?[0-9]+(\.[0-9]+)?\)?{WS}*[).-]?{WS}*[A-Za-z].*="))


def line_kind(line: Column) -> Column:
    """blank, figure_caption, table_caption, table, formula or plain; the first that fits."""
    s = strip(line)
    return (
        F.when(s == "", "blank")
        .when(s.rlike(rf"(?i)^(figure|fig\.){WS}*[0-9]+"), "figure_caption")
        .when(s.rlike(rf"(?i)^table{WS}*[0-9]+"), "table_caption")
        .when(is_table_row(line), "table")
        .when(is_formula(line), "formula")
        .otherwise("plain")
    )


TAGS = {"figure_caption": "[FIGURE_CAPTION] ", "table_caption": "[TABLE_CAPTION] ", "table": "[TABLE] ", "formula": "[FORMULA] "}


def tag_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line, kind): every line of every text; nothing for null texts."""
    lines = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.withColumn("kind", line_kind(F.col("line")))


def annotate(text: Column) -> Column:
    """The text with a tag before each line of a special kind, without a shuffle."""

    def one(line: Column) -> Column:
        kind = line_kind(line)
        tag = F.lit("")
        for k, t in TAGS.items():
            tag = F.when(kind == k, F.lit(t)).otherwise(tag)
        return F.when(tag != "", F.concat(tag, strip(line))).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def layout_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, figure_captions, table_captions, table_lines, formula_lines) of every text."""
    t = tag_lines(df, key, text)
    n = lambda k: F.count_if(F.col("kind") == k)
    return t.groupBy(key).agg(n("figure_caption").alias("figure_captions"), n("table_caption").alias("table_captions"), n("table").alias("table_lines"), n("formula").alias("formula_lines"))


def parse_quality(pages: Column, figures: Column, tables: Column, ocr_pages: Column, least_text: int = 80) -> Column:
    """struct(score, label, total_chars, bad_ratio) of the pages' texts."""
    n = F.greatest(F.lit(1), F.size(pages))
    merged = strip(F.array_join(pages, "\n\n"))
    total = F.length(merged)
    low = F.size(F.filter(pages, lambda p: F.length(strip(F.coalesce(p, F.lit("")))) < least_text)) / n
    bad = F.when(total > 0, _count(merged, r"[^\x09\x0A\x0D\x20-\x7E]") / total).otherwise(F.lit(1.0))
    less = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    score = 1.0 - less(total < 600, 0.35) - less(total / n < 250, 0.20) - less(low > 0.5, 0.20) - less(ocr_pages / n > 0.7, 0.10) - less(bad > 0.08, 0.10) + less((figures > 0) | (tables > 0), 0.05)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)
    return F.struct(score.alias("score"), F.when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low").alias("label"), total.alias("total_chars"), F.round(bad, 4).alias("bad_ratio"))


def chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Chunks of paragraphs and sentences packed in order up to size, each with the end of the one before in front.

    Paragraphs longer than size are cut at sentences, sentences longer than size at fixed widths. The
    overlap is taken of the chunk before it got its own, so a chunk may exceed size by overlap + 1.
    """
    size, overlap = max(200, size), max(0, overlap)
    t = F.replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), F.lit("-\n"), F.lit(""))
    paragraphs = F.filter(F.transform(F.split(t, rf"\n{WS}*\n+"), lambda p: strip(F.regexp_replace(p, rf"{WS}+", " "))), lambda p: p != "")
    cut = lambda s: F.when(F.length(s) <= size, F.array(s)).otherwise(split_fixed(s, size))
    of_sentences = lambda p: F.flatten(F.transform(F.filter(F.split(p, rf"(?<=[.!?]){WS}+"), lambda s: s != ""), cut))
    units = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(of_sentences(p))))
    # packing folds over unit lengths alone: the number of the chunk each unit falls into
    numbers = F.aggregate(
        F.transform(units, F.length),
        F.struct(F.lit(0).alias("no"), F.lit(0).alias("len"), F.array().cast("array<int>").alias("nos")),
        lambda s, n: F.when(
            s["len"] == 0, F.struct(s["no"].alias("no"), n.alias("len"), F.concat(s["nos"], F.array(s["no"])).alias("nos"))
        ).when(
            s["len"] + 1 + n <= size, F.struct(s["no"].alias("no"), (s["len"] + 1 + n).alias("len"), F.concat(s["nos"], F.array(s["no"])).alias("nos"))
        ).otherwise(F.struct((s["no"] + 1).alias("no"), n.alias("len"), F.concat(s["nos"], F.array(s["no"] + 1)).alias("nos"))),
        lambda s: s["nos"],
    )
    return F.struct(units.alias("units"), numbers.alias("nos"))


def chunk_texts(df: DataFrame, key: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, chunk): the chunks of every text; none for null and blank ones."""
    u = df.select(key, chunks(F.col(text), size, overlap).alias("c"))
    u = u.select(key, F.col("c.units").alias("units"), F.col("c.nos").alias("nos")).where(F.size("units") > 0)
    zipped = F.arrays_zip(F.col("units").alias("u"), F.col("nos").alias("k"))
    plain = F.transform(F.sequence(F.lit(0), F.array_max("nos")), lambda k: F.array_join(F.transform(F.filter(F.col("z"), lambda s: s["k"] == k), lambda s: s["u"]), " "))
    c = u.withColumn("z", zipped).withColumn("plain", plain)
    made = F.transform("plain", lambda p, i: F.when((i > 0) & F.lit(overlap > 0), strip(F.concat(F.right(F.get(F.col("plain"), i - 1), F.lit(overlap)), F.lit(" "), p))).otherwise(p))
    return c.select(key, F.posexplode(made).alias("chunk_index", "chunk"))
