"""Splitting oversized items at natural boundaries.

A regular expression with bounded quantifiers takes pieces off the text: its alternatives are
ordered by the strength of the boundary and each takes as much as the limit allows, so a piece ends
at the last paragraph end in reach, else at the last sentence end, else at the last word end, else
at the limit. Array functions add up the pieces' lengths to offsets, and the overlap is put together
from the pieces before. All of it runs inside the JVM, in time linear in the text; there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.session import distinct_names

#: What follows the last character of a piece, by kind of boundary, from strong to weak. A stronger
#: kind's places are places of the weaker kinds too.
FOLLOW = {
    "paragraph": r"(?=\s*\z|[^\S\n]*\n\s*\n)",
    "sentence": r"(?:(?=\s*\z|[^\S\n]*\n\s*\n)|(?<=[.!?])(?=\s))",
    "word": r"(?=\s|\z)",
}

FLAGS = "(?sU)"


def _up_to(limit: int) -> str:
    """At most `limit` characters that begin and end with something visible."""
    return rf"\S(?:.{{0,{limit - 2}}}\S)?" if limit > 1 else r"\S"


def piece_pattern(limit: int) -> str:
    body = "|".join([*(_up_to(limit) + follow for follow in FOLLOW.values()), rf"\S.{{0,{limit - 1}}}"])
    return rf"{FLAGS}({body})(\s*)"


def taken(text: Column, kind: str, limit: int) -> Column:
    """The pieces that one kind of boundary alone takes off the text, one after the other, each with the white space before it."""
    return F.regexp_extract_all(text, F.lit(rf"{FLAGS}\G\s*{_up_to(limit)}{FOLLOW[kind]}"), F.lit(0))


def _total(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.length(w))


def boundary_needed(text: Column, limit: int) -> Column:
    """The coarsest kind of boundary whose pieces alone cover the text, each within the limit, else `none`."""
    visible = F.length(F.regexp_replace(text, r"(?U)\s+\z", ""))
    out = F.lit("none")
    for kind in reversed(FOLLOW):
        out = F.when(_total(taken(text, kind, limit)) >= visible, F.lit(kind)).otherwise(out)
    return out


#: Lengths are added up within blocks of so many pieces, and over the blocks.
BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once and not once for each element that reads it."""
    return F.transform(F.array(value), body)[0]


def _starts(lengths: Column, first: Column) -> Column:
    """Where each piece starts, from the array of lengths and the place of the first."""
    add = lambda a, n: a + n
    part = lambda k, m: F.aggregate(F.slice(lengths, k * BLOCK + 1, m), F.lit(0), add)
    sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda k: part(k, F.lit(BLOCK)))
    before = _let(sums, lambda blocks: F.transform(blocks, lambda _, k: F.aggregate(F.slice(blocks, F.lit(1), k), first, add)))
    return _let(before, lambda upto: F.transform(lengths, lambda _, i: upto[F.floor(i / BLOCK).cast("int")] + part(F.floor(i / BLOCK).cast("int"), i % BLOCK)))


def split_oversized(df: DataFrame, key: str, field: str, limit: int = 1000, overlap: int = 200) -> DataFrame:
    """(key, piece_no, start, piece, body_length, boundary): texts over the limit, cut into pieces.

    No piece exceeds `limit` characters with its overlap: the first takes up to limit - overlap, each
    further one begins with the `overlap` characters before its own start. piece_no and start count
    from 1; start is the place of the piece's own text. boundary is `boundary_needed` of the whole
    text for pieces of up to `limit` before overlap.

    Only texts longer than the limit give rows: null, empty and short ones do not, nor does a text
    of white space alone. Repeated rows are cut each. Columns other than key and field are ignored.
    Characters are code points, so no character is torn apart.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than the limit")
    own = limit - overlap
    # a piece that ends early is followed by one cut at a weaker place or both exceed `own`; there
    # are four kinds of places, so any five pieces in a row exceed it
    back = 5 * (overlap // own + 1)
    d = distinct_names(df, key, field).select(F.col(key).alias("k"), F.col(field).alias("t")).where(F.length("t") > limit)
    gap = F.regexp_extract(F.col("t"), r"(?U)^\s*", 0)

    def cut(lead: Column, whole: Column, starts: Column) -> Column:
        # what stands before a piece: the pieces before it, and for the first ones the white space at the start
        before = lambda i: F.concat(F.when(i <= back, F.right(lead, F.lit(overlap))).otherwise(""), F.array_join(F.slice(whole, F.greatest(i - back + 1, F.lit(1)), F.least(i, F.lit(back))), ""))
        return F.transform(whole, lambda w, i: F.struct(starts[i].alias("start"), F.right(before(i), F.lit(overlap)).alias("over"), F.regexp_replace(w, r"(?U)\s+\z", "").alias("body")))

    all_starts = lambda lead, whole: _let(F.transform(whole, F.length), lambda n: _starts(n, F.length(lead) + 1))
    pieces = _let(gap, lambda lead: _let(F.regexp_extract_all("t", F.lit(piece_pattern(own)), F.lit(0)), lambda whole: _let(all_starts(lead, whole), lambda at: cut(lead, whole, at))))
    d = d.select("k", boundary_needed(F.col("t"), limit).alias("boundary"), F.posexplode(pieces).alias("no", "p"))
    return d.select(
        F.col("k").alias(key), (F.col("no") + 1).alias("piece_no"), F.col("p.start").alias("start"), F.concat("p.over", "p.body").alias("piece"),
        F.length("p.body").alias("body_length"), "boundary",
    )
