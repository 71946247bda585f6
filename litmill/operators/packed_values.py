"""Several values packed in one field: split them into one row per value.

The notation is read by a parsing expression grammar. Alternatives are ordered; the first that
matches wins and a failed one gives back what it consumed:

    field     <- list / items
    list      <- ws '[' ws (element (ws ',' ws element)*)? ws ']' ws END
    element   <- string / plain
    items     <- item (delimiter item)*
    item      <- ws quoted &stop / ws bracketed &stop / bare                  stop <- delimiter / ws END
    quoted    <- '"' ('""' / '\\' . / !'"' .)* '"' / "'" ("''" / '\\' . / apostrophe / !"'" .)* "'"
    bracketed <- '(' (!')' .)* ')' / '{' (!'}' .)* '}'
    bare      <- (!delimiter .)*
    delimiter <- ',' / ';' / '|' / TAB / LF / CR / fullwidth , ; | / ideographic comma / ws '/' ws

An apostrophe stands between two letters. A slash separates only with white space on both sides, so
"A/B testing" stays one value. A quote that never closes, or closes before other text, makes `quoted`
fail; the item is then read as `bare` and flagged, as is one whose brackets do not pair up. Repetition
never gives back, and where a bracket closes is remembered, so the time is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A parser takes (text, position) and gives (value, position after it), or None if it fails.
Parser = Callable[[str, int], "tuple[object, int] | None"]

MALFORMED_QUOTE = "malformed_quote"
MALFORMED_BRACKET = "malformed_bracket"
EMPTY_VALUE = "empty_value"

SCHEMA = T.ArrayType(
    T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("flag", T.StringType())])
)


def token(pattern: str, group: int = 0) -> Parser:
    rx = re.compile(pattern, re.S)

    def parse(s: str, i: int):
        m = rx.match(s, i)
        return (m.group(group), m.end()) if m else None

    return parse


def seq(*parts: Parser) -> Parser:
    def parse(s: str, i: int):
        out = []
        for p in parts:
            r = p(s, i)
            if r is None:
                return None
            out.append(r[0])
            i = r[1]
        return out, i

    return parse


def first_of(*alternatives: Parser) -> Parser:
    def parse(s: str, i: int):
        for p in alternatives:
            r = p(s, i)
            if r is not None:
                return r
        return None

    return parse


def apply(p: Parser, f: Callable) -> Parser:
    def parse(s: str, i: int):
        r = p(s, i)
        return None if r is None else (f(r[0]), r[1])

    return parse


def separated(item: Parser, by: Parser) -> Parser:
    """item (by item)*, as a list of the items."""

    def parse(s: str, i: int):
        r = item(s, i)
        if r is None:
            return None
        out = [r[0]]
        while True:
            d = by(s, r[1])
            if d is None:
                return out, r[1]
            n = item(s, d[1])
            if n is None:
                return out, r[1]
            out.append(n[0])
            r = n

    return parse


_BLANK, _HARD = r" \u00a0\u3000", r",;|\t\n\r，；｜、"
_SLASH = rf"/(?=[{_BLANK}]|$(?!\n))"
_DELIMITER = rf"(?:[{_BLANK}]*+[{_HARD}]|[{_BLANK}]++{_SLASH})"
_STOP = rf"(?:[{_BLANK}]*+(?:[{_HARD}]|$(?!\n))|[{_BLANK}]++{_SLASH})"
_WS = token(rf"[{_BLANK}]*+")
_END = token(r"$(?!\n)")
_DELIM = token(_DELIMITER)


def _quoted(q: str, stop: str) -> Parser:
    """A quoted value that `stop` follows; doubled and escaped quotes stand for one."""
    apostrophe = r"|(?<=[^\W\d_])'(?=[^\W\d_])" if q == "'" else ""
    rx = re.compile(rf"{q}((?:{q}{q}|\\.{apostrophe}|[^{q}\\])*+){q}(?={stop})", re.S)
    undo = re.compile(rf"{q}{q}|\\(.)", re.S)

    def parse(s: str, i: int):
        m = rx.match(s, i)
        return None if m is None else (undo.sub(lambda x: x.group(1) or q, m.group(1)).strip(), m.end())

    return parse


#: Where the bracket of a kind that is open now closes, for the text at hand.
_closes: dict[str, int] = {}


def _bracketed(opening: str, closing: str) -> Parser:
    stop = re.compile(_STOP)

    def parse(s: str, i: int):
        if not s.startswith(opening, i):
            return None
        at = _closes.get(closing, -1)
        if at < i:
            at = s.find(closing, i)
            _closes[closing] = at = len(s) if at < 0 else at
        return (s[i + 1 : at].strip(), at + 1) if at < len(s) and stop.match(s, at + 1) else None

    return parse


def _flag_of(bare: str) -> str | None:
    if bare[:1] == '"' or bare.count('"') % 2:
        return MALFORMED_QUOTE
    return MALFORMED_BRACKET if any(bare.count(x) != bare.count(y) for x, y in ("()", "[]", "{}")) else None


def _grammar() -> Parser:
    good = lambda v: (v, None)
    special = first_of(_quoted('"', _STOP), _quoted("'", _STOP), _bracketed("(", ")"), _bracketed("{", "}"))
    text = token(rf"(?:[^{_BLANK}{_HARD}]++|[{_BLANK}]++(?![{_HARD}]|{_SLASH}))*+")
    bare = apply(apply(text, str.strip), lambda v: (v, _flag_of(v)))
    items = separated(first_of(apply(seq(_WS, special), lambda r: good(r[1])), bare), _DELIM)

    in_list = r"\s*+[,\]]"
    element = apply(first_of(_quoted('"', in_list), _quoted("'", in_list), apply(token(r"[^,\]\[\"']*+"), str.strip)), good)
    lws = token(r"\s*+")
    listed = apply(seq(lws, token(r"\["), lws, separated(element, seq(lws, token(","), lws)), lws, token(r"\]"), lws, _END), lambda r: r[3])
    return first_of(listed, apply(seq(items, _WS, _END), lambda r: r[0]))


_FIELD = _grammar()


def parse_packed(text: str | None, empties: bool = False) -> list[tuple[int | None, str, str | None]]:
    """The non-empty values of one field in order, as (position from 1, value, flag).

    With `empties` also what is empty between delimiters, without a position.
    """
    if not text:
        return []
    _closes.clear()
    r = _FIELD(text, 0)
    values = r[0] if r is not None else [(text.strip(), MALFORMED_QUOTE)]
    if not empties:
        return [(k, v, flag) for k, (v, flag) in enumerate((x for x in values if x[0]), 1)]
    out, k = [], 0
    for v, flag in values:
        k += bool(v)
        out.append((k, v, flag) if v else (None, v, EMPTY_VALUE))
    return out


def _parser(empties: bool):
    @F.arrow_udf(SCHEMA)
    def parse(field: pa.Array) -> pa.Array:
        coded = field.dictionary_encode()
        parsed = [parse_packed(t, empties) for t in coded.dictionary.to_pylist()]
        offsets, flat = [0], []
        for k in coded.indices.to_pylist():
            if k is not None:
                flat += parsed[k]
            offsets.append(len(flat))
        pos, value, flag = zip(*flat) if flat else ((), (), ())
        struct = pa.StructArray.from_arrays(
            [pa.array(pos, pa.int32()), pa.array(value, pa.string()), pa.array(flag, pa.string())], ["pos", "value", "flag"]
        )
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)

    return parse


def packed_values(field: Column, empties: bool = False) -> Column:
    """array<struct<pos,value,flag>> of the values packed in a string column; no values for null or blank."""
    return F.when(F.length(F.trim(field)) > 0, _parser(empties)(field))


def split_packed(df: DataFrame, key: str, field: str, pos: str = "pos", value: str = "value", flag: str = "flag", empties: bool = False) -> DataFrame:
    """One row per non-empty value of df[field]: key, pos (from 1), value, flag.

    Null, empty and blank fields, and fields of delimiters only, give no row. Repeated values keep
    their own positions; repeated input rows repeat their output. A null key is kept. flag is null,
    `malformed_quote` or `malformed_bracket`. With `empties` each empty place between delimiters of
    a field that is not blank gives a row too, with a null pos and the flag `empty_value`. Any other
    columns of df are ignored, whatever their names.
    The plan is a scan, one Arrow UDF and an explode: no shuffle, at any size.
    """
    return (
        df.select(F.col(f"`{key}`").alias("k"), packed_values(F.col(f"`{field}`"), empties).alias("v"))
        .select("k", F.explode("v").alias("v"))
        .select(F.col("k").alias(key), F.col("v.pos").alias(pos), F.col("v.value").alias(value), F.col("v.flag").alias(flag))
    )
