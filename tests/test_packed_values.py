import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litmill.operators.packed_values import EMPTY_VALUE, MALFORMED_BRACKET, MALFORMED_QUOTE, parse_packed, split_packed

CASES = [
    ('"risk; ambiguity"|"auctions, sealed-bid"|Hyperparameter search|', ["risk; ambiguity", "auctions, sealed-bid", "Hyperparameter search"]),
    ("""['auctions, sealed-bid', 'x', "État de l'art"]""", ["auctions, sealed-bid", "x", "État de l'art"]),
    ("A/B testing / q3/q4 reports", ["A/B testing", "q3/q4 reports"]),
    ('"north, south" / loan words', ["north, south", "loan words"]),
    ('"The ""free"" label"\npublic procurement; reader\'s choice', ['The "free" label', "public procurement", "reader's choice"]),
    (', "cost, speed, quality"|samplers', ["cost, speed, quality", "samplers"]),
    ("R&D；Build，x", ["R&D", "Build", "x"]),
    ("follow up|follow up", ["follow up", "follow up"]),
    ('"say ""hi"""; b', ['say "hi"', "b"]),
    ('["a", "b\\"c"]', ["a", 'b"c']),
    ('"";a;""', ["a"]),
    (" ", []),
    (";;,|", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("text,values", CASES)
def test_values(text, values):
    got = parse_packed(text)
    assert [v for _, v, _ in got] == values
    assert [k for k, _, _ in got] == list(range(1, len(values) + 1))


def test_malformed_quote_is_read_as_bare_and_flagged():
    assert parse_packed('"open; b') == [(1, '"open', MALFORMED_QUOTE), (2, "b", None)]
    assert parse_packed('"a"b; c') == [(1, '"a"b', MALFORMED_QUOTE), (2, "c", None)]


def test_a_quote_that_closes_before_other_text_gives_back_what_it_took():
    assert parse_packed('"abc, "def"') == [(1, '"abc', MALFORMED_QUOTE), (2, "def", None)]
    assert parse_packed('"a" "b", c') == [(1, '"a" "b"', MALFORMED_QUOTE), (2, "c", None)]


def test_brackets_and_empty_places():
    assert parse_packed("(a, b); {c, d}; 'don't stop'") == [(1, "a, b", None), (2, "c, d", None), (3, "don't stop", None)]
    assert parse_packed("[a, b") == [(1, "[a", MALFORMED_BRACKET), (2, "b", None)]
    assert parse_packed("(x") == [(1, "(x", MALFORMED_BRACKET)]
    assert parse_packed("a,,b", empties=True) == [(1, "a", None), (None, "", EMPTY_VALUE), (2, "b", None)]


@pytest.mark.parametrize("unit", ['"', '"a,', "'a, ", "(x, ", '"a,""b,', '"\\",', "a" + " " * 50, "[", "a / "])
def test_time_is_linear(unit):
    def took(n):
        began = time.perf_counter()
        parse_packed(unit * n)
        return time.perf_counter() - began

    took(10)
    assert took(40_000) < 10 * took(10_000) + 0.05


def test_very_long_field():
    assert len(parse_packed(";".join(["x y"] * 100_000))) == 100_000
    assert parse_packed('"' + "a" * 1_000_000)[0][2] == MALFORMED_QUOTE


QUOTABLE = st.text(st.characters(blacklist_categories=("Cs", "Cc", "Zs", "Zl", "Zp"), blacklist_characters="\\"), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(QUOTABLE, min_size=1, max_size=6), st.sampled_from([";", ", ", "|", "\t", "\n", " / "]))
def test_round_trip_of_quoted_values(values, delimiter):
    packed = delimiter.join('"' + v.replace('"', '""') + '"' for v in values)
    assert [v for _, v, _ in parse_packed(packed)] == values


def test_operator(spark):
    df = spark.createDataFrame([("a", "x;y", 1, "n"), ("a", "x;y", 1, "n"), (None, "z", 2, None), ("b", None, 3, "n"), ("c", " ", 4, "n")], "key string, tags string, pos int, value string")
    rows = sorted((str(r.key), r.pos, r.value, r.flag) for r in split_packed(df, "key", "tags").collect())
    assert rows == [("None", 1, "z", None), ("a", 1, "x", None), ("a", 1, "x", None), ("a", 2, "y", None), ("a", 2, "y", None)]
    assert split_packed(df.limit(0), "key", "tags").count() == 0


def test_no_shuffle(spark):
    df = spark.createDataFrame([("a", "x")], "k string, v string")
    assert "Exchange" not in split_packed(df, "k", "v")._jdf.queryExecution().executedPlan().toString()
