"""Duplicate records: search results by key, pair scores, groups and merged records."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmill.functions.text import extract_year, is_unknown, jaccard, last_names, normalize_title, parse_tags, strip, to_flag, tokens
from litmill.session import materialize


def dedupe_results(results: DataFrame, ord_: str) -> DataFrame:
    """One result a key - DOI, else normalised title -, the most complete, the earliest among equals.

    results: title, doi, published, summary, pdf_url and the ordinal. The key's first ordinal is
    kept as first_ord, in whose order the results come.
    """
    d = F.lower(strip(F.coalesce("doi", F.lit(""))))
    key = F.when(d != "", F.concat(F.lit("doi:"), d)).otherwise(F.concat(F.lit("title:"), normalize_title(F.col("title"))))
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    score = F.when(has("pdf_url"), 2.0).otherwise(0.0) + F.least(F.length(F.coalesce("summary", F.lit(""))) / 200.0, F.lit(2.0)) + F.when(has("published") & (F.col("published") != "Unknown"), 1.0).otherwise(0.0)
    r = results.withColumn("key", key).withColumn("score", F.round(score, 6))
    w = W.partitionBy("key")
    # the first rows of a key by a total order: partial top-1 before the shuffle
    best = r.withColumn("rn", F.row_number().over(w.orderBy(F.desc("score"), F.asc(ord_)))).where("rn = 1").drop("rn")
    return best.join(r.groupBy("key").agg(F.min(ord_).alias("first_ord")), "key")


@F.arrow_udf(T.DoubleType())
def sequence_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp similarity of two strings; 0 if either is empty."""
    from difflib import SequenceMatcher

    return pa.array([1.0 if x and x == y else SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def year_similarity(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    known = (a > 0) & (b > 0)
    return F.coalesce(F.when(known & (d == 0), 1.0).when(known & (d == 1), 0.7).when(known & (d == 2), 0.4), F.lit(0.0))


def pair_keys(papers: DataFrame, ord_: str) -> DataFrame:
    """What pairs are judged by, once for each record with a title."""
    norm = normalize_title(F.col("title"))
    return papers.select(
        F.col(ord_).alias("ord"), norm.alias("norm"), F.array_sort(F.array_distinct(tokens(F.col("title")))).alias("toks"), F.array_sort(last_names(F.col("authors"))).alias("names"),
        extract_year(F.col("published")).alias("year"), F.lower(strip(F.coalesce("doi", F.lit("")))).alias("doi"), F.coalesce("canonical_id", F.lit("")).alias("cid"),
    ).where("norm <> ''")


#: What stands for no DOI; equal stand-ins are neither a block nor an equal DOI.
NO_DOI = ("unknown", "none", "null", "n/a", "na", "-")


def doi_block() -> Column:
    return F.when((F.col("doi") != "") & ~F.col("doi").isin(*NO_DOI), F.concat(F.lit("d:"), F.col("doi")))


def duplicate_classes(keys: DataFrame) -> DataFrame:
    """keys with class_id, the least ord among the records that are alike in all that pairs are judged by."""
    alike = [c for c in keys.columns if c != "ord"]
    signed = keys.withColumn("sign", F.to_json(F.struct(*alike), {"ignoreNullFields": "false"}))
    return signed.join(signed.groupBy("sign").agg(F.min("ord").alias("class_id")), "sign").drop("sign")


def representatives(keys: DataFrame) -> DataFrame:
    """One record, the one with the least ord, of those that are alike in all that pairs are judged by."""
    return keys.groupBy(*[c for c in keys.columns if c != "ord"]).agg(F.min("ord").alias("ord")).select(keys.columns)


#: Weights of title, authors and year in the combined score, and the boosts of an equal DOI and id.
TITLE, AUTHORS, YEAR, SAME_DOI, SAME_ID = 0.65, 0.25, 0.10, 0.25, 0.30


#: Buckets of words by hash whose counts give the order of rarity; the counts go to the driver.
BUCKETS = 1 << 14


def rarity(keys: DataFrame, sets: str) -> Callable[[Column], Column]:
    """How often the bucket of a member of these sets is met; with the member itself a total order."""
    count = keys.select(F.explode(sets).alias("x")).groupBy(F.pmod(F.xxhash64("x"), F.lit(BUCKETS)).alias("k")).agg(F.count("*").alias("n")).collect()
    met = {r["k"]: r["n"] for r in count}
    known = F.from_json(F.lit(json.dumps([met.get(k, 0) for k in range(BUCKETS)])), "array<bigint>")
    return lambda x: F.get(known, F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))


def rarest(sets: str, often: Callable[[Column], Column], least: float) -> Column:
    """Of each set so many of its rarest members that two sets with that Jaccard similarity share one.

    Two sets with a similarity of t share one of the first n - ceil(t n) + 1 in any common order.
    """
    r, n = F.array_sort(F.transform(sets, lambda x: F.struct(often(x).alias("df"), x.alias("x")))), F.size(sets)
    return F.transform(F.slice(r, F.lit(1), (n - F.ceil(n * F.lit(least)) + 1).cast("int")), lambda x: x["x"])


def _least_shares(least: float) -> tuple[float, float]:
    """Least shares of common title words and family names in a pair that no boost lifts to a score."""
    title, alike = ((least - 5e-5 - rest) / of - 1e-9 for rest, of in ((AUTHORS + YEAR, TITLE), (TITLE + YEAR, AUTHORS)))
    return max(0.01, title), alike


def _by_rarity(sets: str, often: Callable[[Column], Column]) -> Column:
    """The members of a set as hashes, the rarest first."""
    return F.transform(F.array_sort(F.transform(sets, lambda x: F.struct(often(x).alias("df"), F.xxhash64(x).alias("x")))), lambda x: x["x"])


def _first(sets: Column, least: float) -> Column:
    n = F.size(sets)
    return F.slice(sets, F.lit(1), (n - F.ceil(n * F.lit(least)) + 1).cast("int"))


#: Words of 64 bits in which `sieve` marks what is there; they go to the driver and out with the plan.
SIEVE = 1 << 16


def sieve(rows: DataFrame, hashed: str) -> Callable[[Column], Column]:
    """Whether a hash of 64 bits may be in that column of rows: all that are there pass, and few others unless they are very many."""
    word, bit = f"pmod({hashed}, {SIEVE})", f"shiftleft(1L, cast(pmod(shiftright({hashed}, 32), 64) as int))"
    marked = rows.where(F.col(hashed).isNotNull()).groupBy(F.expr(word).alias("k")).agg(F.expr(f"bit_or({bit})").alias("bits")).collect()
    bits = {r["k"]: r["bits"] for r in marked}
    known = F.from_json(F.lit(json.dumps([bits.get(k, 0) for k in range(SIEVE)])), "array<bigint>")
    return lambda x: F.bit_get(F.get(known, F.pmod(x, F.lit(SIEVE)).cast("int")), F.pmod(F.shiftright(x, 32), F.lit(64)).cast("int")) == 1


def blocked(keys: DataFrame, library: DataFrame, least: float, prefix: Column, among: Callable[[Column], Column] | None = None) -> DataFrame:
    """keys with a row for each block: one of a rare title word and a rare family name, by their rarity in the library, of a DOI or of an id.

    All that is compared goes with them as hashes of 64 bits: words and names the rarest first, so the
    blocks that two records share can be told from either. With `among` only the blocks that pass it.
    """
    title, alike = _least_shares(least)
    k = keys.select(
        "ord", "year", _by_rarity("toks", rarity(library, "toks")).alias("toks"), _by_rarity("names", rarity(library, "names")).alias("names"),
        F.xxhash64(prefix).alias("at"), F.xxhash64(doi_block()).alias("doi"), doi_block().isNotNull().alias("has_doi"), F.xxhash64("cid").alias("cid"), (F.col("cid") != "").alias("has_cid"),
    )
    rows = lambda df, *cols: df.select(*cols, "ord", "year", "toks", "names", F.when(F.col("has_doi"), F.col("doi")).alias("doi"), F.when(F.col("has_cid"), F.col("cid")).alias("cid"), "at")
    none = F.lit(0).cast("bigint")
    some = F.transform(_first(F.col("names"), alike), lambda x: x) if alike > 0 else F.array(none)
    pairs = F.flatten(F.transform(_first(F.col("toks"), title), lambda t: F.transform(some, lambda x: F.struct(t.alias("word"), x.alias("name")))))
    boosts = F.filter(F.array(F.struct(F.when(F.col("has_doi"), F.col("doi")).alias("word"), F.lit(1).cast("bigint").alias("name")), F.struct(F.when(F.col("has_cid"), F.xxhash64("at", "cid")).alias("word"), F.lit(2).cast("bigint").alias("name"))), lambda x: x["word"].isNotNull())
    words = rows(k.withColumn("b", F.explode(pairs)), F.xxhash64("at", "b.word", "b.name").alias("block"), F.col("b.word").alias("word"), F.col("b.name").alias("name"))
    sure = rows(k.withColumn("b", F.explode(boosts)), F.xxhash64("b.word", "b.name").alias("block"), F.lit(None).cast("bigint").alias("word"), F.col("b.name").alias("name"))
    rows = words.unionByName(sure)
    return rows.where(among(F.col("block"))) if among else rows


def met(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """Pairs of `blocked` rows that can reach that combined score by the words of their titles, each made once: where both first meet.

    Nothing is shuffled after the join; columns are as in pairs of keys, words and names as hashes.
    """
    title, alike = _least_shares(least)
    side = lambda df, s: df.select("block", *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c != "block"])
    j = side(a, "a").join(side(b, "b"), "block").where("ord_a <> ord_b and word_a <=> word_b and name_a = name_b")
    same_doi, same_cid = F.coalesce(F.col("doi_a") == F.col("doi_b"), F.lit(False)), F.coalesce(F.col("cid_a") == F.col("cid_b"), F.lit(False))
    # a pair with the same DOI is made there, one with the same first character and id there, all others by words
    by_id = same_cid & (F.col("at_a") == F.col("at_b"))
    by_words = ~same_doi & ~by_id
    words, names = jaccard(F.col("toks_a"), F.col("toks_b")), jaccard(F.col("names_a"), F.col("names_b"))
    reach = TITLE * words + AUTHORS * names + YEAR * year_similarity(F.col("year_a"), F.col("year_b")) >= least - 6e-5
    shared = lambda c, share: F.get(F.array_intersect(_first(F.col(f"{c}_a"), share), _first(F.col(f"{c}_b"), share)), F.lit(0))
    once = F.col("word_a") == shared("toks", title)
    if alike > 0:
        once &= F.col("name_a") == shared("names", alike)
    # what costs least is asked first
    x, y = F.size("toks_a"), F.size("toks_b")
    like = by_words & (F.least(x, y) >= title * F.greatest(x, y)) & (names >= alike)
    by = F.when(F.col("word_a").isNotNull(), like & reach & once).when(F.col("name_a") == 1, same_doi).otherwise(by_id & ~same_doi)
    some = lambda c, s: F.coalesce(F.col(f"{c}_{s}").cast("string"), F.lit("")).alias(f"{c}_{s}")
    return j.where(by).select(*[x for s in "ab" for x in (f"ord_{s}", f"toks_{s}", f"names_{s}", f"year_{s}", some("doi", s), some("cid", s))])


def candidate_pairs(keys: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs (a, b), a before b, with the same first character of the title or the same DOI.

    With least > 0 only pairs that can reach that combined score by the Jaccard similarity of their
    title words are made, all of them: pairs with the same DOI; pairs with the same first character
    and id; and pairs with the same first character whose titles and names are similar enough. The
    last share one of the rarest words of both titles and, as title and year alone do not reach
    0.75, one of the rarest family names of both (prefix filters), so blocks are as fine as a rare
    word with a rare name. Their words, names, DOI and id are hashes of 64 bits, equal where those are.
    """
    first = F.substring("norm", 1, 1)
    if least <= 0:
        b = keys.withColumn("block", F.explode(F.array_compact(F.array(F.concat(F.lit("c:"), first), doi_block()))))
        side = lambda s: b.select("block", *[F.col(c).alias(f"{c}_{s}") for c in keys.columns])
        return side("a").join(side("b"), "block").where("ord_a < ord_b").drop("block").dropDuplicates(["ord_a", "ord_b"])
    keys = materialize(keys)
    b = blocked(keys, keys, least, first)
    return met(b, b, least).where("ord_a < ord_b")


#: Rows of a block that are compared in one piece; larger blocks are compared in tiles. Pairs that are looked at together.
TILE, CHUNK = 2048, 1 << 18


def full_pairs(keys: DataFrame, least: float, tile: int = TILE) -> DataFrame:
    """The pairs of candidate_pairs(keys) that can reach that combined score by the words or the ratio, all of them.

    Title and year alone give 0.75, so above it a pair without a boost shares a family name: it is
    found by the rarest names of both (prefix filter), a pair with the same DOI, or the same first
    character and id, there. The rows of a block are compared where they lie (`_near`): a pair stays
    if the title similarity that is still missing beside authors, year and boosts is within what the
    words, or the characters in their order, allow.
    """
    least -= 5e-5  # scores are compared as rounded to four places
    alike = (least - TITLE - YEAR) / AUTHORS - 1e-9
    if alike <= 0:
        return candidate_pairs(keys)
    first = F.substring("norm", 1, 1)
    keys = materialize(keys)
    of = lambda kind, x, *at: F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), x, *at).alias("block"), x.alias("by"))
    rare = F.transform(rarest("names", rarity(keys, "names"), alike), lambda x: of("name", x, first))
    sure = F.array_compact(F.array(F.when(doi_block().isNotNull(), of("doi", F.col("doi"))), F.when(F.col("cid") != "", of("cid", F.col("cid"), first))))
    rows = keys.withColumn("rare", rarest("names", rarity(keys, "names"), alike)).withColumn("b", F.explode(F.concat(rare, sure))).select("b.*", "rare", *keys.columns)
    often = materialize(rows.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("block", F.ceil(F.col("n") / tile).cast("int").alias("tiles")))
    own, other = F.pmod(F.xxhash64("ord"), F.col("tiles")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    tiled = rows.join(often, "block").withColumn("part", own).withColumn("other", other)
    group = F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other"))
    together = tiled.select(group.alias("group"), F.when(F.col("part") != F.col("other"), F.col("part")).alias("part"), "kind", "by", "rare", doi_block().isNotNull().alias("has_doi"), *keys.columns)
    schema = T.StructType([T.StructField(f"{f.name}_{s}", f.dataType) for s in "ab" for f in keys.schema.fields])
    names = keys.columns
    return together.repartition("group").sortWithinPartitions("group").mapInArrow(lambda batches: _near(batches, names, least - 1e-9), schema)


def _near(batches: Iterator[pa.RecordBatch], names: list[str], least: float) -> Iterator[pa.RecordBatch]:
    """The pairs of rows of the same group that can reach that score; rows come in the order of their groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        group = batch.column("group").to_numpy()
        cut = int(np.searchsorted(group, group[-1]))
        if held and held[-1].column("group")[0].as_py() != group[0]:
            yield from _near_rows(pa.Table.from_batches(held), names, least)
            held = []
        if cut:
            yield from _near_rows(pa.Table.from_batches([*held, batch.slice(0, cut)]), names, least)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from _near_rows(pa.Table.from_batches(held), names, least)


def _signs(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set its size, 64 bits of the hashes of its members, and how many members have no bit of their own."""
    x = lists.combine_chunks()
    n = np.diff(x.offsets.to_numpy())
    codes = x.flatten().dictionary_encode()
    bit = np.array([1 << (crc32(v.encode()) & 63) for v in codes.dictionary.to_pylist()], np.uint64)
    bits = np.zeros(len(x), np.uint64)
    np.bitwise_or.at(bits, np.repeat(np.arange(len(x)), n), bit[codes.indices.to_numpy()] if len(bit) else bit)
    return n, bits, n - np.bitwise_count(bits)


def _at_most(sets: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What the Jaccard similarity of the sets of rows i and j is at most."""
    n, bits, spare = sets
    common = np.minimum(np.bitwise_count(bits[i] & bits[j]) + np.minimum(spare[i], spare[j]), np.minimum(n[i], n[j]))
    return common / np.maximum(n[i] + n[j] - common, 1)


def _near_rows(t: pa.Table, names: list[str], least: float) -> Iterator[pa.RecordBatch]:
    t = t.combine_chunks()
    plain = lambda c: t[c].combine_chunks()
    group, part = t["group"].to_numpy(), t["part"].fill_null(-1).to_numpy()
    toks, people, norm = _signs(t["toks"]), _signs(t["names"]), plain("norm").to_pylist()
    year = t["year"].fill_null(0).to_numpy()
    code = lambda c: plain(c).dictionary_encode().indices.to_numpy()
    doi, cid, has_doi, has_cid = code("doi"), code("cid"), t["has_doi"].to_numpy(), np.array([x != "" for x in t["cid"].to_pylist()], bool)
    length, data = np.array([len(x) for x in norm]), [x.encode() for x in norm]
    size = np.array([len(x) for x in data])
    # characters by 32 classes; the bytes of a character that two titles share are shared
    letters = np.bincount(np.repeat(np.arange(len(data)), size) * 32 + (np.frombuffer(b"".join(data), np.uint8) & 31), minlength=32 * len(data)).reshape(-1, 32).astype(np.uint16 if size.max(initial=0) < 65536 else np.int64)
    end = np.searchsorted(group, group, side="right")
    todo = end - np.arange(len(group)) - 1
    upto = np.cumsum(todo)
    sets = {c: [set(x) for x in t[c].to_pylist()] for c in ("toks", "names")}
    rare, by, kind, ords = (t[c].to_pylist() for c in ("rare", "by", "kind", "ord"))
    masks: dict[int, dict] = {}
    start = 0
    while start < len(group) and upto[-1]:
        done = upto[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(upto, done + CHUNK, side="right")))
        k = todo[start:stop]
        i = np.repeat(np.arange(start, stop), k)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        start = stop
        apart = (part[i] < 0) | (part[i] != part[j])
        i, j = i[apart], j[apart]
        boost = np.maximum(np.where(has_doi[i] & (doi[i] == doi[j]), SAME_DOI, 0.0), np.where(has_cid[i] & (cid[i] == cid[j]), SAME_ID, 0.0))
        gap = np.where((year[i] > 0) & (year[j] > 0), np.minimum(np.abs(year[i].astype(np.int64) - year[j]), 3), 3)
        rest = least - boost - YEAR * np.array([1.0, 0.7, 0.4, 0.0])[gap]
        need = (rest - AUTHORS * _at_most(people, i, j)) / TITLE
        words = _at_most(toks, i, j) >= need
        x, y = length[i], length[j]
        some = np.flatnonzero((need <= 1) & (words | (2 * np.minimum(x, y) >= need * (x + y))))
        i, j, rest, need, words = i[some], j[some], rest[some], need[some], words[some]
        some = np.flatnonzero(words | (2.0 * np.minimum(letters[i], letters[j]).sum(1) >= need * (length[i] + length[j])))
        left, right = [], []
        for a, b, r in zip(i[some].tolist(), j[some].tolist(), rest[some].tolist()):
            same_doi, same_cid = has_doi[a] and doi[a] == doi[b], has_cid[a] and cid[a] == cid[b] and norm[a][0] == norm[b][0]
            # a pair is made in one block alone
            if kind[a] != ("doi" if same_doi else "cid" if same_cid else "name") or kind[b] != kind[a] or by[a] != by[b]:
                continue
            if kind[a] == "name" and (norm[a][0] != norm[b][0] or next((z for z in rare[a] if z in rare[b]), None) != by[a]):
                continue
            want = (r - AUTHORS * _jaccard(sets["names"][a], sets["names"][b])) / TITLE
            if want > 1:
                continue
            if _jaccard(sets["toks"][a], sets["toks"][b]) < want and norm[a] != norm[b]:
                if a not in masks:
                    if len(masks) > 10_000:
                        masks.clear()
                    masks[a] = _places(norm[a])
                if 2 * _common(masks[a], len(norm[a]), norm[b]) < want * (len(norm[a]) + len(norm[b])):
                    continue
            a, b = (a, b) if ords[a] < ords[b] else (b, a)
            left.append(a)
            right.append(b)
        for k in range(0, len(left), 10_000):
            sides = [pa.array(s[k : k + 10_000]) for s in (left, right)]
            yield pa.RecordBatch.from_arrays([plain(c).take(s) for s in sides for c in names], names=[f"{c}_{s}" for s in "ab" for c in names])


def _jaccard(a: set, b: set) -> float:
    n = len(a & b)
    return n / (len(a) + len(b) - n) if n else 0.0


def _places(text: str) -> dict[str, int]:
    """Where each character is, as bits."""
    at: dict[str, int] = {}
    for k, x in enumerate(text):
        at[x] = at.get(x, 0) | 1 << k
    return at


def _common(at: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence with a text of that length: no less than what the sequence ratio matches."""
    full = open_ = (1 << n) - 1
    for x in text:
        if hit := open_ & at.get(x, 0):
            open_ = (open_ + hit | open_ - hit) & full
    return n - open_.bit_count()


def score_pairs(pairs: DataFrame, sequence: bool = True) -> DataFrame:
    """(paper_a, paper_b, title_similarity, author_similarity, year_similarity, combined_score, reasons)."""
    words = jaccard(F.col("toks_a"), F.col("toks_b"))
    differ = lambda c: F.when(words < 1, F.col(c))  # noqa: E731 - the same words are as alike as can be
    title = F.greatest(words, sequence_ratio(differ("norm_a"), differ("norm_b"))) if sequence else words
    p = pairs.select("*", title.alias("t"), jaccard(F.col("names_a"), F.col("names_b")).alias("au"), year_similarity(F.col("year_a"), F.col("year_b")).alias("y"))
    same_doi = (F.col("doi_a") != "") & (F.col("doi_a") == F.col("doi_b")) & ~F.col("doi_a").isin(*NO_DOI)
    same_cid = (F.col("cid_a") != "") & (F.col("cid_a") == F.col("cid_b"))
    boost = F.greatest(F.when(same_doi, SAME_DOI).otherwise(0.0), F.when(same_cid, SAME_ID).otherwise(0.0))
    total = F.least(F.lit(1.0), TITLE * F.col("t") + AUTHORS * F.col("au") + YEAR * F.col("y") + boost)
    reasons = F.array_compact(F.array(F.when(same_doi, "exact_doi"), F.when(same_cid, "exact_canonical_id"), F.when(F.col("t") >= 0.92, "title_near_exact"), F.when(F.col("au") >= 0.6, "author_overlap"), F.when(F.col("y") >= 0.7, "year_close")))
    return p.select(
        F.col("ord_a").alias("paper_a"), F.col("ord_b").alias("paper_b"), F.round("t", 4).alias("title_similarity"), F.round("au", 4).alias("author_similarity"),
        F.round("y", 4).alias("year_similarity"), F.round(total, 4).alias("combined_score"), F.array_join(reasons, ",").alias("reasons"),
    )


def group_pairs(pairs: DataFrame, a: str, b: str, max_rounds: int = 64) -> DataFrame:
    """(member, group_id): members of groups of linked records; the least member names the group.

    Large stars and small stars in turn: each vertex hangs its larger neighbours, then its smaller
    ones, on its least neighbour, until the links form stars. Every round is written to the shared checkpoint folder.
    """
    e = materialize(pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    # the links are the same if their number and the sums of two hashes of them are
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("long"))).first())
    before = sign(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.withColumnRenamed("m", "v"))
        e = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), e)
        now = sign(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no stars after {max_rounds} rounds")
    return e.select(F.col("u").alias("member"), F.col("v").alias("group_id")).unionByName(e.select(F.col("v").alias("member"), F.col("v").alias("group_id"))).distinct()


def completeness(p: DataFrame) -> Column:
    """How much of a record is known: doi 10, published and authors 5, venue 2, a flag 1 each."""
    w = lambda c, n: F.when(c, n).otherwise(0)
    return (
        w(~is_unknown(F.col("doi")), 10) + w(~is_unknown(F.col("published")), 5) + w(F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0, 5)
        + w(~is_unknown(F.col("venue")), 2) + w(to_flag(F.col("is_favorite")), 1) + w(F.coalesce("in_reading_list", F.lit(False)), 1)
    )


def merge_groups(papers: DataFrame, group: str, ord_: str) -> DataFrame:
    """One record a group: the most complete one, its doi and venue filled from the first member that knows them, flags OR-ed, tags united."""
    p = papers.where(F.col(group).isNotNull()).withColumn("score", completeness(papers))
    fill = lambda c: F.coalesce(F.min_by(F.when(~is_unknown(F.col(c)), F.col(c)), F.struct((-F.col("score")).alias("s"), F.col(ord_).alias("o"))), F.min_by(c, F.when(~is_unknown(F.col(c)), F.col(ord_))))
    g = p.groupBy(group).agg(
        F.count("*").alias("members"), F.min_by(ord_, F.struct((-F.col("score")).alias("s"), F.col(ord_).alias("o"))).alias("keep"), F.max("score").alias("completeness"),
        fill("doi").alias("doi"), fill("venue").alias("venue"), F.bool_or(to_flag(F.col("is_favorite"))).alias("is_favorite"), F.bool_or(F.coalesce("in_reading_list", F.lit(False))).alias("in_reading_list"),
    ).where("members > 1")
    tag = p.select(F.col(group).alias("_group"), F.explode(parse_tags(F.col("tags"))).alias("tag")).distinct()
    tags = tag.groupBy("_group").agg(F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags"))
    return g.join(tags, F.col(group) == F.col("_group"), "left").withColumn("tags", F.coalesce("tags", F.lit(""))).drop("_group")
