"""Matching entities across sources without keys.

Records of two sources become candidates where they share a block key: the words of the title (all,
or all but one, so one damaged word on either side is forgiven), one half of the title together
with a family name, or the DOI together with a family name or title. A candidate pair gets a vector
of similarities of title, authors, year and DOI, each of which may be missing; a pair that names
authors on both sides, none of them alike, and no common DOI is no candidate. Two Gaussian
components, of matches and of others, are fitted to the vectors by expectation maximisation without
labels; variances are floored and pulled to the pooled ones, and missing similarities are
integrated out. A pair of titles less alike than LEAST_ALIKE without a common DOI is no candidate
either: works that share half a title and a family name grow with the square of the records, and
would crowd the matches out of the fit. Transitivity is enforced in every expectation step: records of the left side that
are known to be one entity, or that are linked through a record of the right side which surely
matches both, get one posterior per partner, and the maximisation uses those constrained ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from litmill.llm.fusion import MISSING
from litmill.llm.names import acronym, plain, readings, slips
from litmill.session import distinct_names, materialize, sized

#: A title with fewer words than this is no block key by itself where both sides name authors.
LEAST_WORDS = 4
#: Titles less alike than this are no candidate without a common DOI.
LEAST_ALIKE = 0.7
#: In a block with more profiles than this on both sides, pairs are sifted before they are made; the sieve changes no result.
WARM_BLOCK = 20
#: A title block with more profiles than this on both sides is divided; the division changes no result.
HOT_BLOCK = 150
#: Rows of either side per task of a divided block.
TILE = 1000
#: Rounds of expectation and maximisation between two steps of linking, and the change below which the fit rests.
ROUNDS, STILL = 8, 0.01
#: Posteriors from which a pair is a match, and from which it links others.
MATCH, SURE = 0.5, 0.95

#: Words that carry no meaning in titles.
STOP = frozenset("a an and as at be for from in into is its of on or the to under when with der die das und für von el la los las de y en".split())
#: Marks of an edition behind a title.
EDITION = r"(?:v(?:ersion)?\.? ?\d+|pre-?print|working paper|extended abstract|abstract|draft|revised(?: version)?|short paper|technical report|accepted manuscript|author version|online first|reprint)"

_EDITION = re.compile(rf"[\s.,;:–—\-]*[(\[]?\s*\b{EDITION}\s*[)\]]?[\s.]*$")
_EDITION_ENDS = ("print", "paper", "abstract", "draft", "revised", "version", "report", "manuscript", "first")
_ENTITY = re.compile(r"&[a-z]+;")
_PART = re.compile(r"\b(?:part|pt\.?|teil|parte)\s+([ivx]+|\d+)\b")
_HALVES = re.compile(r"[:?–—]|\s-\s")
_WORD = re.compile(r"[^\W_]+")
#: British endings are made American ones.
_OUR, _ISE = re.compile(r"(?<=[^\W\d_]{3})our(?=s?\b)"), re.compile(r"(?<=[^\W\d_]{3})is(?=(?:e|ed|es|er|ers|ing|ation|ations)\b)")
_YEAR = re.compile(r"(?<!\d)(?:1[5-9]|20)\d\d(?!\d)")
_DOI = re.compile(r"(?:doi:\s*|info:doi/|https?://[^/\s]+/)*(10\.\d{4,9}/[^\s…]*[^\s….,;)])[.,;)]?$")
_MARKUP = str.maketrans("", "", "{}\\$")
_CUT = re.compile(r"(?:…|\.\.\.)$")


@dataclass(slots=True)
class Profile:
    """What a record is compared by. left and right are blank-separated and sorted; authors are codes."""

    left: str
    right: str
    part: str
    authors: str
    year: int | None
    doi: str | None

    @property
    def words(self) -> str:
        if not self.right or not self.left:
            return self.left or self.right
        return " ".join(sorted({*self.left.split(), *self.right.split()}))


def _usable(x: str | None) -> str | None:
    t = x.strip() if x else ""
    return None if t.lower() in MISSING or _CUT.search(t) else t


@lru_cache(maxsize=200_000)
def _form(word: str) -> str:
    """A word of a title with one spelling for British and American endings."""
    return _ISE.sub("iz", _OUR.sub("or", word))


def _bag(t: str) -> set[str]:
    return {_form(w) for w in _WORD.findall(t) if w not in STOP}


@lru_cache(maxsize=200_000)
def author_code(name: str) -> str:
    """Readings of a typed name as `kind:key:given:middle`, with `/` between them; empty for no name."""
    return "/".join(f"{k}:{key}:{given}:{middle[:1]}" for k, key, given, _, middle in readings(name))


def _without_edition(t: str) -> str:
    if t[-1:].isalpha() and not t.endswith(_EDITION_ENDS):
        return t
    m = _EDITION.search(t, max(0, len(t) - 40))
    return t[: m.start()] if m else t


def profile(title: str | None, authors: list[str | None] | None, published: str | None, doi: str | None) -> Profile:
    t = plain((_usable(title) or "").translate(_MARKUP))
    if "&" in t:
        t = _ENTITY.sub(" ", t)
    t = _without_edition(_without_edition(t))
    part = _PART.search(t)
    if part:
        t = _PART.sub(" ", t)
    left, right = [_bag(h) for h in [*_HALVES.split(t, maxsplit=1), ""][:2]]
    codes = [c for c in (author_code(a) for a in authors or () if a) if c]
    year = _YEAR.search(published) if published else None
    d = _DOI.match(doi.strip().lower()) if doi else None
    return Profile(
        " ".join(sorted(left)), " ".join(sorted(right)), part[1] if part else "", "|".join(codes), int(year[0]) if year else None, d[1] if d else None
    )


@lru_cache(maxsize=200_000)
def _keys_of(code: str) -> tuple[str, ...]:
    return tuple(r.split(":", 2)[1] for r in code.split("/"))


def _families(p: Profile) -> list[str]:
    return list(dict.fromkeys(k for code in p.authors.split("|") for k in _keys_of(code))) if p.authors else []


_M64 = (1 << 64) - 1


@lru_cache(maxsize=400_000)
def _hash(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\x1f{text}")


_HALF = 1 << 63


def block_keys(p: Profile, right: bool = False) -> list[int]:
    """Keys of the title, which are even, and keys with a name or DOI, which are odd.

    Short titles are borne by many works, so with authors on both sides they are keys only together
    with a near form of a name; a record without authors meets all of the other side's.

    A set of words is keyed by the sum of the words' hashes, so leaving one out is a subtraction.
    """
    hs = [_hash("w", w) for w in p.words.split()]
    fam = [_hash("f", f) for f in _families(p)]
    title = []
    total = sum(hs) + _hash("part", p.part)
    short = []
    if len(hs) >= LEAST_WORDS:
        title = [(total & _M64) - _HALF, *[((total - h) & _M64) - _HALF for h in hs]]
    elif hs:
        # unnamed on the left with any on the right, named on the left with unnamed on the right
        kinds = [_hash("any", "")] * (right or not p.authors) + [_hash("unnamed", "")] * (right != bool(p.authors))
        short = [((total + k) & _M64) - _HALF for k in (*kinds, *(near_forms(p.authors) if p.authors else ()))]
    left = sum([_hash("l", w) for w in p.left.split()])
    sure = [((left + f) & _M64) - _HALF for f in fam] if p.left else []
    if " " in p.right:
        right = sum([_hash("r", w) for w in p.right.split()])
        sure += [((right + f) & _M64) - _HALF for f in fam]
    if p.doi:
        d = _hash("d", p.doi)
        sure += [*[((d + f) & _M64) - _HALF for f in fam], ((d + left) & _M64) - _HALF]
    return list({k & -2 for k in title} | {k | 1 for k in (*sure, *short)})


def near_forms(authors: str) -> set[int]:
    """Hashes of which two author codes share one if `same_name` finds any name alike: what is left of a key without up to two letters."""
    out = set()
    for code in authors.split("|"):
        for reading in code.split("/"):
            kind, key = reading.split(":", 2)[:2]
            if kind == "o":
                out.add(_hash("form", "a" + acronym(key)))
            for w in {key, _bare(key)}:
                ones = {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}
                out |= {_hash("form", kind + v) for u in ones for v in (u, *(u[:i] + u[i + 1 :] for i in range(len(u))))}
    return {h - _HALF for h in out}


_PROFILE = [
    ("id", pa.int64()), ("left", pa.string()), ("right", pa.string()), ("part", pa.string()), ("authors", pa.string()), ("year", pa.int32()), ("doi", pa.string()),
    ("keys", pa.list_(pa.int64())),
]
COMPARED = ["left", "right", "part", "authors", "year", "doi"]


def prepare(df: DataFrame, row_id: str, right: bool = False) -> DataFrame:
    """The Profile of each record with its block keys; id is the same for records with the same profile."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = [profile(*x) for x in zip(*(b.column(k).to_pylist() for k in range(1, 5)))]
            ids = [xxhash.xxh64_intdigest("\x1f".join(str(getattr(p, n)) for n in COMPARED)) - _HALF for p in ps]
            cols = [b.column(0), pa.array(ids, pa.int64()), *(pa.array([getattr(p, n) for p in ps], t) for n, t in _PROFILE[1:7]), pa.array([block_keys(p, right) for p in ps], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["pid", *(n for n, _ in _PROFILE)])

    schema = "pid bigint, id bigint, left string, right string, part string, authors string, year int, doi string, keys array<bigint>"
    return df.select(F.col(row_id).alias("pid"), "title", "authors", "published", "doi").mapInArrow(each, schema)


def candidates(a: DataFrame, b: DataFrame, hot_block: int = HOT_BLOCK) -> DataFrame:
    """Distinct (a, b) of profiles that share a block; pairs that `vector` refuses may be left out.

    A block with more than WARM_BLOCK profiles on both sides - half a title and a family name that
    many records share - gives only pairs that pass `sift`. A title block with more than hot_block
    on both sides - a title that very many records bear - is divided. Profiles with authors on both
    sides meet where their names have a form in common, which every pair with a name alike has;
    profiles without authors meet all others of the block, in tiles of bounded size. Nothing is lost
    by it, so the result depends on neither size.
    """
    x, y = (p.select("id", F.explode("keys").alias("key")) for p in (a, b))
    warm_block = min(WARM_BLOCK, hot_block)
    # counted on the second side first: only the few keys that are frequent there are counted on the first
    often = lambda df, n: materialize(df.groupBy("key").agg(F.count("*").alias(n)).where(F.col(n) > warm_block))
    warm = often(y, "ny")
    if not warm.isEmpty():
        warm = materialize(often(x.join(sized(warm.select("key"), warm), "key", "left_semi"), "nx").join(warm, "key").select("key", ((F.col("key") % 2 == 0) & (F.col("nx") > hot_block) & (F.col("ny") > hot_block)).alias("hot")))
    if warm.isEmpty():
        return _pairs(x, y, ["key"]).distinct()
    keys = sized(warm.select("key"), warm)
    cold = _pairs(x.join(keys, "key", "left_anti"), y.join(keys, "key", "left_anti"), ["key"])
    within = lambda df, hot: df.join(sized(warm.where("hot" if hot else "not hot").select("key"), warm), "key", "left_semi").distinct()
    sifted = _sifted(_tiled(_signed(within(x, False), a), _signed(within(y, False), b)))
    if warm.where("hot").isEmpty():
        return cold.unionByName(sifted).distinct()
    (xn, xu), (yn, yu) = (_by_authors(within(df, True), p) for df, p in ((x, a), (y, b)))
    named = _tiled(_formed(xn), _formed(yn))
    xn, yn = xn.drop("authors"), yn.drop("authors")
    unnamed = _tiled(xu, yu.unionByName(yn)).unionByName(_tiled(xn, yu))
    return cold.unionByName(sifted).unionByName(named).unionByName(unnamed).distinct()


def _pairs(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
    signs = [F.col(f"sign_{n}") for n in "ab" if "sign" in x.columns]
    return x.withColumnsRenamed({"id": "a", "sign": "sign_a"}).join(y.withColumnsRenamed({"id": "b", "sign": "sign_b"}), on).select("a", "b", *signs)


def _tiled(x: DataFrame, y: DataFrame) -> DataFrame:
    """(a, b) of the rows (id, key) with equal keys, each key's pairs divided into tiles of about TILE rows of either side."""
    count = lambda df, n: df.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias(n))
    tiles = materialize(count(x, "nx").join(count(y, "ny"), "key"))
    to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    p = x.join(tiles, "key").select(*x.columns, place("nx").alias("i"), F.explode(to("ny")).alias("j"))
    q = y.join(tiles, "key").select(*y.columns, F.explode(to("nx")).alias("i"), place("ny").alias("j"))
    return _pairs(p, q, ["key", "i", "j"])


def _signed(keys: DataFrame, profiles: DataFrame) -> DataFrame:
    """keys (id, key) with the `sign` of each profile."""
    there = profiles.join(keys.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            signs = [sign(Profile(*x)).tobytes() for x in zip(*(c.to_pylist() for c in b.columns[1:]))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(signs, pa.binary())], names=["id", "sign"])

    signs = materialize(there.select("id", *COMPARED).mapInArrow(each, "id bigint, sign binary"))
    return materialize(keys.join(sized(signs), "id").select("id", "key", "sign"))


def _sifted(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, sign_a, sign_b) that pass `sift`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                yield part.select(["a", "b"]).filter(pa.array(sift(_signs(part.column(2)), _signs(part.column(3)))))

    return pairs.mapInArrow(each, "a bigint, b bigint")


@lru_cache(maxsize=400_000)
def _letters(word: str) -> int:
    """A bit for each letter: an edit changes two bits at most, a swap none."""
    bits = 0
    for x in word:
        bits |= 1 << ord(x) % 26
    return bits


#: Marks of a sign's second number, beside the number of words; the mark of a person's name.
_RIGHT, _TITLED, _PERSON = 1 << 16, 1 << 17, 1 << 31
#: Profiles with more words or names than this are not judged by them.
_SIGNED = 40


def sign(p: Profile) -> np.ndarray:
    """What `sift` knows of a profile: DOI, number of words and marks, words (letters and length), names (letters and initial)."""
    words, names = p.words.split(), set()
    for code in p.authors.split("|") if p.authors else ():
        for kind, key, given, _ in (r.split(":") for r in code.split("/")):
            names |= {_letters(w) | (ord(given[0]) % 31 + 1 if given else 0) << 26 | _PERSON if kind == "p" else 0 for w in (key, _bare(key))}
    words, names = (x if len(x) <= _SIGNED else [] for x in (words, sorted(names)))
    head = [_hash("d", p.doi) >> 32 | 1 if p.doi else 0, len(words) | bool(p.right) * _RIGHT | bool(words) * _TITLED]
    return np.array([*head, *(_letters(w) | min(len(w), 63) << 26 for w in words), *names], np.uint32)


def _signs(column: pa.Array) -> tuple[np.ndarray, ...]:
    """doi, marks, words and names of an array of signs; words and names as rows, with where they are filled."""
    raw = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] // 4
    data = np.frombuffer(raw.buffers()[2], np.uint32, count=at[-1])
    doi, marks, end = data[at[:-1]], data[at[:-1] + 1], at[1:]
    middle = at[:-1] + 2 + (marks & 0xFFFF)

    def rows(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = first[:, None] + np.arange(max((last - first).max(initial=0), 1))
        there = place < last[:, None]
        return data[np.where(there, place, 0)], there

    return doi, marks, *rows(at[:-1] + 2, middle), *rows(middle, end)


def sift(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> np.ndarray:
    """For each pair of signs False only if `vector` refuses the profiles: by titles or by names, and without a common DOI."""
    (dx, mx, wx, in_wx, nx, in_nx), (dy, my, wy, in_wy, ny, in_ny) = x, y
    letters = np.uint32((1 << 26) - 1)
    apart = lambda p, q: np.bitwise_count((p[:, :, None] ^ q[:, None, :]) & letters)
    long = lambda w: (w >> np.uint32(26)).astype(np.int8)
    lx, ly = long(wx)[:, :, None], long(wy)[:, None, :]
    edits = np.minimum((lx > 3).astype(np.int8) + (lx > 7), 2) * (ly > 3)
    fit = in_wx[:, :, None] & in_wy[:, None, :] & (apart(wx, wy) <= 2 * edits) & (np.abs(lx - ly) <= edits)
    # each word has one partner at most
    common = np.minimum(fit.any(2).sum(1), fit.any(1).sum(1))
    both = ((mx & my) & _TITLED).astype(bool) & (((mx ^ my) & _RIGHT) == 0)
    unlike = both & (2 * common < LEAST_ALIKE * ((mx & 0xFFFF) + (my & 0xFFFF)).astype(float) - 1e-9)
    px, py = nx[:, :, None], ny[:, None, :]
    # persons are alike with the same letters, or with two edits and one initial; other names are not judged here
    near = apart(nx, ny)
    person = ((px & py) & _PERSON).astype(bool)
    other = ((px | py) & _PERSON) == 0
    alike = other | (person & ((near == 0) | ((near <= 4) & (((px ^ py) >> np.uint32(26)) == 0))))
    strange = in_nx.any(1) & in_ny.any(1) & ~(alike & in_nx[:, :, None] & in_ny[:, None, :]).any((1, 2))
    return ((dx == dy) & (dx != 0)) | ~(unlike | strange)


def _by_authors(keys: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """keys (id, key) of the profiles with authors, with these, and of those without."""
    got = materialize(keys.join(profiles.groupBy("id").agg(F.first("authors").alias("authors")), "id"))
    return got.where("authors <> ''"), got.where("authors = ''").drop("authors")


def _formed(keys: DataFrame) -> DataFrame:
    """(id, key) with a key for each near form of the profile's authors within the old key."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, xxhash.xxh64_intdigest(f"{k}\x1f{f}") - _HALF) for i, k, au in zip(*(c.to_pylist() for c in b.columns)) for f in near_forms(au)]
            for at in range(0, max(len(rows), 1), 100_000):
                cols = list(zip(*rows[at : at + 100_000])) or [[], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "key"])

    return keys.select("id", "key", "authors").mapInArrow(each, "id bigint, key bigint")


@lru_cache(maxsize=400_000)
def same_name(x: str, y: str) -> float:
    """How well two author codes may be one person or organisation, 0 to 1."""
    if x == y:
        return 1.0
    best = 0.0
    for p in x.split("/"):
        for q in y.split("/"):
            (kp, a, g, m), (kq, b, h, n) = p.split(":"), q.split(":")
            if {kp, kq} == {"o", "a"}:
                o, short = (a, b) if kp == "o" else (b, a)
                best = max(best, 1.0 if acronym(o) == short else 0.0)
            elif kp == kq and (a == b or (abs(len(a) - len(b)) <= 2 and (kp != "p" or g[:1] == h[:1]))):
                off = 0 if a == b else min(slips(a, b, 2), slips(_bare(a), _bare(b), 2))
                if off > (2 if len(a) > 6 else 1):
                    continue
                fit = 1.0 - 0.1 * off - 0.3 * (kp == "p" and g[:1] != h[:1]) - 0.3 * (kp == "p" and bool(m and n) and m != n)
                best = max(best, fit)
    return best


def _bare(x: str) -> str:
    return x.replace("ae", "a").replace("oe", "o").replace("ue", "u")


def author_similarity(x: str, y: str) -> float | None:
    """The mean best fit of the shorter list's names in the longer list; None if either has no name."""
    if not x or not y:
        return None
    a, b = x.split("|"), y.split("|")
    if len(a) > len(b):
        a, b = b, a
    return sum(1.0 if n in b else max(same_name(n, m) for m in b) for n in a) / len(a)


def _soft(x: str, y: str) -> float:
    if x == y:
        return 1.0
    a, b = set(x.split()), set(y.split())
    common = a & b
    score = float(len(common))
    rest = sorted(b - common)
    for w in sorted(a - common):
        for v in rest:
            if len(w) > 3 and len(v) > 3 and slips(w, v, 2) <= (1 if len(w) < 8 else 2):
                score += 0.9
                rest.remove(v)
                break
    return 2 * score / max(1, len(a) + len(b))


def title_similarity(x: Profile, y: Profile) -> float | None:
    """Soft overlap of the words; of the left halves alone, a little less, if one title lacks its right half."""
    if x.left == y.left and x.right == y.right:
        return 1.0 if x.left or x.right else None
    v, w = x.words, y.words
    if not v or not w:
        return None
    s = _soft(v, w)
    if (not x.right) != (not y.right):
        s = max(s, 0.93 * _soft(x.left, y.left))
    return s


def different_parts(x: Profile, y: Profile) -> bool:
    cut = (not x.right) != (not y.right) and not (x.part and y.part)
    return x.part != y.part and not cut


TITLE, AUTHOR, YEAR, DOI = 20, 10, 4, 1
STEPS = np.array([TITLE, AUTHOR, YEAR, DOI])
#: Least variance of a similarity in a component.
FLOOR = 0.02


def vector(x: Profile, y: Profile) -> tuple[int, int, int, int]:
    """Similarities on the grid of STEPS; -1 where one is missing. All -1 refuses a pair without a common DOI whose titles are less alike than LEAST_ALIKE, or of which both name authors, none alike."""
    t = title_similarity(x, y)
    if t is not None and t < LEAST_ALIKE and (x.doi is None or x.doi != y.doi):
        return (-1, -1, -1, -1)
    a = author_similarity(x.authors, y.authors)
    if t is not None and different_parts(x, y):
        t = 0.3 * t
    year = -1 if x.year is None or y.year is None else (4, 3, 1, 0)[min(3, abs(x.year - y.year))]
    doi = -1 if x.doi is None or y.doi is None else int(x.doi == y.doi)
    if a == 0.0 and doi != 1:
        return (-1, -1, -1, -1)
    return (-1 if t is None else round(t * TITLE), -1 if a is None else round(a * AUTHOR), year, doi)


@dataclass(frozen=True)
class Mixture:
    mean: np.ndarray
    var: np.ndarray
    prior: float


def pooled_variance(cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
    there = cells >= 0
    x = np.where(there, cells / STEPS, 0.0)
    return np.array([np.cov(x[there[:, f], f], aweights=weight[there[:, f]], ddof=0) if there[:, f].any() else FLOOR for f in range(x.shape[1])])


def maximise(cells: np.ndarray, weight: np.ndarray, gamma: np.ndarray, pooled: np.ndarray, pull: float = 0.2) -> Mixture:
    """Two Gaussians with independent, regularised features; cells hold -1 for missing values.

    Pairs refused for their titles are others too. They are not counted, as their number grows with
    the square of the records: for each of the others one stands in the fit, at half of LEAST_ALIKE.
    """
    there = cells >= 0
    x = np.where(there, cells / STEPS, 0.0)
    mean, var = np.zeros((2, x.shape[1])), np.zeros((2, x.shape[1]))
    for c, g in enumerate((1 - gamma, gamma)):
        w = (g * weight)[:, None] * there
        # half a pair of prior weight at the far ends keeps an empty component apart
        refused = np.array([0.0 if c else w[:, 0].sum(), 0.0, 0.0, 0.0])
        n = w.sum(0) + refused + 1
        mean[c] = ((w * x).sum(0) + refused * LEAST_ALIKE / 2 + (0.2, 0.9)[c]) / n
        var[c] = np.maximum(FLOOR, (1 - pull) * ((w * (x - mean[c]) ** 2).sum(0) + refused * (LEAST_ALIKE / 2 - mean[c]) ** 2) / n + pull * pooled * (0.5 if c else 1.0))
    matches, others = (gamma * weight).sum(), 2 * ((1 - gamma) * weight).sum()
    return Mixture(mean, var, float(np.clip(matches / max(matches + others, 1e-9), 0.02, 0.98)))


def expect(cells: np.ndarray, m: Mixture) -> np.ndarray:
    """Posteriors of a match. Beyond a component's mean, away from the other, a value counts as the mean."""
    there = cells >= 0
    x = cells / STEPS
    logs = []
    for c in (0, 1):
        y = np.maximum(x, m.mean[0]) if c == 0 else np.minimum(x, m.mean[1])
        logs.append((there * (-0.5 * np.log(m.var[c]) - (y - m.mean[c]) ** 2 / (2 * m.var[c]))).sum(1))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log((1 - m.prior) / m.prior), -60, 60)))


def start_of(cells: np.ndarray) -> np.ndarray:
    """Magnitude of the vectors: what agrees in title and nothing else known against it begins as a match."""
    t, a, y, d = (np.where(cells[:, k] >= 0, cells[:, k] / STEPS[k], np.nan) for k in range(4))
    good = (np.nan_to_num(t, nan=0.0) >= 0.8) & (np.nan_to_num(a, nan=0.6) >= 0.5)
    return np.where(good | ((np.nan_to_num(d, nan=0.0) == 1) & (np.nan_to_num(a, nan=0.0) >= 0.5)), 0.95, 0.05)


CELL = ["title", "author", "year", "doi"]


def _scored(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs (a, b) with their cells, and whether b names authors."""
    side = lambda p, n: p.groupBy(F.col("id").alias(n)).agg(*[F.first(c).alias(f"{n}_{c}") for c in COMPARED])
    # the smaller side's fields travel with the pairs
    joined = pairs.join(side(b, "b"), "b").join(side(a, "a"), "a").select("a", "b", *[f"{n}_{c}" for n in "ab" for c in COMPARED])
    k = len(COMPARED)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns[2:]]
            got = [vector(Profile(*x[:k]), Profile(*x[k:])) for x in zip(*cols)]
            cells = list(zip(*got)) if got else [[]] * 4
            named = pa.array([bool(x) for x in cols[k + COMPARED.index("authors")]], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int32()) for c in cells), named], names=["a", "b", *CELL, "named"])

    return joined.mapInArrow(score, "a bigint, b bigint, title int, author int, year int, doi int, named boolean").where("title >= 0 or author >= 0 or year >= 0 or doi >= 0")


def match_records(left: DataFrame, right: DataFrame, left_id: str, right_id: str, same: str | None = None, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(left_id, right_id, confidence) of all pairs judged to be one entity.

    Both tables have title, authors (array), published and doi. `same` names a column of `left` that
    is equal, where not null, on records known to be one entity; such records share one posterior
    per right record, and all of them match if it reaches MATCH. Records that surely match a common
    right record share theirs too, as far as they are candidates of the partner at all.

    Any field may be null, empty or a stand-in for missing. A record with neither title nor DOI is
    only matched through `same`. Repeated records match alike; an empty side gives no rows. Ids have
    to be unique and not null. Other columns are ignored. Copies are compared once: records of one
    profile are one, and only the result is spread to them.
    """
    fields = ["title", "authors", "published", "doi"]
    # the marks keep a null in one field from standing for a null in another; two of n different
    # records share a 64-bit hash with a chance of n^2 / 2^65
    profile = F.xxhash64(*fields, *[F.col(c).isNull() for c in fields])
    l = distinct_names(left, left_id, *fields, *([same] if same else [])).withColumn("pid", profile)
    r = distinct_names(right, right_id, *fields).withColumn("pid", profile)
    one = lambda df: df.groupBy("pid").agg(*[F.first(c).alias(c) for c in fields])
    a, b = materialize(prepare(one(l), "pid")), materialize(prepare(one(r), "pid", right=True))
    group = F.when(F.col(same).isNotNull(), F.xxhash64(F.lit("same"), F.col(same))).otherwise(F.col("id")) if same else F.col("id")
    members = materialize(l.join(a.select("pid", "id", (F.col("authors") != "").alias("has")), "pid").select("id", F.col(left_id).alias("lid"), group.alias("g"), "has"))
    scored = _scored(candidates(a, b, hot_block), a, b)
    of = members.groupBy(F.col("id").alias("a"), "g").agg(F.first("has").alias("has"))
    met = _gathered(scored.join(of, "a").groupBy("g", "b", _cell_no().alias("c")).agg(F.count("*").alias("n"), F.max("named").alias("both")))
    pairs = materialize(met.join(members.groupBy("g").agg(F.max("has").alias("has")), "g").select("g", "b", "cells", (F.col("both") & F.col("has")).alias("both")))
    judged, labels = _fitted(pairs)
    if judged is None:
        return left.sparkSession.createDataFrame([], T.StructType([left.schema[left_id], right.schema[right_id], T.StructField("confidence", T.DoubleType())]))
    hits = judged.where(F.col("p") >= MATCH).select("g", "b", "p")
    if labels is not None:  # from the linked groups back to those of which a record met the partner
        met = pairs.select(F.col("g").alias("own"), "b").distinct().join(labels.withColumnRenamed("g", "own"), "own", "left")
        hits = hits.join(met.select("own", F.coalesce("label", "own").alias("g"), "b"), ["g", "b"]).select(F.col("own").alias("g"), "b", "p")
    right_rows = r.join(b.select("pid", F.col("id").alias("b")), "pid").select("b", F.col(right_id).alias("rid"))
    return hits.join(members.select("lid", "g"), "g").join(right_rows, "b").select(F.col("lid").alias(left_id), F.col("rid").alias(right_id), F.round("p", 6).alias("confidence")).distinct()


SIZES = STEPS + 2


def _cell_no() -> Column:
    """The number of a cell, below 22 * 12 * 6 * 3."""
    no = F.lit(0)
    for c, size in zip(CELL, SIZES.tolist()):
        no = no * size + F.col(c) + 1
    return no


def _cells_of(numbers: np.ndarray) -> np.ndarray:
    return np.stack(np.unravel_index(numbers, SIZES), axis=1) - 1


def _gathered(kinds: DataFrame) -> DataFrame:
    """(g, b, cells, both): the kinds (g, b, c, n, both) of pairs between a group and a partner as one array, of bounded length."""
    return kinds.groupBy("g", "b").agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("cells"), F.max("both").alias("both"))


def _summed(of: Callable[[Column], Column]) -> Column:
    """The sum of `of` over all pairs in an array of cells."""
    return F.aggregate("cells", F.lit(0.0), lambda total, x: total + x["n"] * of(x))


def _fitted(pairs: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """(judged, labels) of pairs (g, b, cells, both): the constrained posterior p per (g, b), and the groups that were linked.

    Expectation: the log odds of all pairs between a group and a partner have one mean, from which
    all get one posterior; it is 0 where both name authors but in no pair of records any is alike.
    Maximisation is over the counts of cells. Rounds work on the distinct arrays of cells. Once the
    fit rests, groups that surely match one partner are linked: they become one group, under the
    smallest label, and the rounds go on until the fit rests and no group is linked.
    """
    labels, gamma, seen = None, None, {}
    # the grid's strides tell whether a cell knows title and authors
    per_title, per_author = int(SIZES[1:].prod()), int(SIZES[2:].prod())
    author = lambda c: F.floor(c / per_author) % int(SIZES[1])
    alike = F.exists("cells", lambda x: author(x["c"]) > 0)
    while True:
        kinds = materialize(pairs.groupBy("cells", "both").agg(F.count("*").alias("m")))
        counted = kinds.select("m", F.explode("cells").alias("x")).groupBy("x.c").agg(F.sum(F.col("m") * F.col("x.n")).alias("w")).orderBy("c").collect()
        if not counted:
            return None, None
        numbers, weight = np.array([r["c"] for r in counted]), np.array([float(r["w"]) for r in counted])
        cells = _cells_of(numbers)
        pooled = pooled_variance(cells, weight)
        gamma = start_of(cells) if gamma is None else np.array([seen[k] for k in numbers.tolist()])
        for _ in range(ROUNDS):
            alone = np.clip(expect(cells, maximise(cells, weight, gamma, pooled)), 1e-4, 1 - 1e-4)
            odds = np.zeros(int(SIZES.prod()))
            odds[numbers] = np.round(np.log(alone / (1 - alone)), 6)
            known = F.from_json(F.lit("[" + ",".join(f"{x:g}" for x in odds) + "]"), "array<double>")
            total, n = _summed(lambda x, known=known: known[x["c"]]), _summed(lambda x: F.lit(1.0))
            p = F.when(F.col("both") & ~alike, 0.0).otherwise(1 / (1 + F.exp(-total / n))).alias("p")
            share = F.col("m") * F.col("x.n")
            got = kinds.select("m", p, F.explode("cells").alias("x")).groupBy("x.c").agg((F.sum(share * F.col("p")) / F.sum(share)).alias("p")).collect()
            seen = {r["c"]: r["p"] for r in got}
            new = np.array([seen[k] for k in numbers.tolist()])
            still, gamma = np.abs(new - gamma).max() < STILL, new
            if still:
                break
        judged = pairs.select("g", "b", "cells", p)
        # a pair that lacks title or authors on a side may be a match but links no others: works may share a title
        sure = judged.where((F.col("p") >= SURE) & F.exists("cells", lambda x: (x["c"] >= per_title) & (author(x["c"]) > 0))).select("g", "b")
        shared = sure.groupBy("b").agg(F.min("g").alias("label"), F.max("g").alias("last")).where("label < last").drop("last")
        moves = materialize(sure.join(shared, "b").groupBy("g").agg(F.min("label").alias("to")).where("to < g"))
        if moves.isEmpty():
            return judged, labels
        kinds = pairs.join(sized(moves), "g", "left").select(F.coalesce("to", "g").alias("g"), "b", "both", F.explode("cells").alias("x"))
        kinds = kinds.groupBy("g", "b", F.col("x.c").alias("c")).agg(F.sum("x.n").alias("n"), F.max("both").alias("both"))
        pairs = materialize(_gathered(kinds), *([pairs] if labels is not None else []))
        own = moves.select("g", F.col("to").alias("label"))
        if labels is not None:
            m = moves.withColumnRenamed("g", "label")
            kept = labels.join(m, "label", "left").select("g", F.coalesce("to", "label").alias("label"))
            own = kept.unionByName(own.join(labels, "g", "left_anti"))
        labels = materialize(own, *([labels] if labels is not None else []))


def match_papers(papers: DataFrame, resolved: DataFrame) -> DataFrame:
    """(paper_id, result_no, confidence): papers records and found resolver answers about the same work."""
    answers = distinct_names(resolved, "result_no", "found", "title", "authors", "published", "doi").where("found")
    return match_records(papers, answers, "paper_id", "result_no", same="canonical_id")
