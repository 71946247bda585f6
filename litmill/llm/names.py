"""Variant spellings of names typed by people: link each spelling to the entity it stands for.

A spelling is read in every way it can be meant: given name before or behind the family name,
initials, an organisation with its parts in another order or abbreviated, an acronym. Each reading
has a key - family name or organisation in plain letters - and keys are compared in the metric space
of the Levenshtein distance: every key of a spelling goes to the cell of its nearest pivot; a key of
the registry goes to each cell that may hold a key within the radius of it, which the triangle
inequality tells from its distances to the pivots; inside a cell an exact radius join with the true
distance finds all pairs: a string within the radius of another keeps at least one of radius + 1
segments of it unharmed, so the join is on segments and the distance is taken of few pairs. The
pairs are then judged by what the rest of the reading says.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litmill.session import checkpoint, distinct_names, materialize, sized

RADIUS = 2
#: Cells of the metric space: this many times the cube root of the number of registry keys.
CELLS = 5
#: Total cost up to which a spelling is taken for an entity (1 for each slip of the pen).
MAX_COST = 2.6

#: Common short forms of English given names that are not their beginning (`is_short` derives those that are).
NICKNAMES = {
    "Abigail": "Gail, Nabby", "Adelaide": "Heidi, Della", "Agnes": "Nessa, Aggie", "Albert": "Bert, Bertie", "Alexander": "Sasha, Sandy, Xander", "Alexandra": "Sasha, Sandra, Sandy",
    "Alfred": "Fred", "Amanda": "Mandy", "Andrew": "Drew", "Ann": "Nancy, Nan", "Anthony": "Tony", "Antonio": "Tony, Toni", "Augustus": "Gus", "Barbara": "Babs, Bobbie", "Bernard": "Barney", "Bridget": "Biddy",
    "Caroline": "Lina, Carrie", "Catherine": "Kate, Kathy, Katie, Kit, Kitty, Kay, Trina", "Charles": "Chuck, Chas, Chaz", "Charlotte": "Lottie, Lotte", "Christina": "Tina", "Christopher": "Kit, Topher", "Cornelius": "Neil",
    "Cynthia": "Cindy", "Deborah": "Debra", "Dorothy": "Dot, Dolly, Dottie", "Edward": "Ned, Ted, Teddy", "Eleanor": "Nell, Nora, Lena, Nelly", "Elizabeth": "Beth, Betty, Betsy, Bess, Bessie, Libby, Lizzie, Liz, Lisa, Lilibet",
    "Eugene": "Gene", "Evelyn": "Lyn", "Florence": "Flo, Floss", "Frances": "Fanny, Fran", "Francis": "Frank", "Frederick": "Rick, Fritz", "George": "Geordie", "Gerald": "Jerry", "Gertrude": "Trudy", "Gilbert": "Bert", "Gregory": "Greg",
    "Helen": "Nell, Nellie, Lena", "Henrietta": "Etta, Hettie", "Henry": "Harry, Hank, Hal", "Herbert": "Bert", "Hubert": "Bert", "Isabella": "Bella, Belle, Izzy", "Isabel": "Bell, Belle, Izzy", "James": "Jim, Jimmy, Jamie", "Jane": "Jenny, Janie",
    "Jennifer": "Jen", "John": "Jack, Jock", "Jonathan": "Nathan, Jon", "Joseph": "Joe, Joey", "Josephine": "Jo, Posy", "Katherine": "Kate, Kathy, Katie, Kit, Kitty, Kay, Trina", "Lawrence": "Larry, Laurie", "Leonard": "Len, Lenny", "Louisa": "Lulu",
    "Magdalena": "Lena", "Margaret": "Meg, Peg, Peggy, Greta, Maggie, Marge, Madge, Daisy, Rita", "Maria": "Mia", "Martha": "Patty", "Mary": "Polly, Molly, Mamie, Minnie", "Matilda": "Tilly", "Matthew": "Matt", "Michael": "Mike, Mick, Mickey",
    "Montgomery": "Monty", "Natalie": "Talia, Nat", "Nathaniel": "Nate, Nat", "Nicholas": "Nico, Klaus, Nick, Colin", "Olivia": "Liv, Livia", "Oliver": "Nolly", "Patricia": "Patty, Trish, Tricia", "Patrick": "Paddy", "Penelope": "Nell", "Philip": "Pip",
    "Prudence": "Prue", "Rebecca": "Becca, Becky", "Reginald": "Rex", "Richard": "Rick, Dick, Ricky", "Robert": "Bob, Bobby, Bert, Robin", "Roderick": "Rick", "Ronald": "Ronnie", "Rosalind": "Lindy", "Rosemary": "Romy", "Sarah": "Sally, Sadie", "Sebastian": "Bas, Seb",
    "Sophia": "Fifi", "Stephen": "Steve, Steph", "Susan": "Sue, Sukie", "Theodore": "Ted, Teddy", "Theresa": "Tess, Terry, Tracy", "Thomas": "Tom, Tommy", "Veronica": "Ronnie", "Victoria": "Tori, Vicky", "Virginia": "Ginny, Ginger", "Walter": "Wat, Wally",
    "William": "Bill, Billy, Willy, Liam", "Winifred": "Freddie, Win", "Yolanda": "Yoli",
}
KINDS = {"institute": "inst, institut", "consortium": "cons, consort", "laboratory": "lab, labs, laboratories", "centre": "center, ctr, cent, cntr", "university": "univ, uni", "department": "dept, dep"}
_TITLES = re.compile(r"^(?:(?:dr|prof|professor|mr|mrs|ms|sir|phd|md)\b\.?\s*)+", re.I)
_TAIL = re.compile(r"[\s*†‡§¹²³]+$")
_NOT_NAMES = re.compile(r"^(?:unknown|none|null|n/a|na|-|et\.? al\.?|anonymous|anon\.?|various|others|and others|tba)?$", re.I)
_FULL_KIND = {form: kind for kind, forms in KINDS.items() for form in [kind, *forms.split(", ")]}
_FILLERS = {"for", "of", "the", "and", "in", "on", "&"}
_FORMAL: dict[str, set[str]] = {}


_STROKES = str.maketrans({"ß": "ss", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "æ": "ae", "Æ": "AE"})
_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "å": "aa", "ø": "oe", "Ä": "Ae", "Ö": "Oe", "Ü": "Ue", "Å": "Aa", "Ø": "Oe"})


def plain(text: str) -> str:
    """Small letters without marks."""
    if text.isascii():
        return text.lower()
    t = unicodedata.normalize("NFKD", text.translate(_STROKES)).casefold()
    return "".join(c for c in t if not unicodedata.combining(c))


def spelled_out(name: str) -> str:
    """The name with its umlauts written as two letters."""
    return unicodedata.normalize("NFC", name).translate(_UMLAUTS)


for _name, _short in NICKNAMES.items():
    for _s in _short.split(", "):
        _FORMAL.setdefault(plain(_s), set()).add(plain(_name))

#: (kind, key, given, given is cut, middle initials); kind p for person, o for organisation, a for acronym
Reading = tuple[str, str, str, bool, str]


def _organisation(t: str) -> Reading | None:
    tokens = [w for w in re.findall(r"[^\W\d_]+", plain(t)) if w not in _FILLERS]
    at = next((k for k, w in enumerate(tokens) if w in _FULL_KIND), None)
    if at is None or len(tokens) < 3:
        return None
    kind, before, after = _FULL_KIND[tokens[at]], tokens[:at], tokens[at + 1 :]
    if not before:
        before, after = after[-1:], after[:-1]
    return ("o", " ".join([*before, kind, *after]), "", False, "")


def _person(given: str, family: str) -> Reading | None:
    key = re.sub(r"[^\w]+", "", plain(family))
    parts = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?\.?", given.replace("-", " "))
    if len(key) < 2 or not parts:
        return None
    if len(parts) == 1 and parts[0].isupper() and 2 <= len(parts[0]) <= 3 and not parts[0].endswith("."):
        parts = list(parts[0])  # AR for A. R.
    first = plain(parts[0])
    cut = first.endswith(".")
    return ("p", key, first.rstrip("."), cut or len(first) == 1, "".join(plain(p)[0] for p in parts[1:]))


def readings(name: str | None) -> list[Reading]:
    """All ways in which a typed name may be meant; none for what is no name."""
    if name is None:
        return []
    t = re.sub(r"\s+", " ", unicodedata.normalize("NFC", name)).strip()
    t = _TITLES.sub("", _TAIL.sub("", t))
    if _NOT_NAMES.match(t):
        return []
    whole = re.sub(r"\s*\([^)]*\)", "", t)
    org = _organisation(whole)
    if org:
        return [org]
    if re.fullmatch(r"[^\W\d_]{4,9}", t):
        return [("a", plain(t) if t.isupper() else "", "", False, "")] if t.isupper() else []
    out: list[Reading | None] = []
    if "," in whole:
        family, _, given = whole.partition(",")
        out.append(_person(given, family))
    else:
        tokens = re.findall(r"[^\s.]+\.?", re.sub(r"\.(?=\S)", ". ", whole))
        if len(tokens) < 2:
            return []
        last = tokens[-1].rstrip(".")
        if len(last) <= 2 and last.isupper() and len(tokens[0].rstrip(".")) > 2:
            out.append(_person(" ".join(tokens[-1:]), " ".join(tokens[:-1])))
        else:
            out.append(_person(" ".join(tokens[:-1]), tokens[-1]))
            if len(tokens[0].rstrip(".")) > 1 and not tokens[0].endswith("."):
                out.append(_person(" ".join(tokens[1:]), tokens[0]))
    return list(dict.fromkeys(r for r in out if r))


def entity_readings(name: str | None) -> list[Reading]:
    """The readings of a registered name: as written, with umlauts as two letters, and an organisation's acronym."""
    out = []
    for n in dict.fromkeys([name, spelled_out(name)] if name else []):
        for r in readings(n)[:1]:
            out.append(r)
            if r[0] == "o":
                out.append(("a", acronym(r[1]), "", False, ""))
    return list(dict.fromkeys(out))


def acronym(key: str) -> str:
    """Three letters of the place and the initials of the rest, of an organisation's key."""
    place, *rest = key.split(" ")
    return place[:3] + "".join(w[0] for w in rest)


def slips(a: str, b: str, most: int = 3) -> int:
    """Edits from a to b, a swap of neighbours counting as one; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, row, low = None, list(range(len(b) + 1)), 0
    for i, x in enumerate(a, 1):
        new = [i]
        least = i
        for j, y in enumerate(b, 1):
            d = row[j - 1] + (x != y)
            if row[j] < d:
                d = row[j] + 1
            if new[-1] < d:
                d = new[-1] + 1
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y and before[j - 2] < d:
                d = before[j - 2] + 1
            new.append(d)
            if d < least:
                least = d
        if least > most and low > most:
            return most + 1
        before, row, low = row, new, least
    return min(row[-1], most + 1)


def is_short(given: str, full: str) -> bool:
    """Whether given is a common short form of full: from the table, its beginning, or that with y, ie or i behind it."""
    if full in _FORMAL.get(given, ()):
        return True
    if 1 < len(given) < len(full) and full.startswith(given):
        return True
    stem = re.sub(r"(?:ie|y|i)$", "", given)
    if stem == given or len(stem) < 2:
        return False
    if stem[-1] == stem[-2]:
        stem = stem[:-1]
    return len(stem) > 1 and len(stem) + 1 < len(full) and full.startswith(stem)


def judge(s: Reading, e: Reading) -> float | None:
    """The cost of taking reading s of a spelling for reading e of an entity; None if they contradict."""
    kind, key, given, cut, middle = s
    if kind != e[0]:
        return None
    off = slips(key, e[1])
    if kind == "a":
        return 0.5 if off == 0 else None
    if kind == "o":
        return float(off) if off <= 2 else None
    full = e[2]
    if given == full:
        cost = 0.0
    elif cut and full.startswith(given):
        cost = 0.5 if len(given) == 1 else 0.2
    elif not cut and is_short(given, full):
        cost = 0.2
    elif not cut and len(given) > 2:
        cost = float(slips(given, full))
        if cost > 2 or cost > len(full) / 3 + 0.5:
            return None
    else:
        return None
    if middle and e[4]:
        cost += 0.0 if middle[0] == e[4][0] else 1.5
    elif middle:
        cost += 0.4
    elif e[4]:
        cost += 0.05
    if off > 1 and len(key) < (6 if cut else 5):
        return None
    return cost + off


def choose_pivots(strings: DataFrame, per_root: float = CELLS) -> list[str]:
    """Pivots for cells of the single column: as many of its strings as `per_root` times the cube root of their number.

    They are taken in the order of a hash, so dense regions get more of them and cells stay of like
    size. Their number is the only thing that depends on the size of the data.
    """
    d = strings.toDF("s").where("s is not null").distinct()
    n = d.count()
    return [x["s"] for x in d.orderBy(F.xxhash64("s"), "s").limit(math.ceil(per_root * n ** (1 / 3))).collect()]


def cells_of(strings: DataFrame, pivots: list[str]) -> DataFrame:
    """(s, d, cell) for each distinct string of the single column: its distances to the pivots, and the nearest one's number."""
    known = F.array(*[F.lit(p) for p in pivots])
    d = strings.toDF("s").where("s is not null").distinct().withColumn("d", F.transform(known, lambda p: F.levenshtein(p, F.col("s"))))
    nearest = F.array_compact(F.transform("d", lambda x, k: F.when(x == F.array_min("d"), k)))
    # of pivots equally near one by hash, or the first ones would get all of them
    return d.withColumn("cell", F.get(nearest, F.pmod(F.xxhash64("s"), F.size(nearest)).cast("int")))


def radius_join(left: DataFrame, right: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(l, r): all pairs of a left and a right string (single columns) at a Levenshtein distance of at most radius.

    Exact: a left string l lies in the cell of its nearest pivot c. For a right string r in reach,
    d(r, c) <= d(r, l) + d(l, c) <= radius + d(l, p) <= 2 radius + d(r, p) for r's nearest pivot p,
    so r is copied to all cells whose pivot is at most 2 radius farther than p, and of these to
    those which hold strings at distances from their pivot within radius of r's. Inside a cell r is
    cut into radius + 1 segments, one of which l holds as it is, moved by no more than the edits on
    either side of it allow. Nulls match nothing.
    """
    pivots = choose_pivots(right)
    if not pivots:
        return left.sparkSession.createDataFrame([], "l string, r string")
    a = materialize(cells_of(left, pivots).withColumn("own", F.array_min("d")).select("s", "cell", "own"))
    # a row per pivot
    ranges = {x["cell"]: (x["lo"], x["hi"]) for x in a.groupBy("cell").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).collect()}
    lo, hi = (F.array(*[F.lit(ranges.get(k, (-9, -9))[j]) for k in range(len(pivots))]) for j in (0, 1))
    least = lambda d: F.array_min("d") + 2 * radius >= d
    reach = F.transform(F.arrays_zip(F.col("d").alias("d"), lo.alias("lo"), hi.alias("hi")), lambda x, k: F.when(least(x["d"]) & (x["hi"] >= 0) & (x["d"] >= x["lo"] - radius) & (x["d"] <= x["hi"] + radius), k))
    b = cells_of(right, pivots).select("s", F.explode(F.array_compact(reach)).alias("cell"))
    n, no = F.length("s"), F.sequence(F.lit(0), F.lit(radius))
    start = lambda size, i: F.floor(i * size / (radius + 1)).cast("int")
    key = lambda size, i, at, end: F.struct(size.cast("int").alias("size"), i.cast("int").alias("i"), F.substring(F.col("s"), at + 1, end - at).alias("part"))
    b = b.select(F.col("s").alias("r"), "cell", F.explode(F.transform(no, lambda i: key(n, i, start(n, i), start(n, i + 1)))).alias("k"))

    def places(size: Column, i: Column) -> Column:
        at, long = start(size, i), start(size, i + 1) - start(size, i)
        first = F.greatest(at - i, at + n - size - (radius - i), F.lit(0))
        last = F.least(at + i, at + n - size + (radius - i), n - long)
        return F.when((last >= first) & (size >= 0), F.transform(F.sequence(first, F.greatest(first, last)), lambda p: key(size, i, p, p + long))).otherwise(F.array())

    kept = F.flatten(F.flatten(F.transform(F.sequence(n - radius, n + radius), lambda size: F.transform(no, lambda i: places(size, i)))))
    a = a.select(F.col("s").alias("l"), "cell", F.explode(F.array_distinct(kept)).alias("k"))
    # both sides are far larger here than the tables they come from, by whose size a broadcast would be chosen
    met = a.hint("merge").join(b, ["cell", "k"]).where(F.levenshtein("l", "r", radius) >= 0)
    return met.select("l", "r").distinct()


READING = "kind string, key string, given string, cut boolean, middle string"
_READING = [("kind", pa.string()), ("key", pa.string()), ("given", pa.string()), ("cut", pa.bool_()), ("middle", pa.string())]


def _read(df: DataFrame, kept: list[str], name: str, how) -> DataFrame:
    """df's kept columns with a row for each reading of the name."""
    types = dict(df.dtypes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for k, n in enumerate(b.column(b.schema.get_field_index(name)).to_pylist()):
                for r in how(n):
                    rows.append(r)
                    at.append(k)
            own = b.select(kept).take(pa.array(at, pa.int64()))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(c, t) for c, (_, t) in zip(cols, _READING))], names=[*kept, *(n for n, _ in _READING)])

    return df.mapInArrow(each, ", ".join([*(f"{c} {types[c]}" for c in kept), READING]))


def link_names(spellings: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, entity_no, entity_name, cost, tied): the entity for each distinct spelling in the single column of `spellings`.

    cost is 0 for the registered name read alike, and grows with initials, short forms and slips; a
    spelling costing more than MAX_COST for every entity gives no row. One that fits several entities
    equally well gives a row for each, with tied true. Null, empty and placeholder names, and registry rows without a number or a
    name, are ignored; repeated rows count once. Empty tables give no rows. The registry may have any
    size: both sides are spread over the cells of the metric space.
    """
    names = spellings.toDF("name").where("name is not null").distinct()
    entities = distinct_names(registry, "entity_no", "entity_name").where("entity_no is not null and entity_name is not null").distinct()
    s = checkpoint(_read(names, ["name"], "name", readings))
    e = checkpoint(_read(entities, ["entity_no", "entity_name"], "entity_name", entity_readings))
    near = radius_join(s.select("key"), e.select("key"))
    e = e.toDF("entity_no", "entity_name", "e_kind", "r", "e_given", "e_cut", "e_middle")
    pairs = s.join(near, s.key == near.l).join(e, "r").where("kind = e_kind")

    def costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.to_pydict()
            got = [
                judge(x, y)
                for x, y in zip(zip(c["kind"], c["key"], c["given"], c["cut"], c["middle"]), zip(c["e_kind"], c["r"], c["e_given"], c["e_cut"], c["e_middle"]))
            ]
            out = pa.RecordBatch.from_arrays([*b.select(["name", "entity_no"]).columns, pa.array(got, pa.float64())], names=["name", "entity_no", "cost"])
            yield out.filter(out.column(2).is_valid())

    kind = dict(entities.dtypes)["entity_no"]
    judged = pairs.select("name", "entity_no", "kind", "key", "given", "cut", "middle", "e_kind", "r", "e_given", "e_cut", "e_middle").mapInArrow(costs, f"name string, entity_no {kind}, cost double")
    judged = materialize(judged.where(F.col("cost") <= MAX_COST).groupBy("name", "entity_no").agg(F.min("cost").alias("cost")))
    best = judged.groupBy("name").agg(F.min(F.struct("cost", "entity_no")).alias("first"), F.max(F.struct((-F.col("cost")).alias("gain"), F.col("entity_no"))).alias("last"))
    best = best.select("name", F.col("first.cost").alias("cost"), (F.col("first.entity_no") != F.col("last.entity_no")).alias("tied"))
    out = judged.join(sized(best, judged), ["name", "cost"]).join(entities, "entity_no").select("name", "entity_no", "entity_name", "cost", "tied")
    return sized(out, judged)


def variant_spellings(papers: DataFrame, registry: DataFrame) -> DataFrame:
    """(paper_id, author_pos, entity_no) for each element of papers.authors that is spelled unlike its entity's name.

    An element that fits several entities alike stands for none of them in particular and gives no
    row here; `link_names` has its entities.
    """
    p = distinct_names(papers, "paper_id", "authors").select("paper_id", F.posexplode("authors").alias("pos", "name")).where("name is not null")
    linked = link_names(p.select("name"), registry).where("not tied and name <> entity_name").select("name", "entity_no")
    return p.join(linked, "name").select("paper_id", (F.col("pos") + 1).alias("author_pos"), "entity_no").distinct()
