import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litmill.llm import matching, names

REGISTRY = [(1, "Thomas Prarnis"), (2, "Björn G. Prarviskin"), (3, "Rulkvik Laboratory of Public Health"), (4, "Ada Novak"), (5, "Adam Novak"), (6, "Ada Novak"), (None, "Nobody Here"), (7, None)]


def linked(spark, spellings, registry=REGISTRY[:5] + REGISTRY[6:]):
    s = spark.createDataFrame([(x,) for x in spellings], "n string")
    r = spark.createDataFrame([(*x, "k", 1) for x in registry], "entity_no bigint, entity_name string, key string, cost int")
    return {x.name: x.entity_no for x in names.link_names(s, r).where("not tied").collect()}


@pytest.mark.parametrize(
    "spelling,no",
    [("Thomas Prarnis", 1), ("PRARNIS, Thomas", 1), ("Prarnis T", 1), ("T.Prarnis", 1), ("Tom Prarnis*", 1), ("Prof. Thomas  Prarnis", 1), ("Prarnis Thomas", 1), ("Thom. Prarnis", 1), ("Thomas Prarins", 1), ("Tohmas Prarnis", 1), ("Bjoern Prarviskin", 2), ("bjorn prarviskin", 2), ("Prarviskin BG", 2),
     ("RULLPH", 3), ("Laboratory of Public Health, Rulkvik", 3), ("The Rulkvik Lab. Public Health", 3), ("Rulkvik Laboratory of Public Health (RULLPH)", 3)],
)
def test_readings(spelling, no):
    best = {}
    for k, n in REGISTRY[:3]:
        for e in names.entity_readings(n):
            for s in names.readings(spelling):
                c = names.judge(s, e)
                if c is not None:
                    best[k] = min(c, best.get(k, 9))
    assert min(best, key=best.get) == no and best[no] <= names.MAX_COST


def test_links(spark):
    got = linked(spark, ["Prarnis, Thomas", "Prarnis, Thomas", "A. Novak", "Ada Novak", "et al.", "Unknown", "", None, "Rulkvik Lab of Public Health", "x" * 10_000])
    assert got == {"Prarnis, Thomas": 1, "Ada Novak": 4, "Rulkvik Lab of Public Health": 3}  # A. Novak fits two
    r = spark.createDataFrame(REGISTRY[:5], "entity_no bigint, entity_name string")
    two = names.link_names(spark.createDataFrame([("A. Novak",), ("Ada Novak",)], "n string"), r).collect()
    assert {(x.name, x.entity_no, x.tied) for x in two} == {("A. Novak", 4, True), ("A. Novak", 5, True), ("Ada Novak", 4, False)}
    assert linked(spark, []) == {} and linked(spark, ["Ada Novak"], []) == {}


def test_variants_of_papers(spark):
    p = spark.createDataFrame([("p", ["Thomas Prarnis", "T. Prarnis", None], 1), ("q", None, 2), ("p", ["Thomas Prarnis", "T. Prarnis", None], 1)], "paper_id string, authors array<string>, name int")
    r = spark.createDataFrame(REGISTRY[:3], "entity_no bigint, entity_name string")
    assert [(x.paper_id, x.author_pos, x.entity_no) for x in names.variant_spellings(p, r).collect()] == [("p", 2, 1)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text("abc", max_size=9), max_size=40), st.lists(st.text("abc", max_size=9), max_size=40))
def test_radius_join_is_exact(spark, left, right):
    l, r = (spark.createDataFrame([(x,) for x in xs] + [(None,)], "x string") for xs in (left, right))
    got = sorted((x.l, x.r) for x in names.radius_join(l, r, 2).collect())
    assert got == sorted({(a, b) for a in left for b in right if levenshtein(a, b) <= 2})


def test_radius_join_of_names_like_brute_force(spark, sf):
    registry = [k for x in spark.read.parquet(f"{sf}/author_registry.parquet").collect() for _, k, *_ in names.entity_readings(x.entity_name)]
    rnd_keys = sorted({k[:i] + k[i + 1 :] + k[:1] for n, k in enumerate(registry) for i in (n % len(k), 1)})[:600]
    l, r = (spark.createDataFrame([(x,) for x in xs], "x string") for xs in (rnd_keys, registry[:300]))
    assert sorted((x.l, x.r) for x in names.radius_join(l, r).collect()) == sorted({(a, b) for a in rnd_keys for b in registry[:300] if abs(len(a) - len(b)) < 3 and levenshtein(a, b) <= 2})


def test_no_cell_holds_a_tenth_of_the_names(spark):
    d = "/root/testdata/sf0.1"
    registry = spark.createDataFrame([(k,) for x in spark.read.parquet(f"{d}/author_registry.parquet").collect() for _, k, *_ in names.entity_readings(x.entity_name)], "x string")
    spelled = spark.createDataFrame([(k,) for x in spark.read.parquet(f"{d}/papers.parquet").select(F.explode("authors").alias("n")).distinct().collect() for _, k, *_ in names.readings(x.n)], "x string")
    pivots = names.choose_pivots(registry)
    assert len(names.choose_pivots(registry.limit(100))) < len(pivots)
    for keys in (registry, spelled):
        sizes = [x["count"] for x in names.cells_of(keys, pivots).groupBy("cell").count().collect()]
        assert max(sizes) < 0.1 * sum(sizes)


@pytest.mark.parametrize("given,full", [("dan", "daniel"), ("danny", "daniel"), ("bob", "robert"), ("charlie", "charles"), ("alex", "alexander"), ("andy", "andrew")])
def test_short_forms(given, full):
    assert names.is_short(given, full) and not names.is_short(full, given)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8), st.integers(1, 4))
def test_slips_against_the_plain_recurrence(a, b, most):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i, j] = max(i, j) if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    assert names.slips(a, b, most) == min(d[len(a), len(b)], most + 1)


# ---------- matching

FIELDS = "title string, authors array<string>, published string, doi string"
TITLES = [f"{a} {t} and {u}: evidence from {p}" for a, t, u, p in [("Stable", "trade tariffs", "moral hazard", "Bozburg"), ("Partial", "reef fishes", "root systems", "Klapvik"), ("Hidden", "laser cooling", "cosmic rays", "Rubona"), ("Uneven", "tort damages", "plea agreements", "Tevia"), ("Joint", "word order", "loan words", "Sukia"), ("Local", "unit tests", "stack traces", "Zumia")]]
NAMES = ["Ada Novak", "Tomasz Drarolman", "Inés Zontic", "Ulla Nätwell", "Ravi Brovinov", "Dalia Lerna"]


def sources(spark):
    p, r = [], []
    for k in range(6):
        p.append((f"p{k}", f"c{k}", TITLES[k], [NAMES[k]], f"200{k}-01-01", f"10.1000/x.{k}"))
        p.append((f"q{k}", f"c{k}", TITLES[k].upper() + " (v2)", None, "Unknown", None))
        r.append((k, True, "{" + TITLES[k][0] + "}" + TITLES[k][1:].replace("and", "&amp;"), [NAMES[k].split()[1] + ", " + NAMES[k].split()[0]], f"200{k}", "unknown"))
    p += [("part", None, TITLES[0] + " Part II", [NAMES[0]], "2000", None), ("other", None, TITLES[1], [NAMES[5]], "1950", "10.1000/z"), ("null", None, None, None, None, None), ("empty", None, "", [], "", "")]
    r += [(90, False, None, None, None, None), (91, True, None, None, None, None), (92, True, "An entirely different work on nothing at all", ["Nobody Known"], "1999", None), (93, True, TITLES[0] + " part ii", [NAMES[0]], "2001", None)]
    pf = spark.createDataFrame([(*x, 1, "a") for x in p], f"paper_id string, canonical_id string, {FIELDS}, pid int, g string")
    rf = spark.createDataFrame([(*x, 1) for x in r], f"result_no bigint, found boolean, {FIELDS}, b int")
    return pf, rf


def test_matches(spark):
    p, r = sources(spark)
    got = {(x.paper_id, x.result_no) for x in matching.match_papers(p, r).collect()}
    assert got == {(f"{c}{k}", k) for c in "pq" for k in range(6)} | {("part", 93)}
    assert all(0.5 <= x.confidence <= 1 for x in matching.match_papers(p, r).collect())


def test_empty_sides_and_repeated_rows(spark):
    p, r = sources(spark)
    assert matching.match_papers(p.limit(0), r).count() == 0 and matching.match_papers(p, r.limit(0)).count() == 0
    twice = r.unionByName(r.withColumn("result_no", r.result_no + 100))
    assert matching.match_papers(p, twice).count() == 2 * matching.match_papers(p, r).count()


def test_a_hot_title_is_divided_and_nothing_lost(spark):
    """300 x 300 records of one title without authors, others of it with authors, beside 60 ordinary pairs: alike at any block size."""
    title, fields = "Call for papers on the structural rent of cities", f"result_no bigint, found boolean, {FIELDS}"
    names = ["Anna Berg", "Ben Karlsson", "Carla Nowak", "Dmitri Volkov", "Wei Wang"]
    p = [(f"h{k}", None, title, None, str(1600 + k), None) for k in range(300)] + [(f"n{k}", None, title, [names[k % 5]], str(1900 + k), None) for k in range(40)]
    r = [(k, True, title, None, str(1600 + k), None) for k in range(300)] + [(500 + k, True, title, [names[k % 5].replace("a", "e", 1)], str(1900 + k), None) for k in range(40)]
    for k in range(60):
        own = f"Why {NAMES[k % 6].split()[1]} number{k} measures prices{k} in town{k} again{k}"
        p.append((f"o{k}", None, own, [NAMES[k % 6]], "2001", None))
        r.append((900 + k, True, own.upper(), [NAMES[k % 6]], "2001", None))
    pf, rf = spark.createDataFrame(p, f"paper_id string, canonical_id string, {FIELDS}"), spark.createDataFrame(r, fields)
    got = [{(x.paper_id, x.result_no, x.confidence) for x in matching.match_records(pf, rf.drop("found"), "paper_id", "result_no", hot_block=n).collect()} for n in (10, 10_000)]
    assert got[0] == got[1]
    assert {(f"o{k}", 900 + k) for k in range(60)} | {(f"h{k}", k) for k in range(300)} <= {x[:2] for x in got[0]}


def test_every_pair_of_alike_names_shares_a_near_form():
    import random

    rnd = random.Random(3)
    some = ["Wang, Wei", "Anna-Lena Müller", "ÅSTRÖM, K.", "The Vikbergen Institute for Market Studies", "J. Köhler", "Bartholomew Fitzgerald", "VIKIMS", "Li, X"]
    for _ in range(400):
        x = rnd.choice(some)
        y = list(rnd.choice(some))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(y))
            y[k : k + rnd.randint(0, 2)] = rnd.choice(["", "e", "oe", "s"])
        c, d = matching.author_code(x), matching.author_code("".join(y))
        if c and d and matching.same_name(c, d) > 0:
            assert matching.near_forms(c) & matching.near_forms(d)


def test_records_linked_through_a_partner_share_their_posterior(spark):
    """Two groups surely match one answer; another answer, weak against the first group alone, follows the second."""
    no = lambda t, a, y: int(matching.np.ravel_multi_index((t + 1, a + 1, y + 1, 0), matching.SIZES))
    row = lambda g, b, t, a, y, n=1: (g, b, [(no(t, a, y), n)], True)
    rows = [row(1, 10, 20, 10, 4), row(2, 10, 20, 10, 4), row(1, 11, 15, 6, 0), row(2, 11, 20, 10, 4, 3)] + [row(100 + k, 200 + k, 20, 10, 4) for k in range(50)] + [row(300 + k, 400 + k, 8, 2, 0) for k in range(50)]
    pairs = spark.createDataFrame(rows, "g bigint, b bigint, cells array<struct<c:int,n:bigint>>, both boolean")
    judged, labels = matching._fitted(pairs)
    assert {(x.g, x.label) for x in labels.collect()} == {(2, 1)}
    p = {(x.g, x.b): x.p for x in judged.collect()}
    assert (2, 11) not in p and p[1, 11] > 0.5 and p[300, 400] < 0.5


def test_very_long_fields(spark):
    p, r = sources(spark)
    long = spark.createDataFrame([("long", "c9", "word " * 20_000, ["x" * 50_000], "9" * 50_000, "10.1/" + "y" * 50_000, 1, "a")], p.schema)
    assert matching.match_papers(p.unionByName(long), r).count() == 13


def test_records_with_half_a_title_and_a_name_in_common_make_no_pairs(spark):
    """Forty subtitles by one name on either side: alike in half a title only, so they are no candidates, and are sifted in the block."""
    import random

    rnd = random.Random(4)
    words = ["".join(rnd.choices("abcdefghijklmnopqrtuvwxyz", k=8)) for _ in range(40)]
    title = lambda k, n: f"{words[k % 40].title()} {words[k * 7 % 40]} {words[(k * 3 + n) % 40]} growth: beyond Rakstad"
    schema = f"id bigint, {FIELDS}"
    p, r = ([(k, title(k + n, n), ["Ines Skotov"], None, None) for k in range(40)] for n in (0, 11))
    r += [(100 + k, p[k][1].replace("growth", "grwoth").replace("Beyond", "Beyod").replace("a ", "ae ", 1), ["Ines Skotov"], None, None) for k in range(40)]
    sides = [matching.prepare(spark.createDataFrame(x, schema), "id", right=n == 1) for n, x in enumerate((p, r))]
    profiles = [{x.id: matching.Profile(*[x[c] for c in matching.COMPARED]) for x in s.collect()} for s in sides]
    kept = lambda rows: {x for x in rows if matching.vector(profiles[0][x[0]], profiles[1][x[1]]) != (-1,) * 4}
    pairs = lambda n: {(x.a, x.b) for x in matching.candidates(*sides, hot_block=n).collect()}
    sifted, every = pairs(matching.HOT_BLOCK), {(x, y) for x in profiles[0] for y in profiles[1]}
    assert kept(sifted) == kept(every) and len(kept(sifted)) >= 40
    assert len(sifted) < len(every) / 4


def test_the_sieve_refuses_only_what_the_vector_refuses():
    import random

    rnd = random.Random(5)
    words, names = ["search", "look", "pricing", "tax", "microbial", "of", "Seasonal", "Rakstad", "II", "étude"], ["Wang, Wei", "Ines Skotov", "Li, X", "Institute for Market Studies", "IMS", "J. Köhler", "Fitzgerald"]

    def damaged(x):
        k = rnd.randrange(len(x) - 1)
        return rnd.choice([x, x[:k] + x[k + 1 :], x[:k] + rnd.choice("aeé") + x[k + 1 :], x[:k] + x[k + 1] + x[k] + x[k + 2 :]])

    def some():
        title = " ".join(damaged(w) for w in rnd.choices(words, k=rnd.randint(1, 6)))
        return matching.profile(rnd.choice([title, None, f"{title}: {' '.join(rnd.choices(words, k=3))}", title * 30]), [damaged(x) for x in rnd.sample(names, rnd.randint(0, 3))], None, rnd.choice([None, None, "10.1000/a", "10.1000/b"]))

    x, y = [some() for _ in range(3000)], [some() for _ in range(3000)]
    signs = lambda ps: matching._signs(matching.pa.array([matching.sign(p).tobytes() for p in ps], matching.pa.binary()))
    passed = matching.sift(signs(x), signs(y))
    refused = [matching.vector(p, q) == (-1,) * 4 for p, q in zip(x, y)]
    assert not any(r is False and not ok for r, ok in zip(refused, passed.tolist()))
    assert 0 < sum(passed) < len(x)
