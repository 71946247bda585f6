import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from litmill.llm import encoding, leakage, scans, subjects
from litmill.session import tokenizer_dir

VOCABULARY = f"{tokenizer_dir()}/byte_bpe_50k.json"


# ---------- encoding


@pytest.fixture(scope="module")
def encoder():
    return encoding.Encoder(VOCABULARY)


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=("Cs",)), max_size=80), max_size=5))
def test_encoding_like_the_public_library(encoder, public, texts):
    assert encoder.encode(texts).to_pylist() == [x.ids for x in public.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["=" * 3000, " " * 3001, "漢字" * 700, "<|endoftext|> hi", "don't'LL 'll \n\n  x", "aaabaaab" * 200, "a\x00b"])
def test_encoding_of_long_runs(encoder, public, text):
    assert encoder.encode([text]).to_pylist() == [public.encode(text, add_special_tokens=False).ids]


@pytest.mark.parametrize("letters,n", [("abcdefghijklmnopqrstuvwxyzäöü", 6000), ("ACGT", 9000), ("a", 20_000), (" ", 20_000)])
def test_encoding_of_very_long_words(encoder, public, letters, n):
    rnd = random.Random(5)
    text = "".join(rnd.choice(letters) for _ in range(n))
    assert encoder.encode([text]).to_pylist() == [public.encode(text, add_special_tokens=False).ids]


def test_encoding_of_many_unbroken_texts_in_bounded_memory(encoder, public):
    rnd = random.Random(1)
    word = lambda n, letters: "".join(rnd.choice(letters) for _ in range(n))
    cjk = [chr(c) for c in range(0x4E00, 0x9F00)]
    texts = [" ".join(word(60, cjk) for _ in range(8)) for _ in range(1000)]
    texts += [" ".join(word(4000, "abcdefghijklmnopqrstuvwxyz") for _ in range(300)), word(1_000_000, "etaoinshrdlu")]
    assert encoder.encode(texts).to_pylist() == [x.ids for x in public.encode_batch(texts, add_special_tokens=False)]


def test_a_vocabulary_out_of_order_is_refused(tmp_path):
    import json

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    vocab = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    path = tmp_path / "v.json"
    path.write_text(json.dumps({"model": {"vocab": vocab | {"ab": 256, "abc": 257}, "merges": ["ab c", "a b"]}}))
    with pytest.raises(ValueError):
        encoding.load_vocabulary(str(path))


def test_encoding_operator(spark):
    df = spark.createDataFrame([(1, "hello world", 5, "k"), (2, "", 5, "k"), (3, None, 5, "k"), (1, "hello world", 5, "k"), (None, "x", 5, "k")], "doc_id bigint, text string, ids int, k string")
    got = sorted(((r.doc_id, r.ids) for r in encoding.encode_corpus(df).collect()), key=repr)
    assert got == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, []), (None, [87])]
    assert encoding.encode_corpus(df.limit(0)).count() == 0


# ---------- leaks


def brute_leaks(docs, items, least):
    out = {}
    for d, t in docs:
        ws = leakage.words(t or "")
        runs = {tuple(ws[k : k + least]) for k in range(len(ws) - least + 1)}
        for i, x in items:
            xs = leakage.words(x or "")
            if any(tuple(xs[k : k + least]) in runs for k in range(len(xs) - least + 1)):
                out.setdefault(d, set()).add(i)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=40), min_size=1, max_size=4), st.lists(st.text("ab ", min_size=1, max_size=60), min_size=1, max_size=4), st.integers(1, 5))
def test_automaton_like_brute_force(items, docs, least):
    a = leakage.Automaton([(k, leakage.words(x)) for k, x in enumerate(items)], least)
    want = brute_leaks(list(enumerate(docs)), list(enumerate(items)), least)
    for d, t in enumerate(docs):
        per, spans = leakage._covered(a, leakage.words(t))
        assert set(per) == want.get(d, set())
        assert all(y[0] > x[1] for x, y in zip(spans, spans[1:]))


ITEM = "Which of the claims by Nobody about code reviews would survive if many records from Dendford proved ambiguous"


def test_leaks(spark):
    docs = [(1, "Before. " + ITEM.upper().replace(" ", ", ") + " after"), (2, " ".join(ITEM.split()[:12])), (3, " ".join(ITEM.split()[:11])), (4, None), (5, ""), (6, "x " * 50_000 + ITEM)]
    d = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id bigint, text string, item_id int, k string")
    i = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, "too short"), (None, ITEM), (9, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.longest, r.matched) for r in leakage.find_leaks(d, i).collect()}
    n = len(ITEM.split())
    assert got == {(1, 7): (n, n), (2, 7): (12, 12), (6, 7): (n, n)}
    clean = {r.doc_id: (r.text, r.removed_words, r.dropped) for r in leakage.remove_leaks(d, i).collect()}
    assert clean[6][0].startswith("x x") and "claims" not in clean[6][0] and clean[6][1:] == (n, False)
    assert clean[2] == (None, 12, True)
    assert leakage.find_leaks(d, i.limit(0)).count() == 0 and leakage.find_leaks(d.limit(0), i).count() == 0


# ---------- subjects


def found(spark, texts, known=("biology", "physics", "law", "other")):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id bigint, text string, subject string, k int")
    areas = spark.createDataFrame([(s, "d") for s in known] + [(None, "d")], "subject string, description string")
    return sorted((r.doc_id, r.subject) for r in subjects.assign_subjects(df, areas).collect())


def test_subjects(spark):
    three = "Seed dispersal is slow. The larva eats pollen. Reef fishes differ. "
    texts = [three, "Seed dispersal is slow. Nothing else here. More words. And more.", three + "Photons and lasers. The quark spins. Cosmic rays rain. ", None, "", "Keywords: reef fishes, seed dispersal, root systems\n- larva\n- pollen", three * 2000]
    assert found(spark, texts) == [(0, "biology"), (2, "biology"), (2, "physics"), (6, "biology")]
    assert found(spark, texts, ("law",)) == []
    assert found(spark, []) == []


def test_subject_matching_takes_whole_words_and_the_longest():
    terms, _ = subjects._lexicon()
    names = lambda s: {terms[n][0] for n in subjects.match_terms(s)}
    assert names("An awarded forward, laser cooling!") == {"laser cooling"}
    assert names("A convolutional network and two black holes") == {"convolutional network", "black holes"}


def test_terms_are_of_one_subject_each():
    terms, _ = subjects._lexicon()
    assert len({t for t, *_ in terms}) == len(terms) and {s for _, s, _ in terms} == {"", *subjects.PHRASES}


def test_sentences_leave_out_what_is_not_running_text():
    t = "## Title here\nOne sentence\nover lines. Two!\n\n| a | b | c |\nTable 1: x\nKeywords: y\nReferences\n[1] Not. This."
    assert subjects.sentences(t) == ["One sentence over lines.", "Two!"]


def test_text_behind_a_reference_list_is_read():
    entries = "[1] Prekos, D. (1967). Partial tariffs. Annals, 18(9).\n  continued here\nKliedel, B. (2003). From cartel to cartel."
    body = "Seed dispersal is slow."
    assert subjects.sentences(f"{body}\n\nReferences\n{entries}\n\nThe appendix is about larvae. It goes on.") == [body, "The appendix is about larvae.", "It goes on."]
    assert subjects.sentences(f"References\n\n{entries}\n## Appendix\n{body}\nLiteratur\n{entries}") == [body]
    assert subjects.sentences(f"Literature\n\n{body}") == [body]


def test_general_vocabulary_tells_subjects_apart(spark):
    texts = [
        "The supreme court heard the attorney. Habeas corpus was refused. The jury left.", "Mitosis and meiosis differ. The cytoplasm of a eukaryote moves. Photosynthesis needs light.",
        "Das Strafrecht kennt die Klage. Die Rechtsprechung folgt. Die Verfassung gilt.", "La mecánica cuántica es extraña. Un campo magnético cambia. La termodinámica manda.",
    ]
    assert found(spark, texts) == [(0, "law"), (1, "biology"), (2, "law"), (3, "physics")]


def test_held_out_labels(spark):
    """Precision and recall against the hand labels of odd documents; thresholds were set by those of the even ones."""
    d, a, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "subject_areas", "subject_labels"))
    names = {r.subject for r in a.collect()}
    want, judged = set(), set()
    for r in lab.where("doc_id % 2 = 1").collect():
        judged.add(r.doc_id)
        if r.subject and (s := r.subject.lower().replace(" ", "_")) in names:
            want.add((r.doc_id, s))
    got = {(r.doc_id, r.subject) for r in subjects.assign_subjects(d, a).where("doc_id % 2 = 1").collect() if r.doc_id in judged}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got)


def test_subjects_agree_with_labels(spark, sf):
    d, a, lab = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "subject_areas", "subject_labels"))
    got = {(r.doc_id, r.subject) for r in subjects.assign_subjects(d, a).collect()}
    names = {r.subject for r in a.collect()}
    want = {(r.doc_id, s) for r in lab.where("subject is not null").collect() if (s := r.subject.lower().replace(" ", "_")) in names}
    assert len(want & got) >= 0.8 * len(want)


# ---------- scans

CLEAN = ["the estimates in this table are sensitive once moral hazard enter the analysis and the buyer drives trade tariffs"] * 40


def noisy(spark, text, ocr=1):
    rows = [(f"c{k}", t, 0, 1, "x") for k, t in enumerate(CLEAN)] + [("p", text, ocr, 1, "x")]
    return spark.createDataFrame(rows, "paper_id string, documents string, parse_ocr_pages int, line_no int, noise string")


PAGE = "the estimates in this ta-\nble are sensitivc once moral\nLETTERS IN MEASUREMENT SCIENCE\n- 97 -\n\nhazard enter the ana1ysis and\n12    DÄLKOS\nthe buyer drives trade tariffs"


def test_noise_and_repair(spark):
    df = noisy(spark, PAGE)
    got = sorted((r.line_no, r.noise) for r in scans.find_noise(df).collect())
    assert got == [(0, "hyphen"), (1, "misread"), (2, "header"), (3, "page_number"), (5, "misread"), (6, "header")]
    assert scans.repair_texts(df).collect()[0].documents == CLEAN[0]


def test_unscanned_and_empty_texts_have_no_noise(spark):
    assert scans.find_noise(noisy(spark, PAGE, 0)).count() == 0
    assert scans.find_noise(noisy(spark, None)).count() == 0
    assert scans.find_noise(noisy(spark, "")).count() == 0
    assert scans.find_noise(noisy(spark, PAGE, None)).count() == 6
    assert scans.find_noise(noisy(spark, PAGE).limit(0)).count() == 0


def test_long_scan(spark):
    assert scans.find_noise(noisy(spark, "\n".join(["the buyer drives trade tariffs"] * 20_000 + ["x" * 300_000]))).count() == 0


@pytest.mark.parametrize("line,ok", [("- 97 -", True), ("246", True), ("p. 63", True), ("xxvii", True), ("l43", True), ("[100]", True), ("\f12", True), ("9.99", False), ("1984.", False), ("see 3", False), ("", False), ("mild", False)])
def test_page_numbers(line, ok):
    assert scans.is_page_number(line) is ok


@pytest.mark.parametrize("line,ok", [("Annals 0f Incentive Design", True), ("LETTERS IN PROGRAM CONSTRUCTION, working draft", True), ("89    NÜDLA", True), ("Journal of Field Ecology    43", True), ("4. Main results", False), ("42   0.26   0.54", False), ("the rest of it", False), ("Bozburg.", False)])
def test_running_titles(line, ok):
    assert scans.is_running_title(line) is ok


def test_candidates(spark):
    counts = {"change": 500, "which": 900, "consequence": 300, "forms": 200, "mode": 100, "rnode": 90}
    reads = ["cbange", "wh!ch", "conseqiience", "forrns", "change", "rnode", "zebra"]
    words = spark.createDataFrame([(w, n, w in reads and 1 or 0) for w, n in counts.items()] + [(w, 0, 1) for w in reads if w not in counts], "w string, n bigint, asked int")
    got = {r.w: r.options for r in scans.corrections(words).collect()}
    assert got == {"cbange": ["change"], "wh!ch": ["which"], "conseqiience": ["consequence"], "forrns": ["forms"]}


def test_a_heading_is_no_running_header():
    text = "The last sentence ends here.\n\nData and Methods\n\nThe next one begins. It says that the\nJournal of Field Ecology\nwork goes on.\n\nRelated Work and Open Questions\nNothing is left to be said."
    assert scans.analyse(text, scans.Lexicon({}))[0] == [(5, "header")]


def test_context_keeps_a_word_that_is_right_as_it_is(spark):
    # "cat" is near "eat", far more frequent; beside its usual neighbours it stays, in the place of "eat" it is misread
    text = "\n".join(["people who eat fish"] * 400 + ["the black cat sleeps there"] * 8 + ["people who cat fish"])
    assert {(r.line_no, r.noise) for r in scans.find_noise(noisy(spark, text)).collect()} == {(408, "misread")}


def test_the_way_the_lexicon_travels_changes_nothing(spark, sf):
    p = spark.read.parquet(f"{sf}/papers.parquet")
    a, b = ({tuple(r) for r in scans.find_noise(p, shared_words=n).collect()} for n in (10**9, 0))
    assert a == b and len(a) > 100
    x, y = ({tuple(r) for r in scans.repair_texts(p, shared_words=n).collect()} for n in (10**9, 0))
    assert x == y


def test_noise_planted_in_clean_text_is_found(spark):
    rnd = random.Random(3)
    words = CLEAN[0].split()
    lines, want = [], set()
    for k in range(200):
        ws = words[:]
        if rnd.random() < 0.3:
            at = rnd.randrange(len(ws))
            if "e" in ws[at][1:] and len(ws[at]) > 4:
                ws[at] = ws[at][0] + ws[at][1:].replace("e", "c", 1)
                want.add((k, "misread"))
        lines.append(" ".join(ws))
    got = {(r.line_no, r.noise) for r in scans.find_noise(noisy(spark, "\n".join(lines))).collect()}
    assert got == want
