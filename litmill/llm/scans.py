"""Noise in text from scanned pages: find it line by line, and repair the text into paragraphs.

Words of the whole corpus are counted into a frequency lexicon. Its words are indexed by symmetric
deletes of their folded form, in which characters that scanners confuse are one, and the words of
scanned pages meet them there: a word that is near one far more frequent gets the candidates whose
weighted edit distance - confusion pairs cost little - is small. Index and search are joins over
distinct words, so no lexicon has to fit anywhere. Where several candidates remain, or the word as
read occurs elsewhere too, the counts of word pairs with the neighbours pick one. Page numbers and
running headers are told by their form and by where they stand, words cut at line ends by the counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from litmill.session import distinct_names, materialize, sized, spread

#: What is known of up to so many words goes to all tasks at once; of more, to each text what it needs.
SHARED_WORDS = 300_000
#: A cut word counts as known, with its hyphen or without, from so many occurrences.
LEAST_COUNT = 3
#: A pair of words that was seen so often may speak for a word as it was read.
LEAST_PAIRS = 3
#: A candidate has to be this many times as frequent as what was read.
RATIO = 20
CONFUSION, EDIT, MOST = 0.3, 1.0, 0.65

#: Pairs (read, meant) that scanners confuse.
CONFUSIONS = (
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("$", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"),
    ("c", "e"), ("f", "t"), ("b", "h"), ("ii", "u"), ("rn", "m"), ("vv", "w"), ("cl", "d"), ("li", "h"), ("l", "i"), ("n", "u"), ("o", "c"),
)

#: A running header stands on one printed line, and what is longer than a printed word is none.
LINE, WORD = 150, 60

HYPHENS = "-­¬‐‑"
_CORE = re.compile(r"[^\W_](?:[\w!|$\-]*[^\W_])?|[!|$1](?=[^\W\d_])[\w!|$\-]*[^\W_]", re.U)
_LETTERS = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_TOKEN = re.compile(r"\S+")
_ROMAN = r"(?=[ivxlc])(?:x{0,4}(?:ix|iv|v?i{0,4})|[xl]?x{0,4}(?:ix|iv|v?i{0,4})|c{0,3}[xl]?x{0,4}(?:ix|iv|v?i{0,4}))"
_NUMBER = rf"(?:[\dlIOoSB|]{{1,4}}|{_ROMAN}|{_ROMAN.upper().replace('(?:', '(?:')})"
_PAGE = re.compile(rf"[\s\f]*[-–—\[(|]{{0,2}}\s*(?:(?:p|pp|page|pg|seite|s|pag|página)\b\.?\s*)?({_NUMBER})\s*[-–—\])|]{{0,2}}\s*", re.I)
_NUMBERED = re.compile(r"^[\s\f]*(?:([\dlIO|]{1,4})\s{2,}(\S.*?)|(\S.*?)\s{2,}([\dlIO|]{1,4}))\s*$")
_TITLE_CHARS = re.compile(r"^[^\W_][\w ,.&'’\-:!|$]*$")
_SMALL_WORDS = {"of", "on", "in", "the", "and", "for", "to", "a", "an", "at", "by", "with", "from", "und", "der", "die", "für", "de", "la", "el", "y"}
_DIGIT_LETTERS = str.maketrans("01!|5$9", "olilssg")


def fold(word: str) -> str:
    """The word with confusable characters made one."""
    w = word.replace("ii", "u").replace("rn", "m").replace("vv", "w")
    return w.translate(_FOLD)


_FOLD = str.maketrans({"0": "c", "o": "c", "e": "c", "3": "c", "1": "l", "i": "l", "!": "l", "|": "l", "5": "s", "$": "s", "9": "g", "6": "h", "8": "h", "b": "h", "f": "t", "n": "u"})


def _deletes(w: str) -> list[str]:
    return [w, *(w[:k] + w[k + 1 :] for k in range(len(w)))]


@lru_cache(maxsize=100_000)
def weighted_distance(read: str, meant: str) -> float:
    """Edits from what was read to what was meant; a confusion pair costs CONFUSION, any other edit EDIT."""
    n, m = len(read), len(meant)
    row = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            best = 1e9
            if i:
                best = row[i - 1][j] + EDIT
            if j:
                best = min(best, row[i][j - 1] + EDIT)
            if i and j:
                best = min(best, row[i - 1][j - 1] + (0.0 if read[i - 1] == meant[j - 1] else EDIT))
            for a, b in CONFUSIONS:
                if i >= len(a) and j >= len(b) and read.startswith(a, i - len(a)) and meant.startswith(b, j - len(b)):
                    best = min(best, row[i - len(a)][j - len(b)] + CONFUSION)
            row[i][j] = best
    return row[n][m]


class Lexicon:
    """What is known of words (in small letters): their counts, and the candidates for which they may be misread."""

    def __init__(self, known: dict[str, tuple[int, list[str]]]):
        self.known = known

    def count(self, word: str) -> int:
        return self.known.get(word, (0, ()))[0]

    def joined(self, word: str) -> int:
        """The count of a form of a cut word, 0 if it is too rare to tell."""
        n = self.count(word)
        return n if n >= LEAST_COUNT else 0

    def candidates(self, word: str) -> list[str]:
        """Words, best first, for which `word` was misread; none if it looks well read."""
        return self.known.get(word, (0, []))[1]

    def note(self, *words: str) -> None:
        pass


class Asked(Lexicon):
    """Knows nothing and remembers what it was asked."""

    def __init__(self):
        super().__init__({})
        self.words: set[str] = set()
        self.cut: set[str] = set()

    def joined(self, word: str) -> int:
        self.cut.add(word)
        return 0

    def candidates(self, word: str) -> list[str]:
        self.words.add(word)
        return []

    def note(self, *words: str) -> None:
        self.words.update(words)


def could_be_misread(word: str) -> bool:
    letters = sum(c.isalpha() for c in word)
    return letters >= 2 and letters * 2 >= len(word) and len(word) <= WORD and (len(word) > 2 or not _LETTERS.fullmatch(word))


def is_page_number(line: str) -> bool:
    m = _PAGE.fullmatch(line)
    if not m or not m[1]:
        return False
    n = m[1]
    return any(c.isdigit() for c in n) or n.lower().strip("ivxlc") == ""


def is_running_title(line: str) -> bool:
    """A line in the form of a running header: a title in capitals or capitalised words, perhaps with its page number.

    Headings of sections may have that form too; `_undo_headings` tells them apart.
    """
    t = line.strip(" \t\f\r")
    if len(t) > LINE:
        return False
    m = _NUMBERED.match(t)
    if m:
        text = m[2] or m[3]
        return bool(re.search(r"[^\W\d_]{2}", text)) and not re.search(r"\d[.,]\d|\d{3}|\s{2,}\d", text) and text[-1] not in ".;:?!"
    head = re.sub(r",\s+[^\W\d_]+(?: [^\W\d_]+){0,2}$", "", t)
    if not _TITLE_CHARS.match(head) or head[-1] in ".,;:?!":
        return False
    big = [w for w in re.findall(r"[^\W_]+", head) if w.lower().translate(_DIGIT_LETTERS) not in _SMALL_WORDS]
    if not any(len(w) > 3 for w in big) or re.search(r"\d\d|\b\d\b", head):
        return False
    if head.isupper():
        return len(head) > 4
    return len(big) >= 2 and all(w[0].isupper() or w[0] in "015" for w in big)


#: Kinds of noise, in the order in which a line is tested.
KINDS = ("page_number", "header", "hyphen", "misread")


def analyse(text: str, lexicon: Lexicon) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, list[str]]], list[str | None]]:
    """(noise, misread words, kinds) of a text.

    noise: (line_no, kind), each once. misread words: (line_no, place of the word among the line's
    words, what was read, candidates). kinds: per line `page_number`, `header`, or None for text.
    """
    lines = text.split("\n")
    kinds: list[str | None] = ["page_number" if is_page_number(x) else "header" if x.strip() and is_running_title(x) else None for x in lines]
    _undo_text_lines(lines, kinds)
    _undo_headings(lines, kinds)
    noise = [(k, kind) for k, kind in enumerate(kinds) if kind]
    running = [k for k, kind in enumerate(kinds) if not kind and lines[k].strip()]
    words: list[tuple[int, int, str]] = []
    misread: list[tuple[int, int, str, list[str]]] = []
    carried: tuple[int, int, str] | None = None
    for at, k in enumerate(running):
        tokens = _TOKEN.findall(lines[k])
        for no, raw in enumerate(tokens):
            first = carried if no == 0 else None
            if no == len(tokens) - 1 and raw[-1] in HYPHENS and len(raw) > 1 and raw[-2].isalnum() and at + 1 < len(running):
                nxt = _TOKEN.findall(lines[running[at + 1]])[0]
                if nxt[0].islower() or nxt[0] in "!01|5$9":
                    carried = (k, no, (first[2] if first else "") + raw)
                    if not _own_hyphen(carried[2], nxt, lexicon):
                        noise.append((k, "hyphen"))
                    continue
            carried = None
            if first:
                _join(first, (k, no, raw), lexicon, misread)
            else:
                words.append((k, no, raw))
    for k, no, raw in words:
        m = _CORE.search(raw)
        if m and (got := lexicon.candidates(m[0].lower())):
            misread.append((k, no, m[0], got))
    noise += [(k, "misread") for k in sorted({k for k, *_ in misread})]
    return noise, misread, kinds


def _undo_text_lines(lines: list[str], kinds: list[str | None]) -> None:
    """A number of four digits that may be a year is text where it stands inside a paragraph at full length."""
    for k, kind in enumerate(kinds):
        if kind == "page_number" and re.fullmatch(r"\s*(?:1[5-9]|20)\d\d\s*", lines[k]):
            before = lines[k - 1] if k else ""
            after = lines[k + 1] if k + 1 < len(lines) else ""
            if before.strip() and after.strip() and before.rstrip()[-1] not in ".!?":
                kinds[k] = None


def _undo_headings(lines: list[str], kinds: list[str | None]) -> None:
    """A line in the form of a header is one only if it has a page number or stands beside one, recurs in the text, or stands inside a sentence."""
    bare = {k: fold(re.sub(r"[\W\d_]+", "", lines[k].lower())) for k, kind in enumerate(kinds) if kind == "header"}
    often = Counter(bare.values())
    full = [k for k, x in enumerate(lines) if x.strip()]
    place = {k: n for n, k in enumerate(full)}
    ends, last = {}, ""
    for k in full:  # the last line of text before each line
        ends[k] = last
        if not kinds[k]:
            last = lines[k].rstrip()
    for k, x in bare.items():
        n = place[k]
        beside = any(kinds[full[j]] == "page_number" for j in (n - 1, n + 1) if 0 <= j < len(full))
        inside = ends[k] and ends[k][-1] not in ".!?:" and any(not kinds[j] for j in full[n + 1 :])
        if not (beside or inside or often[x] > 1 or _NUMBERED.match(lines[k].strip(" \t\f\r"))):
            kinds[k] = None


def _own_hyphen(left: str, right: str, lexicon: Lexicon) -> bool:
    """Whether a word cut behind a hyphen has that hyphen of its own."""
    if left[-1] != "-":
        return False
    a, b = _CORE.findall(left[:-1].lower()), _CORE.findall(right.lower())
    if not a or not b:
        return True
    a, b = a[-1], b[0]
    whole, joined = lexicon.joined(f"{a}-{b}"), lexicon.joined(a + b)
    if whole or joined:
        return whole > joined
    fixed = lexicon.candidates(f"{a}-{b}")
    return bool(fixed) and "-" in fixed[0] and not lexicon.candidates(a + b)


def _join(first: tuple[int, int, str], second: tuple[int, int, str], lexicon: Lexicon, misread: list) -> None:
    """Judges a word cut at a line end as a whole; what is misread belongs to the line it stands on."""
    k, no, left = first
    own = _own_hyphen(left, second[2], lexicon)
    forms = [_CORE.search(x + second[2]) for x in (left[:-1], left)]
    lexicon.note(*(f[0].lower() for f in forms if f))
    m = forms[own]
    if not m:
        return
    got = lexicon.candidates(m[0].lower())
    if not got:
        return
    read, meant, cut = m[0].lower(), got[0], len(left) - (not own) - m.start()
    same = next((i for i, (x, y) in enumerate(zip(read, meant)) if x != y), min(len(read), len(meant)))
    misread.append((k, no, m[0], got) if same < cut else (*second[:2], m[0], got))


def _prepared(papers: DataFrame, key: str, text: str, ocr: str) -> DataFrame:
    """(k, t, scanned) of the texts that are not empty."""
    d = distinct_names(papers, key, text, ocr).where(F.length(text) > 0)
    return d.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.coalesce(F.col(ocr), F.lit(1)) != 0).alias("scanned"))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(w, n, asked): all words of the texts (k, t, scanned) with their counts, and whether scanned texts ask about them: 1 as words, 2 as forms of cut words, 3 as both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            ws = list(c.keys() | asked.words | asked.cut)
            return pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), pa.array([c[w] for w in ws], pa.int64()), pa.array([(w in asked.words) + 2 * (w in asked.cut) for w in ws], pa.int32())], names=["w", "n", "asked"])

        c, asked = Counter(), Asked()
        for b in batches:
            for t, scanned in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c.update(_LETTERS.findall(t.lower()))
                if scanned:
                    analyse(t, asked)
            if len(c) + len(asked.words) + len(asked.cut) > 500_000:
                yield out()
                c, asked = Counter(), Asked()
        yield out()

    return texts.select("t", "scanned").mapInArrow(count, "w string, n bigint, asked int").groupBy("w").agg(F.sum("n").alias("n"), F.bit_or("asked").alias("asked"))


def corrections(words: DataFrame) -> DataFrame:
    """(w, n, options) of the words asked about that are known or may be misread: their counts, and the candidates, best first.

    words: (w, n, asked). Words and lexicon meet in the symmetric deletes of their folded forms.
    """

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if could_be_misread(w) for d in dict.fromkeys(_deletes(fold(w)))]
            cols = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["d", "w", "n"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dist = [weighted_distance(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(dist, pa.float64())], names=["w", "meant", "m", "dist"])

    at = lambda df: df.select("w", "n").mapInArrow(deleted, "d string, w string, n bigint")
    read, index = at(words.where("asked > 0")), at(words.where(F.col("n") >= RATIO)).toDF("d", "meant", "m")
    met = read.join(index, "d").where((F.col("w") != F.col("meant")) & (F.col("m") >= RATIO * F.greatest("n", F.lit(1))) & (F.abs(F.length("w") - F.length("meant")) <= 2))
    judged = met.select("w", "meant", "m").distinct().mapInArrow(near, "w string, meant string, m bigint, dist double").where(F.col("dist") <= MOST)
    best = judged.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("dist", (-F.col("m")).alias("m"), "meant"))).alias("o"))
    best = best.select("w", F.transform(F.filter("o", lambda x: x["dist"] <= F.col("o")[0]["dist"] + 0.05), lambda x: x["meant"]).alias("options"))
    return words.where("asked > 0").join(best, "w", "left").where((F.col("asked") > 1) & (F.col("n") >= LEAST_COUNT) | F.col("options").isNotNull()).select("w", "n", "options")


KNOWN = "array<struct<w:string,n:bigint,options:array<string>>>"


class _Texts:
    """The scanned texts with what is known of the words that they ask about."""

    def __init__(self, papers: DataFrame, key: str, text: str, ocr: str, shared_words: int):
        self.all = spread(_prepared(papers, key, text, ocr))
        self.scanned = self.all.where("scanned").select("k", "t")
        self.key = dict(papers.dtypes)[key]
        self.known = materialize(corrections(materialize(vocabulary(self.all))))
        self.shared = None
        if self.known.count() <= shared_words:
            # at most shared_words rows
            self.shared = papers.sparkSession.sparkContext.broadcast({r["w"]: (r["n"], r["options"] or []) for r in self.known.collect()})

    def each(self, one, schema: str, df: DataFrame | None = None, extra: str | None = None) -> DataFrame:
        """Rows one(lexicon, k, t[, extra]) of each scanned text, of the columns of schema."""
        df = self.scanned if df is None else df
        names = ["k", "t", *([extra] if extra else [])]
        arrow = to_arrow_schema(_parse_datatype_string(schema))
        shared = self.shared
        if shared is None:
            df = df.withColumn("h", F.xxhash64("t"))

            def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    rows = []
                    for h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                        asked = Asked()
                        analyse(t, asked)
                        rows += [(h, w) for w in asked.words | asked.cut]
                    cols = list(zip(*rows)) or [[], []]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["h", "w"])

            asked = self.scanned.select(F.xxhash64("t").alias("h"), "t").mapInArrow(ask, "h bigint, w string").distinct()
            told = asked.join(sized(self.known), "w").groupBy("h").agg(F.collect_list(F.struct("w", "n", "options")).alias("known"))
            df = df.join(told, "h", "left").select(*names, F.coalesce("known", F.array().cast(KNOWN)).alias("known"))
        else:
            df = df.select(*names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = None
            for b in batches:
                cols = [c.to_pylist() for c in b.columns]
                rows = []
                for x in zip(*cols):
                    if shared is None:
                        *x, known = x
                        lexicon = Lexicon({o["w"]: (o["n"], o["options"] or []) for o in known})
                    else:
                        lexicon = lexicon or Lexicon(shared.value)
                    rows += one(lexicon, *x)
                got = list(zip(*rows)) or [[]] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(got, arrow)], schema=arrow)

        return df.mapInArrow(run, schema)

    def findings(self) -> DataFrame:
        """(k, line, noise, no, g, stays, pair): all noise; no is the place of a misread word in its line.

        A misread word in doubt has a row for each reading g of it and each pair that this makes with
        a neighbour; stays marks the reading that leaves it as it is.
        """

        def find(lexicon: Lexicon, k, t: str):
            noise, misread, _ = analyse(t, lexicon)
            yield from ((k, n, x, -1, None, False, None) for n, x in noise if x != "misread")
            lines = t.split("\n")
            for line, no, read, got in misread:
                own = lexicon.count(read.lower()) > 1
                if not own and len(got) == 1:
                    yield (k, line, "misread", no, None, False, None)
                    continue
                ws = [_plain(w) for w in _TOKEN.findall(lines[line])]
                for g in [*([read.lower()] if own else []), *got]:
                    for pair in _pairs(ws, no, g):
                        yield (k, line, "misread", no, g, g == read.lower(), pair)

        return materialize(self.each(find, f"k {self.key}, line int, noise string, no int, g string, stays boolean, pair string"))

    def chosen(self, findings: DataFrame) -> DataFrame:
        """(k, line, no, g, stays) of the misread words in doubt: what is meant by what stands beside it in the whole corpus.

        In doubt is a word with several candidates, and one that also occurs as it was read. The last
        stays as it is if its pairs with the neighbours are seen LEAST_PAIRS times or more beyond
        these themselves, and not less often than those of any candidate.
        """

        def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c: Counter = Counter()
                for t in b.column(0).to_pylist():
                    for line in t.split("\n"):
                        ws = [_plain(w) for w in _TOKEN.findall(line)]
                        c.update(f"{x} {y}" for x, y in zip(ws, ws[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["pair", "n"])

        asked = findings.where("g is not null")
        seen = self.all.select("t").mapInArrow(pairs, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        # each distinct pair is looked up once
        found = seen.join(asked.select("pair").distinct(), "pair", "left_semi")
        # an option's pairs: for what was read, its own occurrence does not count
        score = F.sum(F.coalesce("n", F.lit(0)) - F.when(F.col("stays"), 1).otherwise(0))
        told = asked.join(found, "pair", "left").groupBy("k", "line", "no", "g", "stays").agg(score.alias("n"))
        told = told.where(~F.col("stays") | (F.col("n") >= LEAST_PAIRS))
        return told.groupBy("k", "line", "no").agg(F.max_by(F.struct("g", "stays"), F.struct("n", "stays", "g")).alias("x")).select("k", "line", "no", "x.g", "x.stays")


def find_noise(papers: DataFrame, key: str = "paper_id", text: str = "documents", ocr: str = "parse_ocr_pages", shared_words: int = SHARED_WORDS) -> DataFrame:
    """(key, line_no, noise): each kind of noise on each line of the texts from scanned pages; rows are distinct.

    Lines are separated by line feeds and counted from 0. A text is taken to come from scanned pages
    unless `ocr` is 0; null counts as possibly scanned. The lexicon is that of all texts. Null and
    empty texts give no row; a repeated row gives its output once; columns of other names are ignored.
    Texts of any length are read whole. shared_words bears on the way the lexicon travels alone.
    """
    texts = _Texts(papers, key, text, ocr, shared_words)

    findings = texts.findings()
    stays = texts.chosen(findings).where("stays").select("k", "line", F.lit("misread").alias("noise"), "no")
    kept = findings.join(stays, ["k", "line", "noise", "no"], "left_anti")
    return kept.select(F.col("k").alias(key), F.col("line").alias("line_no"), "noise").distinct()


def repair_texts(papers: DataFrame, key: str = "paper_id", text: str = "documents", ocr: str = "parse_ocr_pages", shared_words: int = SHARED_WORDS) -> DataFrame:
    """(key, text): the texts from scanned pages as continuous paragraphs, without the noise.

    Headers and page numbers go, words cut at line ends are joined, misread words are put right, and
    the lines of a paragraph become one. A blank line ends a paragraph unless a page break stands
    there and the sentence goes on behind it. Which texts are repaired is as in `find_noise`; `key`
    has to be unique and not null. Where a misread word has several candidates, the one seen most
    often next to its neighbours in the whole corpus is taken, then the most frequent.
    """
    texts = _Texts(papers, key, text, ocr, shared_words)
    # of one text, so bounded by its length
    picks = texts.chosen(texts.findings()).groupBy("k").agg(F.collect_list(F.struct("line", "no", "g")).alias("picks"))
    withal = texts.scanned.join(picks, "k", "left")

    def repair(lexicon: Lexicon, k, t: str, picks):
        yield (k, _repaired(t, lexicon, {(p["line"], p["no"]): p["g"] for p in picks or ()}))

    return texts.each(repair, f"k {texts.key}, t string", withal, "picks").toDF(key, text)


def _plain(token: str) -> str:
    m = _CORE.search(token)
    return m[0].lower() if m else token


def _pairs(ws: list[str], no: int, word: str) -> list[str]:
    return [*([f"{ws[no - 1]} {word}"] if no else []), *([f"{word} {ws[no + 1]}"] if no + 1 < len(ws) else [])] or [word]


def _cased(read: str, meant: str) -> str:
    return meant.upper() if read.isupper() and len(read) > 1 else meant[:1].upper() + meant[1:] if read[:1].isupper() else meant


def _repaired(text: str, lexicon: Lexicon, picks: dict[tuple[int, int], str]) -> str:
    noise, misread, kinds = analyse(text, lexicon)
    lines = text.split("\n")
    cut = {k for k, kind in noise if kind == "hyphen"}
    fix = {(k, no): (read, picks.get((k, no), got[0])) for k, no, read, got in misread}
    paragraphs, open_, carry, broken = [], [], "", False
    for k, line in enumerate(lines):
        if kinds[k]:
            broken = True
            continue
        if not line.strip():
            if open_ and not carry and not (broken or _break_ahead(kinds, lines, k)):
                paragraphs.append(" ".join(open_))
                open_ = []
            continue
        tokens = _TOKEN.findall(line)
        if open_ and broken and not carry and open_[-1][-1:] in ".!?" and _blank_between(lines, kinds, k):
            paragraphs.append(" ".join(open_))
            open_ = []
        broken = False
        for no, raw in enumerate(tokens):
            if (k, no) in fix and not carry:
                read, meant = fix[k, no]
                raw = raw.replace(read, _cased(read, meant), 1) if read in raw else raw
            if no == 0 and carry:
                raw, carry = carry + raw, ""
                read, meant = fix.get((k, 0)) or next((v for (kk, _), v in fix.items() if kk < k and v[0] in raw), ("", ""))
                raw = raw.replace(read, _cased(read, meant), 1) if read and read in raw else raw
            if no == len(tokens) - 1 and k in cut:
                carry = raw[:-1]
            elif no == len(tokens) - 1 and raw[-1] == "-" and k + 1 < len(lines):
                carry = raw
            else:
                open_.append(raw)
    if carry:
        open_.append(carry)
    return "\n\n".join([*paragraphs, " ".join(open_)]).strip()


def _break_ahead(kinds: list[str | None], lines: list[str], k: int) -> bool:
    while k < len(lines) and not lines[k].strip():
        k += 1
    return k < len(lines) and kinds[k] is not None


def _blank_between(lines: list[str], kinds: list[str | None], k: int) -> bool:
    k -= 1
    while k >= 0 and (kinds[k] or not lines[k].strip()):
        if not kinds[k]:
            return True
        k -= 1
    return False
