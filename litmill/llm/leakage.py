"""Evaluation texts leaking into training text.

The normalised test items form one generalised suffix automaton over words: every run of words of
any item is a path in it. Training text is streamed through it word by word, keeping the longest
run of the item words that ends at the current word; where that run is long enough, all items that
hold it are reported, and its place in the text can be removed.

Items come in blocks of a bounded number of words, each with an automaton of its own, so what is
broadcast has a fixed size; the text is scanned once per block.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.session import distinct_names, union_all

#: Words of test items per automaton; an automaton of that many words takes some 300 MB.
BLOCK_WORDS = 500_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits of the composed text, each in folded case."""
    return [w.casefold() for w in _WORD.findall(unicodedata.normalize("NFC", text))]


class Automaton:
    """Generalised suffix automaton of word sequences, with the items of every run of `least` words or more."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.least = least
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.items = self._owners(items)

    def _extend(self, last: int, w: str) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state({}, -1, length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _state(self, nxt: dict, link: int, length: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, w: str, q: int) -> int:
        c = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def _owners(self, items: list[tuple[int, list[str]]]) -> list[frozenset[int] | None]:
        """For a state of runs of at least `least` words: the items of its shortest such run."""
        own: dict[int, set[int]] = {}
        for no, ws in items:
            s = 0
            for w in ws:
                s = t = self.next[s][w]
                while t > 0 and self.length[t] >= self.least and no not in own.setdefault(t, set()):
                    own[t].add(no)
                    t = self.link[t]
        out: list[frozenset[int] | None] = [None] * len(self.link)
        for s in sorted(own, key=self.length.__getitem__):
            up = self.link[s]
            # runs of one state share their ends; a shorter run may be long enough in a linked state too
            out[s] = out[up] if self.length[up] >= self.least and out[up] is not None else frozenset(own[s])
        return out

    def scan(self, ws: list[str]) -> Iterator[tuple[int, int, frozenset[int]]]:
        """(place of the last word, words matched, items) at each word that ends a run of `least` or more."""
        nxt, link, length, least, items = self.next, self.link, self.length, self.least, self.items
        s = n = 0
        for k, w in enumerate(ws):
            t = nxt[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = nxt[s].get(w)
            if t is None:
                continue
            s, n = t, n + 1
            if n >= least:
                yield k, n, items[s]


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for r in items.where(F.col(text).isNotNull()).select(key, text).distinct().toLocalIterator():
        ws = words(r[text])
        if r[key] is None or not ws:
            continue
        if block and size + len(ws) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r[key], ws))
        size += len(ws)
    if block:
        yield block


def _covered(automaton: Automaton, ws: list[str]) -> tuple[dict[int, list[int]], list[tuple[int, int]]]:
    """Per item [longest stretch, matched words, last place]; and the stretches (first, last word) of any item."""
    least = automaton.least
    per: dict[int, list[int]] = {}
    run: dict[int, int] = {}
    spans: list[tuple[int, int]] = []
    for end, _, found in automaton.scan(ws):
        first = end - least + 1
        if spans and first <= spans[-1][1] + 1:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((first, end))
        for no in found:
            at = per.setdefault(no, [0, 0, -least])
            run[no] = run[no] + 1 if no in run and at[2] == end - 1 else least
            at[0] = max(at[0], run[no])
            at[1] += min(end - at[2], least)
            at[2] = end
    return per, spans


def _per_block(docs: DataFrame, items: DataFrame, item_key: str, item_text: str, least: int, schema: str, one) -> DataFrame:
    """one(automaton, key, text) gives the output rows of a document; the results of all blocks of items."""
    names = [c.split()[0] for c in schema.split(",")]
    out = []
    for block in _blocks(distinct_names(items, item_key, item_text), item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value, least)
            for b in batches:
                rows = [r for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in one(automaton, k, t)]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=_arrow(schema))

        out.append(docs.mapInArrow(scan, schema))
    return union_all(out) if out else docs.sparkSession.createDataFrame([], schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(",")])


def find_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 12
) -> DataFrame:
    """(key, item_id, longest, matched, n_words): the items of which a document holds `least` consecutive words.

    longest is the longest stretch of the document covered by overlapping runs of the item, matched
    the number of its words in such runs, n_words all its words. Words are compared without regard
    to case, punctuation and spacing. Null and empty texts and items shorter than `least` words give
    no row; repeated documents and items are reported each by their own ids, and repeated rows of one
    document repeat. Null item ids are ignored; item ids are whole numbers. Columns of other names
    are ignored. There is no shuffle: a document is scanned where it is read, and whole.
    """
    d = distinct_names(docs, key, text)
    kind = dict(d.dtypes)[key]
    d = d.where(F.length(text) > 0).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))

    def one(automaton: Automaton, k: str, t: str):
        ws = words(t)
        return [(k, no, longest, matched, len(ws)) for no, (longest, matched, _) in _covered(automaton, ws)[0].items()]

    found = _per_block(d, items, item_key, item_text, least, "k string,item_id bigint,longest int,matched int,n_words int", one)
    return found.select(F.col("k").cast(kind).alias(key), "item_id", "longest", "matched", "n_words")


def remove_leaks(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = 12, max_coverage: float = 0.5
) -> DataFrame:
    """(key, text, removed_words, dropped) of each document that leaks: its text without the leaked stretches.

    A stretch is removed from its first to its last word. Where more than `max_coverage` of all
    words would go, dropped is true and text null. Documents that leak nothing give no row. `key`
    has to be unique and not null. Items beyond one block are removed block after block.
    """
    d = distinct_names(docs, key, text)
    kind = dict(d.dtypes)[key]
    d = d.where(F.length(text) > 0).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))

    def one(automaton: Automaton, k: str, t: str):
        places = [(m.start(), m.end(), m.group().casefold()) for m in _WORD.finditer(unicodedata.normalize("NFC", t))]
        _, spans = _covered(automaton, [w for *_, w in places])
        return [(k, places[a][0], places[b][1], b - a + 1, len(places)) for a, b in spans]

    cuts = _per_block(d, items, item_key, item_text, least, "k string,first bigint,last bigint,n int,n_words int", one)
    per = cuts.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cuts"), F.sum("n").alias("removed"), F.max("n_words").alias("n_words"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, cuts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                t, at, parts = unicodedata.normalize("NFC", t), 0, []
                for c in cuts:
                    parts.append(t[at : max(at, c["first"])])
                    at = max(at, c["last"])
                out.append("".join([*parts, t[at:]]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), b.column(3), b.column(4)], names=["k", "t", "removed", "n_words"])

    cleaned = d.join(per, "k").select("k", "t", "cuts", "removed", "n_words").mapInArrow(clean, "k string, t string, removed bigint, n_words int")
    dropped = F.col("removed") > F.col("n_words") * F.lit(max_coverage)
    return cleaned.select(F.col("k").cast(kind).alias(key), F.when(~dropped, F.col("t")).alias(text), F.col("removed").alias("removed_words"), dropped.alias("dropped"))
