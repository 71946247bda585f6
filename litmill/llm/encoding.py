"""Encoding of a corpus with a public byte-level BPE tokenizer.

Each partition cuts its texts into pre-tokens, these where no token of the vocabulary holds both
neighbouring bytes, and encodes the distinct parts it has not met yet in one recursive DuckDB query:
token-position rows join the merge table, every round contracts the leftmost pair of lowest rank of
each part, and the recursion ends when no part has a pair left. With that pair a round contracts
all others that nothing can forestall: pairs of lower rank than both neighbours, and of lower rank
than any merge that could take part in what this round makes. An aggregation ordered by position
gives the ids of each part; a text's ids are those of its parts in a row. There is no shuffle.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litmill.session import distinct_names, tokenizer_dir

#: Fixed value: the published pre-token pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Parts known to one task, and their bytes; beyond either the task forgets them, so memory stays bounded.
CACHE_WORDS, CACHE_BYTES = 400_000, 20_000_000
#: Bytes of new parts per DuckDB query; a longer part has a query of its own.
QUERY_BYTES = 250_000
#: DuckDB's memory: a floor, and what each byte of the longest part adds to it.
MEMORY_MB, MEMORY_PER_BYTE = 400, 1500

#: One row per token: the recursion keeps the newest state of each place only. A place whose token
#: went into the one before it gets tok -1 once; a part without a pair left does not come back.
ENCODE = """
WITH RECURSIVE state(w, pos, tok) USING KEY (w, pos) AS (
    SELECT w, pos, tok FROM fresh
  UNION ALL
    SELECT w, pos, CASE WHEN eaten THEN -1 WHEN here THEN joined ELSE tok END
    FROM (
        SELECT *, coalesce(lag(here) OVER (PARTITION BY w ORDER BY pos), false) AS eaten
        FROM (
            SELECT w, pos, tok, joined, coalesce(
                rank < bound AND (row_number() OVER run) % 2 = 1
                AND max(rank >= before_ AND fresh_run) OVER whole IS NOT TRUE
                AND max(rank >= after_ AND last_of_run) OVER whole IS NOT TRUE, false) AS here
            FROM (
                SELECT *, sum(fresh_run::INT) OVER (PARTITION BY w ORDER BY pos) AS run_no
                FROM (
                    SELECT *, rank IS DISTINCT FROM before_ AS fresh_run, rank IS DISTINCT FROM after_ AS last_of_run
                    FROM (
                        SELECT *, lag(rank) OVER (PARTITION BY w ORDER BY pos) AS before_, lead(rank) OVER (PARTITION BY w ORDER BY pos) AS after_
                        FROM (
                            SELECT p.w, p.pos, p.tok, g.rank, g.joined, min(g.next_rank) OVER (PARTITION BY p.w) AS bound
                            FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS follower FROM state WHERE tok >= 0) p
                            LEFT JOIN merges g ON g.a = p.tok AND g.b = p.follower
                        )
                        WHERE bound IS NOT NULL
                    )
                )
            )
            WINDOW run AS (PARTITION BY w, run_no ORDER BY pos), whole AS (PARTITION BY w, run_no)
        )
    )
)
SELECT w, list(tok ORDER BY pos) AS ids FROM state WHERE tok >= 0 GROUP BY w ORDER BY w
"""


def load_vocabulary(path: str) -> tuple[np.ndarray, pa.Table, np.ndarray]:
    """(id of each byte, merge table, which bytes can meet in a token) of a tokenizer file with byte-level BPE.

    The merge table is a, b, rank, joined and next_rank, the lowest rank of a merge that `joined`
    takes part in. Rounds rely on next_rank > rank, which holds for every vocabulary whose merges
    were learned in order; one without it is refused.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    # byte-level vocabularies write byte b as a printable character: itself where printable, else 256 and up in order
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte_id = np.zeros(256, np.int32)
    for b in shown:
        byte_id[b] = vocab[chr(b)]
    for k, b in enumerate(rest):
        byte_id[b] = vocab[chr(256 + k)]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    left, right, joined = (np.array([vocab[of(m)] for m in merges], np.int32) for of in (lambda m: m[0], lambda m: m[1], "".join))
    rank = np.arange(len(merges), dtype=np.int32)
    # the lowest rank of a merge that a token takes part in; no rank is beyond the last
    uses = np.full(max(vocab.values()) + 1, len(merges), np.int32)
    np.minimum.at(uses, left, rank)
    np.minimum.at(uses, right, rank)
    if (uses[joined] <= rank).any():
        raise ValueError("a merge comes before one that makes its part; the order of rounds would matter")
    table = pa.table({"a": left, "b": right, "rank": rank, "joined": joined, "next_rank": uses[joined]})
    code = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}
    meet = np.zeros((256, 256), bool)
    for m in merges:
        meet[code[m[0][-1]], code[m[1][0]]] = True
    return byte_id, table, meet


class Encoder:
    """Encodes texts in one process, keeping the ids of the parts met so far."""

    def __init__(self, path: str):
        import duckdb
        import regex

        self.byte_id, merges, self.meet = load_vocabulary(path)
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        self.db.register("merges_", merges)
        self.db.execute("CREATE TABLE merges AS FROM merges_")
        self.cut = regex.compile(PATTERN).findall
        self.known: dict[bytes, np.ndarray] = {}
        self.split: dict[str, list[bytes]] = {}
        self.held = 0

    def parts(self, word: str) -> list[bytes]:
        """The word's bytes, cut wherever no token can hold the bytes on both sides."""
        got = self.split.get(word)
        if got is None:
            coded = word.encode("utf-8", "surrogatepass")
            x = np.frombuffer(coded, np.uint8)
            cuts = (np.flatnonzero(~self.meet[x[:-1], x[1:]]) + 1).tolist()
            got = self.split[word] = [coded[i:j] for i, j in zip([0, *cuts], [*cuts, len(coded)])] if cuts else [coded]
            self.held += len(coded)
        return got

    def _learn(self, parts: list[bytes]) -> None:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        start = np.concatenate([[0], np.cumsum(sizes)])
        w = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        pos = (np.arange(start[-1]) - np.repeat(start[:-1], sizes)).astype(np.int32)
        tok = self.byte_id[np.frombuffer(b"".join(parts), np.uint8)]
        big = int(start[-1]) > 2 * QUERY_BYTES
        if big:
            self.db.execute(f"SET memory_limit = '{MEMORY_MB + int(start[-1]) * MEMORY_PER_BYTE // 1_000_000}MB'")
        self.db.register("fresh", pa.table({"w": w, "pos": pos, "tok": tok}))
        ids = self.db.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("fresh")
        if big:
            self.db.execute(f"SET memory_limit = '{MEMORY_MB}MB'")
        flat, cuts = ids.values.to_numpy(), ids.offsets.to_numpy()
        for k, part in enumerate(parts):
            self.known[part] = flat[cuts[k] : cuts[k + 1]]
        self.held += int(start[-1])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; no ids for an empty or null one."""
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.known.clear()
            self.split.clear()
            self.held = 0
        cut = [[p for w in self.cut(t) for p in self.parts(w)] if t else [] for t in texts]
        known = self.known
        fresh, size = [], 0
        for part in dict.fromkeys(p for parts in cut for p in parts if p not in known):
            if fresh and size + len(part) > QUERY_BYTES:
                self._learn(fresh)
                fresh, size = [], 0
            fresh.append(part)
            size += len(part)
        if fresh:
            self._learn(fresh)
        flat = [known[p] for parts in cut for p in parts]
        sizes = np.fromiter((sum(len(known[p]) for p in parts) for parts in cut), np.int64, len(cut))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()))


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the ids of every text by the tokenizer, without special tokens.

    Every row gives a row, repeated ones too. An empty or null text has the empty list of ids; the
    strings of special tokens in a text are ordinary text. Texts of any length are encoded whole.
    vocabulary is the path of the tokenizer file, by default byte_bpe_50k.json in
    `tokenizer_dir()`; it has to be readable at that path on every executor. Columns of other names
    are ignored.
    """
    path = vocabulary or os.path.join(tokenizer_dir(), "byte_bpe_50k.json")
    d = distinct_names(docs, key, text)
    kind = dict(d.dtypes)[key]
    d = d.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or Encoder(path)
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], names=["k", "ids"])

    return d.mapInArrow(encode, "k string, ids array<int>").select(F.col("k").cast(kind).alias(key), "ids")
