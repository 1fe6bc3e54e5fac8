"""Token ids of whole texts by a public byte-level BPE vocabulary.

Each task keeps an in-process DuckDB with the merge table. A batch of texts is split into words by the
vocabulary's pattern; the words not met before become token-position rows, and one recursive query
contracts, in every word at once, the pair of least rank until no pair can be merged. All places of
that pair in a word are contracted together, from the left; that gives what contracting them one by one
gives, as a pair with the new token has a higher rank. Ordered aggregation gives each word's ids.

Words of more than ``_SHORT`` bytes would take a round for nearly each of their tokens. For them one round
contracts every pair whose rank is the least among the pairs around it, as far as the longest token
reaches: a merge of lower rank farther off could only get there by growing into a token that is longer
than any. Only the round that lives is kept, as a table of the in-process database, which writes nothing to disk.

Defined results: empty and null texts give an empty list. Special tokens are never made; their strings
in a text are ordinary text. Texts and words of any length are read whole; repeated rows give repeated rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The pattern that splits a text before the merges; a fixed value of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_SHORT = 256  # bytes of a word that goes by the one recursive query
_KEPT_WORDS = 400_000  # words a task remembers; beyond it, it forgets and works them out again

_IN_MEMORY = {"threads": 1, "memory_limit": "384MB", "temp_directory": ""}

_MERGE_WORDS = """
WITH RECURSIVE step(word, pos, tok, round) AS (
    SELECT word, pos, tok, 0 FROM start
    UNION ALL
    SELECT word, pos, coalesce(merged_here, tok), round + 1
    FROM (
        SELECT *, lag(merged_here) OVER (PARTITION BY word ORDER BY pos) AS merged_before
        FROM (
            -- of overlapping places of the same pair, every second one from the left
            SELECT *, CASE WHEN here AND (row_number() OVER (PARTITION BY word, here, idx - nth ORDER BY pos)) % 2 = 1 THEN merged END AS merged_here
            FROM (
                SELECT *, row_number() OVER (PARTITION BY word, here ORDER BY pos) AS nth
                FROM (
                    SELECT word, pos, tok, round, idx, merged, coalesce(rank = least_rank, false) AS here
                    FROM (
                        SELECT c.*, m.rank, m.merged, min(m.rank) OVER (PARTITION BY c.word) AS least_rank
                        FROM (
                            SELECT word, pos, tok, round,
                                   lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt,
                                   row_number() OVER (PARTITION BY word ORDER BY pos) AS idx
                            FROM step
                        ) c LEFT JOIN merges m ON c.tok = m.lft AND c.nxt = m.rgt
                    )
                    WHERE least_rank IS NOT NULL
                )
            )
        )
    )
    WHERE merged_before IS NULL
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM step SEMI JOIN (SELECT word, max(round) AS round FROM step GROUP BY word) last USING (word, round)
GROUP BY word
"""

_CONTRACT_LONG = """
CREATE OR REPLACE TABLE following AS
SELECT pos, coalesce(merged_here, tok) AS tok, merged_here IS NOT NULL AS changed
FROM (
    SELECT *, lag(merged_here) OVER (ORDER BY idx) AS merged_before
    FROM (
        -- a run of one overlapping pair is contracted as a whole: every second place from its left end
        SELECT *, CASE WHEN bool_and(rank = least) OVER (PARTITION BY run) AND (idx - min(idx) OVER (PARTITION BY run)) % 2 = 0 THEN merged END AS merged_here
        FROM (
            SELECT *, min(rank) OVER (ORDER BY idx ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS least, sum(CASE WHEN rank = rank_before THEN 0 ELSE 1 END) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run
            FROM (
                SELECT c.*, m.rank, m.merged, lag(m.rank) OVER (ORDER BY idx) AS rank_before
                FROM (SELECT pos, tok, lead(tok) OVER (ORDER BY pos) AS nxt, row_number() OVER (ORDER BY pos) AS idx FROM live) c
                LEFT JOIN merges m ON c.tok = m.lft AND c.nxt = m.rgt
            )
        )
    )
)
WHERE merged_before IS NULL
"""


class Vocabulary:
    """Merge and byte tables of a vocabulary file in the tokenizers' JSON form."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = ([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs], [ids[a + b] for a, b in pairs])
        letters = self._byte_letters()
        self.byte_ids = [ids[letters[b]] for b in range(256)]
        back = {ch: b for b, ch in letters.items()}
        # a token's merges must come after its own, else pairs around a place say nothing about it
        made = {}
        for rank, merged in enumerate(self.merges[2]):
            made.setdefault(merged, rank)
        self.in_order = all(made.get(a, -1) < rank and made.get(b, -1) < rank for rank, (a, b) in enumerate(zip(*self.merges[:2])))
        self.token_bytes = {i: bytes(back[ch] for ch in token) for token, i in ids.items() if all(ch in back for ch in token)}

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """Printable stand-ins of the bytes: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class WordEncoder:
    """Words to ids, in one process."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import duckdb
        import regex

        self.split = regex.compile(PATTERN).findall
        self.byte_ids = vocabulary.byte_ids
        self.tokens = list(vocabulary.token_bytes.values()) if vocabulary.in_order else None
        self.known: dict[str, list[int]] = {}
        self.db = duckdb.connect(":memory:", config=_IN_MEMORY)
        left, right, merged = vocabulary.merges
        merges = pa.table({"lft": pa.array(left, pa.int32()), "rgt": pa.array(right, pa.int32()), "rank": pa.array(range(len(left)), pa.int32()), "merged": pa.array(merged, pa.int32())})
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > _KEPT_WORDS:
            self.known.clear()
        raw = {w: w.encode("utf-8", "surrogatepass") for w in words}
        for w in [w for w, b in raw.items() if len(b) > _SHORT]:
            self.known[w] = self._long(raw.pop(w))
        part: list[str] = []
        size = 0
        for w in raw:
            part.append(w)
            size += len(raw[w])
            if size > 60_000:  # bounds the rows of all rounds
                self._learn_short(part, raw)
                part, size = [], 0
        if part:
            self._learn_short(part, raw)

    def _learn_short(self, part: list[str], raw: dict[str, bytes]) -> None:
        word, pos, tok = [], [], []
        for i, w in enumerate(part):
            word += [i] * len(raw[w])
            pos += range(len(raw[w]))
            tok += [self.byte_ids[b] for b in raw[w]]
        self.db.register("start", pa.table({"word": pa.array(word, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tok, pa.int32())}))
        found = self.db.sql(_MERGE_WORDS).to_arrow_table()
        self.db.unregister("start")
        for i, ids in zip(found.column("word").to_pylist(), found.column("ids").to_pylist()):
            self.known[part[i]] = ids

    def _long(self, raw: bytes) -> list[int]:
        """Ids of one long word, a round at a time."""
        own = frozenset(raw)
        # no token of other bytes can come about in this word
        reach = len(raw) if self.tokens is None else max((len(t) for t in self.tokens if len(t) > 1 and own.issuperset(t)), default=1)
        self.db.execute(f"SET memory_limit = '{max(384, len(raw) // 2000)}MB'")  # half a kilobyte a byte
        start = pa.table({"pos": pa.array(range(len(raw)), pa.int32()), "tok": pa.array([self.byte_ids[b] for b in raw], pa.int32())})
        self.db.register("start", start)
        self.db.execute("CREATE OR REPLACE TABLE live AS SELECT pos, tok FROM start")
        self.db.unregister("start")
        query = _CONTRACT_LONG.format(reach=reach)
        while True:
            self.db.execute(query)
            self.db.execute("DROP TABLE live")
            self.db.execute("ALTER TABLE following RENAME TO live")
            ((changed,),) = self.db.execute("SELECT coalesce(bool_or(changed), false) FROM live").fetchall()
            if not changed:
                break
        ((ids,),) = self.db.execute("SELECT list(tok ORDER BY pos) FROM live").fetchall()
        self.db.execute("DROP TABLE live")
        self.db.execute(f"SET memory_limit = '{_IN_MEMORY['memory_limit']}'")
        return ids

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        wanted = {w for words in split for w in words}
        if len(self.known) > _KEPT_WORDS:
            self.known.clear()
        new = [w for w in wanted if w not in self.known]
        if new:
            self._learn(new)
        known = self.known
        return [list(chain.from_iterable(map(known.__getitem__, words))) for words in split]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row. The vocabulary, of fixed size, is broadcast."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    narrow = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):  # bounds the words and ids held at a time
                part = batch.slice(a, 1000)
                ids = encoder.encode(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    return narrow.mapInArrow(run, f"`{key}` {dict(narrow.dtypes)[key]}, ids array<int>")


_DECODE = """
SELECT row, string_agg(hex(bytes), '' ORDER BY pos) AS hex
FROM (SELECT row, unnest(ids) AS tok, generate_subscripts(ids, 1) AS pos FROM encoded) JOIN vocabulary USING (tok)
GROUP BY row
"""


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key`` and the ``text`` that ``ids`` stand for: the token rows joined with the vocabulary and
    put together in order. An empty or null list gives an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))
    narrow = df.select(key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(":memory:", config=_IN_MEMORY)
        table = shared.value.token_bytes
        db.register("vocabulary_in", pa.table({"tok": pa.array(list(table), pa.int32()), "bytes": pa.array(list(table.values()), pa.binary())}))
        db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                db.register("encoded", pa.table({"row": pa.array(range(part.num_rows), pa.int32()), "ids": part.column(1)}))
                found = db.sql(_DECODE).to_arrow_table()
                db.unregister("encoded")
                by_row = dict(zip(found.column("row").to_pylist(), found.column("hex").to_pylist()))
                texts = [bytes.fromhex(by_row.get(i, "")).decode("utf-8", "replace") for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return narrow.mapInArrow(run, f"`{key}` {dict(narrow.dtypes)[key]}, text string")
