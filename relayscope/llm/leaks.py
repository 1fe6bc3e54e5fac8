"""Evaluation texts inside training documents.

Each shard of documents gets a suffix array over its words. Every suffix of every test item is looked
up in it by binary search; its neighbours there give its longest verbatim matches, and outward from them
come the others with their locations. Around every match of ``seed`` words an exact check counts the words
in common of any ``run`` words of the item. As ``common`` unchanged words of ``run`` have ``seed`` of them
in a row somewhere, no such run is missed, wherever its changed words are. Where words were put in or
left out, matches on diagonals near each other are aligned together.

Words are compared without case, accents, punctuation, breaks and markup. The suffix array leaves out
positions where no item has those ``seed`` words in a row; no match can start there. Documents of the
same words are looked up once, as are items of the same words; their copies come back in the result.
Matches that go on to the left are skipped by whole ranges of the array, so a passage that all
documents of a shard and all items share costs one match a pair, not one for each of its words; a
shard with too many pairs is halved until they fit.

Defined results: null and blank documents and items hold nothing; repeated rows give repeated rows.
Documents and items of any length are read whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_BROKEN = re.compile(r"(\w)[-‐][ \t\r]*\n[>|\s]*(\w)")
_MARK = re.compile("[̀-ͯ]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Words as they are compared."""
    if not text:
        return []
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "-" in text or "‐" in text:
        text = _BROKEN.sub(r"\1\2", text)
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.casefold())


@dataclass(frozen=True)
class Settings:
    run: int = 16  # words of the item that a run has at least
    common: int = 13  # of these, words that are unchanged
    seed: int = 4  # least words of a verbatim match; at most what ``common`` of ``run`` words must have in a row
    drift: int = 6  # inserted or left out words that are tolerated within a run


def _pack(words: np.ndarray, bits: int, block: int) -> np.ndarray:
    """``block`` words from each place on as one number; nothing counts after a 0."""
    n = len(words)
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    for j in range(block):
        part = np.zeros(n, np.int64)
        part[: max(0, n - j)] = words[j:]
        alive &= part > 0
        key = (key << bits) | np.where(alive, part, 0)
    return key


class Packed:
    """Words with their packed blocks; 0 stands for words that no item has and for what parts texts."""

    def __init__(self, words: np.ndarray, bits: int, block: int) -> None:
        self.words, self.bits, self.block = words, bits, block
        self.key = _pack(words, bits, block)

    def at(self, places: np.ndarray) -> np.ndarray:
        """Blocks from ``places`` on; nothing beyond the end."""
        inside = places < len(self.key)
        return np.where(inside, self.key[np.where(inside, places, 0)], 0)

    def agree(self, a: np.ndarray, other: Packed, b: np.ndarray) -> np.ndarray:
        """How many words agree from each place of ``a`` here and of ``b`` there on."""
        length, live, mask = np.zeros(len(a), np.int64), np.arange(len(a)), (1 << self.bits) - 1
        while len(live):
            x, y = self.at(a[live] + length[live]), other.at(b[live] + length[live])
            same = (x == y) & (x & mask > 0)
            length[live[same]] += self.block
            last, x, y = live[~same], x[~same], y[~same]
            agreeing = np.ones(len(last), bool)
            for t in range(self.block - 1, 0, -1):
                u, v = x >> (self.bits * t) & mask, y >> (self.bits * t) & mask
                agreeing &= (u == v) & (u > 0)
                length[last] += agreeing
            live = live[same]
        return length


def _rank(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place from 1 on of each key among ``sorted_keys``; 0 if it isn't there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at + 1, 0)


class Items:
    """A block of test items. Items of the same words are one, with several ids."""

    def __init__(self, rows: list[tuple[int, str | None]], settings: Settings) -> None:
        self.settings = settings
        self.vocabulary: dict[str, int] = {}
        alike: dict[bytes, int] = {}
        self.ids: list[list[int]] = []
        self.words: list[np.ndarray] = []
        for item_id, text in rows:
            found = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int64)
            if len(found) >= settings.run:
                i = alike.setdefault(found.tobytes(), len(self.ids))
                if i == len(self.ids):
                    self.ids.append([])
                    self.words.append(found)
                self.ids[i].append(item_id)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.block = min(settings.seed, 63 // self.bits)
        stop = np.zeros(1, np.int64)
        self.flat = Packed(np.concatenate([x for w in self.words for x in (w, stop)]) if self.words else stop, self.bits, self.block)
        sizes = np.array([len(w) for w in self.words], np.int64)
        self.sizes, self.offset = sizes, np.concatenate([[0], np.cumsum(sizes + 1)])[:-1].astype(np.int64)
        self.blocks = np.unique(self.flat.key)
        seeds = self._pairs(self.flat)
        self.seeds = np.unique(seeds[seeds > 0])
        self.suffix = np.flatnonzero(seeds)  # places of all suffixes of at least ``seed`` words
        self.suffix_seed = _rank(self.seeds, seeds[self.suffix])
        self.suffix_of = np.searchsorted(self.offset, self.suffix, "right") - 1

    def _pairs(self, packed: Packed) -> np.ndarray:
        """The ``seed`` words from each place on as one number, 0 unless all are known: its first and last blocks by their ranks."""
        mask, k = (1 << self.bits) - 1, self.settings.seed
        ranks = np.where(packed.key & mask > 0, _rank(self.blocks, packed.key), 0)
        found = np.zeros(len(ranks), np.int64)
        inside = np.ones(len(ranks), bool)
        for j in sorted({0, k - self.block}):
            moved = np.zeros(len(ranks), np.int64)
            moved[: max(0, len(ranks) - j)] = ranks[j:]
            inside &= moved > 0
            found = found * (len(self.blocks) + 1) + moved
        if self.block * 2 < k:
            raise ValueError("the block of items has too many different words for its seed length; use smaller blocks")
        return np.where(inside, found, 0)

    def seed_of(self, packed: Packed) -> np.ndarray:
        """Number of the seed at each place; 0 where no item has it."""
        return _rank(self.seeds, self._pairs(packed))


class Shard:
    """Suffix array of some documents: all suffixes that begin with a seed, in the order of their words.

    The order of seeds among each other is that of their numbers; whatever follows them is in the order
    of the words' numbers. ``common`` is the number of words that a suffix and the one before it agree in.
    """

    def __init__(self, texts: list[np.ndarray], items: Items) -> None:
        stop = np.zeros(1, np.int64)  # no match goes on into the next document
        self.texts = texts
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.packed = Packed(np.concatenate([x for t in texts for x in (t, stop)]) if texts else stop, items.bits, items.block)
        seed = items.seed_of(self.packed)
        at = np.flatnonzero(seed)
        at = at[np.argsort(seed[at], kind="stable")]
        self.seed = seed[at]
        self.array = self._sorted(at, self.seed, items)
        self.common = np.zeros(len(at), np.int64)
        if len(at):
            self.common[1:] = np.where(self.seed[1:] == self.seed[:-1], self.packed.agree(self.array[:-1], self.packed, self.array[1:]), 0)
        self.left = np.where(self.array > 0, self.packed.words[self.array - 1], 0) if len(at) else at
        self.turns = np.concatenate([[0], np.cumsum(self.left[1:] != self.left[:-1])]) if len(at) else at

    def _sorted(self, at: np.ndarray, group: np.ndarray, items: Items) -> np.ndarray:
        """Places with equal seeds, sorted by the blocks that follow, until no two agree."""
        at, group = at.copy(), group.copy()
        depth, mask = items.settings.seed, (1 << items.bits) - 1
        tied = np.arange(len(at))
        while True:
            if len(tied):
                g = group[tied]
                again = np.zeros(len(tied), bool)
                again[1:] = g[1:] == g[:-1]
                again[:-1] |= again[1:]
                tied = tied[again]
            if not len(tied):
                return at
            following = self.packed.at(at[tied] + depth)
            order = np.lexsort((following, group[tied]))
            at[tied], following = at[tied][order], following[order]
            g = group[tied]
            new = np.ones(len(tied), bool)
            new[1:] = (g[1:] != g[:-1]) | (following[1:] != following[:-1])
            group[tied] = np.cumsum(new)  # numbers of groups matter only among those still tied
            tied = tied[following & mask > 0]  # where a text or its known words end, suffixes stay alike
            depth += items.block

    def ranges(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item suffixes (by number) with the range of suffixes here that share their seed.

        Where every suffix of the range also agrees in the word before, the match is part of one that
        begins earlier, and the item's suffix is left out.
        """
        low = np.searchsorted(self.seed, items.suffix_seed, "left")
        high = np.searchsorted(self.seed, items.suffix_seed, "right")
        which = np.flatnonzero(high > low)
        low, high = low[which], high[which]
        place = items.suffix[which]
        before = np.where(place > 0, items.flat.words[place - 1], 0)
        inner = (before > 0) & (self.turns[high - 1] == self.turns[low]) & (self.left[low] == before)
        return which[~inner], low[~inner], high[~inner]

    def matches(self, items: Items, which: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Left-maximal verbatim matches of these item suffixes: (item, place in item, place here, length).

        Binary search finds where a suffix would stand in the array. Its longest matches are those with
        its two neighbours there; the others' lengths follow outward, as no longer than those passed.
        """
        place, seed = items.suffix[which], items.settings.seed
        a, b = low.copy(), high.copy()
        live = np.flatnonzero(a < b)
        while len(live):
            middle = (a[live] + b[live]) // 2
            here = self.array[middle]
            n = items.flat.agree(place[live] + seed, self.packed, here + seed) + seed
            x, y = items.flat.words[place[live] + n], self.packed.words[here + n]
            above = x > y
            a[live[above]] = middle[above] + 1
            b[live[~above]] = middle[~above]
            live = live[a[live] < b[live]]
        before = np.where(place > 0, items.flat.words[place - 1], 0)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step, first in ((1, a), (-1, a - 1)):
            i = np.flatnonzero((first >= low) & (first < high))
            at = first[i]
            length = items.flat.agree(place[i], self.packed, self.array[at]) if len(i) else i
            while len(i):
                maximal = (before[i] == 0) | (before[i] != self.left[at])
                out.append((i[maximal], self.array[at[maximal]], length[maximal]))
                shared = self.common[at] if step < 0 else self.common[np.minimum(at + 1, len(self.common) - 1)]
                at = at + step
                length = np.minimum(length, shared)
                inside = (at >= low[i]) & (at < high[i])
                i, at, length = i[inside], at[inside], length[inside]
        if not out:
            empty = np.array([], np.int64)
            return empty, empty, empty, empty
        i, here, length = (np.concatenate(x) for x in zip(*out))
        item = items.suffix_of[which[i]]
        return item, place[i] - items.offset[item], here, length


def best_window(item: np.ndarray, here: np.ndarray, matches: list[tuple[int, int, int]], run: int) -> int:
    """Most words in common of any ``run`` words of the item and the text they are aligned with.

    ``matches`` (place in item, place here, length) fix the alignment; a word between two of them is
    compared on the diagonal of the nearer one, so words put in or left out between them do no harm.
    """
    n = len(item)
    diagonal = np.zeros(n, np.int64)
    known = np.zeros(n, bool)
    for place, at, length in sorted(matches, key=lambda m: -m[2]):
        part = slice(place, place + length)
        diagonal[part] = np.where(known[part], diagonal[part], at - place)
        known[part] = True
    fixed = np.flatnonzero(known)
    nearest = np.searchsorted(fixed, np.arange(n))
    before, after = fixed[np.maximum(nearest - 1, 0)], fixed[np.minimum(nearest, len(fixed) - 1)]
    pick = np.where(np.abs(np.arange(n) - before) < np.abs(after - np.arange(n)), before, after)
    at = np.arange(n) + diagonal[pick]
    inside = (at >= 0) & (at < len(here))
    same = inside & (here[np.clip(at, 0, max(len(here) - 1, 0))] == item)
    passed = np.maximum.accumulate(np.where(same, at, -1))
    same[1:] &= at[1:] > passed[:-1]  # no word of the text counts twice
    sums = np.concatenate([[0], np.cumsum(same)])
    return int((sums[run:] - sums[:-run]).max())


def straight_windows(items: Items, shard: Shard, item: np.ndarray, place: np.ndarray, here: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each match the most words in common of any ``run`` words of the item around it and the text straight beside them.

    ``common`` of ``run`` words leave ``run - common`` changed ones, so one stretch between them has at
    least ``seed`` words; every such window holds a match.
    """
    run = items.settings.run
    spare = run - items.settings.seed
    best = np.zeros(len(item), np.int64)
    width = int(length.max(initial=0)) + 2 * spare
    step = max(1, 4_000_000 // max(1, width))  # bounds the cells held at a time
    doc = np.searchsorted(shard.starts, here, "right") - 1
    for a in range(0, len(item), step):
        part = slice(a, a + step)
        shift = np.arange(width)[None, :] - spare
        p, h = place[part, None] + shift, here[part, None] + shift
        size = items.sizes[item[part]][:, None]
        inside = (p >= 0) & (p < size)
        there = inside & (h >= shard.starts[doc[part]][:, None]) & (h < shard.starts[doc[part] + 1][:, None])
        mine = items.flat.words[np.where(inside, p + items.offset[item[part]][:, None], 0)]
        same = there & (mine == shard.packed.words[np.where(there, h, 0)])
        sums = np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(same, 1)], 1)
        whole = np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(inside, 1)], 1)
        windows = np.where(whole[:, run:] - whole[:, :-run] == run, sums[:, run:] - sums[:, :-run], 0)
        best[part] = windows.max(1)
    return best


_PAIRS_AT_ONCE = 2_000_000  # a shard with more of them is halved, down to single documents


def _found(texts: list[np.ndarray], items: Items) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of (text, item, words in common of the best window, longest verbatim match, its place), in parts."""
    s = items.settings
    shard = Shard(texts, items)
    which, low, high = shard.ranges(items)
    if len(texts) > 1 and int((high - low).sum()) > _PAIRS_AT_ONCE:
        half = len(texts) // 2
        yield from _found(texts[:half], items)
        for doc, *rest in _found(texts[half:], items):
            yield doc + half, *rest
        return
    item, place, here, length = shard.matches(items, which, low, high)
    if not len(item):
        return
    doc = np.searchsorted(shard.starts, here, "right") - 1
    order = np.lexsort((here - place, item, doc))
    doc, item, place, here, length = doc[order], item[order], place[order], here[order], length[order]
    common = np.minimum(length, s.run)
    short = np.flatnonzero(common < s.run)
    common[short] = straight_windows(items, shard, item[short], place[short], here[short], length[short])
    pair = np.ones(len(doc), bool)
    pair[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    first = np.flatnonzero(pair)
    best = np.maximum.reduceat(common, first)
    # words were put in or left out where a pair has matches on diagonals near each other
    diagonal = here - place
    near = np.zeros(len(doc), bool)
    near[1:] = ~pair[1:] & (diagonal[1:] != diagonal[:-1]) & (diagonal[1:] - diagonal[:-1] <= s.drift)
    of = np.cumsum(pair) - 1
    bent = np.zeros(len(first), bool)
    bent[of[near]] = True
    last = np.append(first[1:], len(doc))
    for g in np.flatnonzero(bent & (best < s.run)):
        a, b = int(first[g]), int(last[g])
        cuts = [a, *(k for k in range(a + 1, b) if diagonal[k] - diagonal[k - 1] > s.drift), b]
        for x, y in zip(cuts, cuts[1:]):
            if diagonal[x] != diagonal[y - 1]:
                begin = shard.starts[doc[x]]
                found = [(int(p), int(h - begin), int(n)) for p, h, n in zip(place[x:y], here[x:y], length[x:y])]
                best[g] = max(best[g], best_window(items.words[item[x]], texts[doc[x]], found, s.run))
    longest = np.maximum.reduceat(length, first)
    at = np.minimum.reduceat(np.where(length == longest[of], here, len(shard.packed.words)), first)
    yield doc[first], item[first], best, longest, at - shard.starts[doc[first]]


def _parts(sizes: list[int], rows: int, total: int) -> Iterator[tuple[int, int]]:
    """Slices of at most ``rows`` rows and, but for single ones, ``total`` in size."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (i - begin >= rows or held + size > total):
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _rows(keys: pa.Array, members: list[list[int]], ids: list[list[int]], doc: np.ndarray, item: np.ndarray, ints: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of found pairs for every copy of the text and of the item."""
    copies = np.array([len(m) for m in members])[doc] * np.array([len(i) for i in ids])[item]
    for a, b in _parts(copies.tolist(), len(copies), 100_000):
        pairs = [(k, i, n) for n in range(a, b) for k in members[doc[n]] for i in ids[item[n]]]
        at = np.array([n for _, _, n in pairs], np.int64)
        arrays = [keys.take(pa.array([k for k, _, _ in pairs], pa.int64())), pa.array([i for _, i, _ in pairs], pa.int64()), *(pa.array(x[at], pa.int32()) for x in ints)]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


_SCHEMA = "item_id bigint, common int, verbatim int, word int"


def search(docs: DataFrame, key: str, text: str, items: DataFrame, *, item_key: str = "item_id", item_text: str = "text", settings: Settings = Settings(), block_items: int = 20_000) -> DataFrame:
    """Pairs with a match of ``seed`` words: ``key``, item_id, words in common of the best window, longest verbatim match and its place.

    Each task looks up all items in its own shards, so nothing is shuffled. Items go to the tasks in
    blocks of at most ``block_items`` (a bound that is checked); more items mean more passes.
    """
    spark = docs.sparkSession
    narrow = docs.select(key, text).where(F.col(text).isNotNull())
    rows = items.select(F.col(item_key).cast("bigint"), F.col(item_text).cast("string")).where(F.col(item_text).isNotNull())
    n = rows.count()
    blocks = max(1, -(-n // block_items))
    found = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64(item_key), F.lit(blocks)) == b)
        held = [tuple(r) for r in part.limit(4 * block_items).collect()]
        if len(held) >= 4 * block_items:
            raise ValueError("a block of items is far larger than its bound")
        shared = spark.sparkContext.broadcast(Items(sorted(held), settings))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            get = block.vocabulary.get
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in _parts([len(t) for t in texts], 2000, 8_000_000):  # one shard; bounds the words held at a time
                    rows_of: dict[bytes, list[int]] = {}  # copies are looked up once
                    for i in range(a, b):
                        rows_of.setdefault(np.array([get(w, 0) for w in words_of(texts[i])], np.int64).tobytes(), []).append(i)
                    members = list(rows_of.values())
                    for doc, item, *ints in _found([np.frombuffer(w, np.int64) for w in rows_of], block):
                        yield from _rows(batch.column(0), members, block.ids, doc, item, ints, [key, "item_id", "common", "verbatim", "word"])

        one = narrow.mapInArrow(run, f"`{key}` {dict(narrow.dtypes)[key]}, {_SCHEMA}")
        found = one if found is None else found.unionAll(one)
    return found


def leaked(found: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Of the matches those that hold a run of an item."""
    return found.where(F.col("common") >= settings.common)
