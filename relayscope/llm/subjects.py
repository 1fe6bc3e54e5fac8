"""Subject areas of documents by class-association rules.

Sentences of labelled documents become transactions: their words and the area of the label. Parallel
frequent-pattern growth mines them; frequent sets of any length with an area are rules ``words -> area``.
Words that don't lean to an area by themselves are kept apart; pairs of two such words that lean to
one together are rules too. Rules that a shorter one makes redundant are pruned, most while the patterns
grow: a sentence of 40 words that returns has 2**40 frequent sets, of which the tasks visit few and the
driver gets none that can't be a rule. A sentence's evidence for an area is what the matching rules say,
each word counting by the strongest rule it takes part in. The evidence is calibrated on sentences kept
out of the mining: a monotone map gives the probability that the area of most evidence is right. A
sentence takes two words that speak for its area; a single one, however sure, isn't enough. A document
is about the areas that hold at least a quarter of its sentences with an area.

Labels belong to whole documents, are partly wrong and may name two areas, so mining runs twice: the
first rules settle which of the sentences are about what, the second are mined from that. Sentences that
return in documents of several areas without leaning to one stand for ``no area``, which the second
round treats like an area. A rule counts by the lower bound of its confidence, so few cases say little.

Defined results: null and blank documents, and those without any sentence with an area, have no row.
Repeated labels count once. Without labels there are no rules and no rows. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relayscope.llm.leaks import words_of

_CLASS = "\x01"  # marks the area among a transaction's items
NO_AREA = ""

_HEADER = re.compile(r"(?im)\bReceived:\s+from\s+\S+(?:\s+\([^)\n]*\))?\s+by\s+\S+|^[> \t]*(?:Received|From|To|Cc|Sent|Date|Subject|Message-ID|Return-Path|Von|An|Gesendet|Betreff|De|À|Objet|Para|Asunto|Enviado|X-[\w-]+):[^\n]*$")
_LINK = re.compile(r"\b(?:https?|hxxps?|ftp)://\S+|\bwww\.\S+")
_CODE = re.compile(r"```.*?```|\b(?:if|for|while)\s*\((?:[^()\n{}]|\([^()\n{}]*\))*\)\s*\{[^{}]*\}", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][^<>]*)>")
_QUOTE = re.compile(r"(?m)^(?:[>|]\s?)+")
#: What introduces a postscript; the sentence after it has no area.
_SIGNATURE = re.compile(r"(?m)^[>| \t]*--[ \t]*\n(?:[>| \t]*\S+(?:[ \t]+\S+){0,3}(?<![.!?:,;])[ \t]*(?:\n|$)){1,3}")
_POSTSCRIPT = re.compile(r"(?i)(?<!\w)(?:p\.?\s?-?\s?s\.?|p\.\s?d\.?|n\.\s?b\.?|übrigens|by the way|au fait|por cierto)\s*:?\s+(?=\w)")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|\n\s*\n")


_PASSAGE = 4  # words in a row that mark a passage


def passages_of(texts: list[str | None]) -> frozenset[tuple[str, ...]]:
    """Every ``_PASSAGE`` words in a row of texts whose passages have no area."""
    found = set()
    for text in texts:
        words = words_of(text)
        found.update(zip(*(words[i:] for i in range(_PASSAGE))))
    return frozenset(found)


def _outside(words: list[str], passages: frozenset[tuple[str, ...]]) -> list[str]:
    """The words that lie in none of the passages."""
    inside = set()
    for i, run in enumerate(zip(*(words[j:] for j in range(_PASSAGE)))):
        if run in passages:
            inside.update(range(i, i + _PASSAGE))
    return [w for i, w in enumerate(words) if i not in inside] if inside else words


def passages_in(text: str | None) -> list[str]:
    """The sentences of a text that may have an area, as they stand there."""
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "://" in text or "www." in text:
        text = _LINK.sub(" ", text)
    if "{" in text or "```" in text:
        text = _CODE.sub(" \n\n", text)
    if "<" in text:
        text = _TAG.sub(lambda m: "\n" if m[2][:2].lower() == "br" else " " if m[2][:1].lower() in "aibus" else "\n\n", text)
    if ">" in text or "|" in text:
        text = _QUOTE.sub("", text)
    if ":" in text or "eceived" in text:
        text = _HEADER.sub("\n\n", text)
    if "--" in text:
        text = _SIGNATURE.sub("\n\n", text)
    text = _POSTSCRIPT.sub("\n\n\x02", text)
    return [part for part in _SENTENCE.split(text) if not part.lstrip().startswith("\x02")]


def sentence_words(sentence: str, passages: frozenset[tuple[str, ...]] = frozenset()) -> frozenset[str]:
    """The words of a sentence that may say what it is about."""
    found = words_of(sentence)
    return frozenset(w for w in (_outside(found, passages) if passages else found) if not w.isdigit())


def sentences(text: str | None, passages: frozenset[tuple[str, ...]] = frozenset()) -> list[frozenset[str]]:
    """The words of each sentence that may have an area."""
    return [words for part in passages_in(text) if (words := sentence_words(part, passages))]


@dataclass
class Rules:
    """Rules by their rarest place: words -> (area, weight)."""

    areas: list[str]
    by_word: dict[str, list[tuple[frozenset[str], int, float]]] = field(default_factory=dict)
    steps: list[tuple[float, float]] = field(default_factory=list)  # calibration: least evidence, probability
    passages: frozenset[tuple[str, ...]] = frozenset()

    def shares(self, words: frozenset[str]) -> dict[tuple[str, int], float]:
        """For each word and area the strongest share that a matching rule gives it."""
        best: dict[tuple[str, int], float] = {}
        rules = self.by_word
        for w in words:
            for need, area, weight in rules.get(w, ()):
                if len(need) == 1:
                    if weight > best.get((w, area), 0.0):
                        best[w, area] = weight
                elif need <= words:
                    share = weight / len(need)
                    for x in need:
                        if share > best.get((x, area), 0.0):
                            best[x, area] = share
        return best

    def top(self, words: frozenset[str]) -> tuple[int, float, int]:
        """The area of most evidence, its lead over the next, and how many of the words speak for it."""
        best = self.shares(words)
        if not best:
            return -1, 0.0, 0
        scores = [0.0] * len(self.areas)
        for (_, area), share in best.items():
            scores[area] += share
        area = max(range(len(scores)), key=scores.__getitem__)
        rest = max((s for i, s in enumerate(scores) if i != area), default=0.0)
        return area, scores[area] - rest, sum(a == area for _, a in best)

    def probability(self, lead: float) -> float:
        p = 0.0
        for least, value in self.steps:
            if lead < least:
                break
            p = value
        return p

    def area_of(self, words: frozenset[str], sure: float) -> str | None:
        area, lead, supporters = self.top(words)
        if area < 0 or self.areas[area] == NO_AREA or self.probability(lead) < sure or supporters < 2:
            return None
        return self.areas[area]


def lower_bound(n: float, of: float, z: float = 1.64) -> float:
    """Wilson's lower bound of a share."""
    p = n / of
    return (p + z * z / (2 * of) - z * math.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)


def calibrate(pairs: list[tuple[float, bool]], least: int = 20) -> list[tuple[float, float]]:
    """Pool-adjacent-violators: a non-decreasing step function from evidence to probability."""
    blocks: list[list[float]] = []  # least evidence, right, all
    pairs = sorted(pairs)
    for a in range(0, len(pairs), least):
        part = pairs[a : a + least]
        blocks.append([part[0][0], float(sum(r for _, r in part)), float(len(part))])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            _, right, n = blocks.pop()
            blocks[-1][1] += right
            blocks[-1][2] += n
    return [(b[0], b[1] / b[2]) for b in blocks]


_GAIN = 0.02  # by so much a rule's confidence is above that of every rule with some of its words
_SLACK = 1e-9  # keeps what the bounds below only rule out by rounding


@dataclass(frozen=True)
class _Known:
    """What pattern growth knows beforehand; words and areas are numbers, words that lean to an area come first, then the most frequent."""

    least_count: int
    leaning: int  # so many words lean to an area by themselves; of others only pairs are grown
    bar: list[float]  # least confidence of a rule, by area
    total: list[int]  # transactions with a word
    joint: list[dict[int, int]]  # of these, by area
    reach: list[dict[int, float]]  # confidence of the rules of one word, by area


_Row = tuple[tuple[int, ...], dict[int, int]]  # words in the order of their numbers -> transactions with them by area


def _merged(rows: Iterable[_Row]) -> list[_Row]:
    """Rows of the same words put together; rows without any are left out."""
    out: dict[tuple[int, ...], dict[int, int]] = {}
    for items, by_area in rows:
        if items:
            held = out.setdefault(items, {})
            for a, n in by_area.items():
                held[a] = held.get(a, 0) + n
    return list(out.items())


def _conditional(rows: list[_Row], words: Iterable[int]) -> Iterator[tuple[int, list[_Row]]]:
    """For each of the words the rows with it, cut before it."""
    at: dict[int, list[_Row]] = {w: [] for w in words}
    for row in rows:
        for w in row[0]:
            if w in at:
                at[w].append(row)
    for w, held in at.items():
        yield w, _merged((items[: bisect_left(items, w)], by_area) for items, by_area in held)


def _grow(held: tuple[int, ...], total: int, rows: list[_Row], floor: dict[int, float], known: _Known) -> Iterator[tuple[tuple[int, ...], int, int, int]]:
    """Pattern growth: what may be rules among sets of the words ``held`` and some of the rows'; (words, area, transactions of the area, all).

    ``floor`` has, by area, what rules with some of the words reach at least; an area that isn't there has no rule with more words.
    Left out, with all that hold them, are sets that occur as often as one with a word less (they say the same) and sets that no
    further word can lift over the floor: the transactions of a row stay together whatever is added, so no set has a
    larger share of an area than the best row.
    """
    alone = held[0] >= known.leaning
    shares: dict[int, float] = {}
    count: dict[int, dict[int, int]] = {}
    for items, by_area in rows:
        of = sum(by_area.values())
        for a, n in by_area.items():
            if n > shares.get(a, 0.0) * of:
                shares[a] = n / of
        for w in items:
            c = count.setdefault(w, {})
            for a, n in by_area.items():
                c[a] = c.get(a, 0) + n
    kept: dict[int, tuple[int, dict[int, float]]] = {}
    for w, c in count.items():
        of = sum(c.values())
        if of < known.least_count or of == total or of == known.total[w]:
            continue
        above = {}
        for a, low in floor.items():
            n = c.get(a, 0)
            if n < (1 if alone else known.least_count):
                continue
            low = max(low, known.reach[w].get(a, 0.0))
            p, bar = lower_bound(n, of), known.bar[a]
            if p >= bar:
                if p > low + _GAIN - _SLACK:
                    yield (*held, w), a, n, of
                low = max(low, p - _GAIN)
            most = lower_bound(n, n / shares[a])
            if most >= bar - _SLACK and most > low + _GAIN - _SLACK:
                above[a] = low
        if above and not alone:
            kept[w] = of, above
    rows = _merged((tuple(w for w in items if w in kept), by_area) for items, by_area in rows)
    for w, base in _conditional(rows, kept):
        if base:
            yield from _grow((*held, w), kept[w][0], base, kept[w][1], known)


def _grown(spark: SparkSession, transactions: Counter[tuple[int, tuple[int, ...]]], known: _Known) -> list[tuple[tuple[int, ...], int, int, int]]:
    """Parallel pattern growth: words are dealt into groups; a task grows the sets whose rarest word is in its groups from the transactions cut after it."""
    if not transactions:
        return []
    tasks = spark.sparkContext.defaultParallelism
    groups = 4 * tasks
    shared = spark.sparkContext.broadcast(known)
    kinds, names = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64()), ["deal", "area", "items", "n"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, list[int], int]] = []
            size = 0
            for area, items, n in zip(*(c.to_pylist() for c in batch.columns)):
                for g, end in {w % groups: i + 1 for i, w in enumerate(items)}.items():
                    out.append((g, area, items[:end], n))
                    size += end
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, by_group = shared.value, defaultdict(dict)
        for batch in batches:
            for g, area, items, n in zip(*(c.to_pylist() for c in batch.columns)):
                by_area = by_group[g].setdefault(tuple(items), {})
                by_area[area] = by_area.get(area, 0) + n
        for g, rows in by_group.items():
            for w, base in _conditional(list(rows.items()), range(g, len(held.total), groups)):
                floor = {a: held.reach[w].get(a, 0.0) for a, n in held.joint[w].items() if n >= held.least_count or w >= held.leaning}
                found = list(_grow((w,), held.total[w], base, floor, held))
                if found:
                    words, area, n, of = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array(area, pa.int32()), pa.array(n, pa.int64()), pa.array(of, pa.int64())], names=["items", "area", "n", "of"])

    keys = list(transactions)
    table = pa.table({"area": pa.array([a for a, _ in keys], pa.int32()), "items": pa.array([w for _, w in keys], pa.list_(pa.int32())), "n": pa.array(transactions.values(), pa.int64())})
    rows = spark.createDataFrame(table).repartition(tasks).mapInArrow(dealt, "deal int, area int, items array<int>, n bigint")
    mined = rows.repartition(tasks, "deal").mapInArrow(run, "items array<int>, area int, n bigint, of bigint").toArrow()  # what may be a rule, of the bounded sample
    shared.unpersist()
    return list(zip(map(tuple, mined.column("items").to_pylist()), *(mined.column(c).to_pylist() for c in ("area", "n", "of"))))


def mine(spark: SparkSession, transactions: list[tuple[str, frozenset[str]]], areas: list[str], *, least_count: int, least_confidence: float) -> Rules:
    """Rules from (area, words) pairs of a bounded sample."""
    rules = Rules(areas)
    if not transactions:
        return rules
    number = {a: i for i, a in enumerate(areas)}
    total = len(transactions)
    per_area = Counter(a for a, _ in transactions)
    prior = {a: n / total for a, n in per_area.items()}
    # words that lean to no area are kept apart; pairs of them that do are grown too
    seen: Counter[str] = Counter()
    with_area: Counter[tuple[str, str]] = Counter()
    for area, words in transactions:
        seen.update(words)
        with_area.update((w, area) for w in words)
    bar = {a: min(0.9, max(least_confidence, 1.3 * p)) for a, p in prior.items()}
    stands = {a: max(least_confidence, 1.3 * p) for a, p in prior.items()}
    leaning = {w for (w, a), n in with_area.items() if seen[w] >= least_count and lower_bound(n, seen[w]) >= bar[a]}
    words_ = sorted((w for w, n in seen.items() if n >= least_count), key=lambda w: (w not in leaning, -seen[w], w))
    at = {w: i for i, w in enumerate(words_)}
    joint: list[dict[int, int]] = [{} for _ in words_]
    reach: list[dict[int, float]] = [{} for _ in words_]
    may: list[tuple[frozenset[str], str, int, int]] = []  # words, area, transactions with both, with the words at all
    for (w, a), n in with_area.items():
        if w in at:
            joint[at[w]][number[a]] = n
            if w in leaning and n >= least_count and (p := lower_bound(n, seen[w])) >= stands[a] and p > _GAIN:
                reach[at[w]][number[a]] = p
                may.append((frozenset([w]), a, n, seen[w]))
    known = _Known(least_count, len(leaning), [stands.get(a, 1.0) for a in areas], [seen[w] for w in words_], joint, reach)
    merged: Counter[tuple[int, tuple[int, ...]]] = Counter()
    for a, words in transactions:
        items = sorted(at[w] for w in words & at.keys())
        cut = bisect_left(items, len(leaning))
        merged.update((number[a], tuple(part)) for part in (items[:cut], items[cut:]) if len(part) > 1)
    for items, area, n, of in _grown(spark, merged, known):
        may.append((frozenset(words_[w] for w in items), areas[area], n, of))
    confidence: dict[tuple[frozenset[str], str], float] = {}
    shorter: dict[tuple[str, str], list[tuple[frozenset[str], float]]] = defaultdict(list)  # rules by area and one of their words
    for words, area, n, of in sorted(may, key=lambda x: (len(x[0]), sorted(x[0]), x[1])):
        p = lower_bound(n, of)
        reached = max((q for w in words for some, q in shorter.get((area, w), ()) if some < words), default=0.0)
        if p >= stands[area] and p > reached + _GAIN:
            confidence[words, area] = p
            shorter[area, min(words, key=lambda w: (seen[w], w))].append((words, p))
    by_word: dict[str, list] = defaultdict(list)
    for (words, area), p in confidence.items():
        p = min(p, 0.995)
        weight = math.log(p / (1 - p)) - math.log(prior[area] / (1 - prior[area])) if prior[area] < 1 else 1.0
        if weight > 0:
            by_word[min(words, key=lambda w: (seen[w], w))].append((words, number[area], weight))
    rules.by_word = dict(by_word)
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, *, key: str, text: str, area: str, most: int) -> list[tuple[str, list[str]]]:
    """(text, areas named by at least a third of the document's labels) of at most ``most`` labelled documents."""
    votes = labels.where(F.col(key).isNotNull() & F.col(area).isNotNull()).distinct().groupBy(key, area).agg(F.count(F.lit(1)).alias("n"))
    per_doc = votes.groupBy(key).agg(F.collect_list(F.struct(F.col(area).alias("area"), "n")).alias("votes"))
    chosen = per_doc.orderBy(F.xxhash64(key), key).limit(most)
    rows = docs.where(F.col(text).isNotNull()).select(key, text).join(F.broadcast(chosen), key).collect()  # ``most`` keys at most
    merged: dict[str, Counter[str]] = defaultdict(Counter)  # copies of a text are one document
    for r in rows:
        merged[r[text]].update({v["area"]: v["n"] for v in r["votes"]})
    return [(t, sorted(a for a, n in votes.items() if 3 * n >= sum(votes.values()))) for t, votes in sorted(merged.items())]


def train(spark: SparkSession, sample: list[tuple[str, list[str]]], areas: list[str], *, passages: frozenset[tuple[str, ...]] = frozenset(), sure: float = 0.5, kept_out: int = 5, least_confidence: float = 0.3) -> Rules:
    """Rules from a labelled sample; every ``kept_out``-th document is kept for the calibration."""
    split = [(sentences(t, passages), a) for t, a in sample]
    mined = [x for i, x in enumerate(split) if i % kept_out]
    kept = [x for i, x in enumerate(split) if i % kept_out == 0]

    def scale(n: int) -> int:
        return max(4, round(n * 0.0005))

    first = [(a, s) for found, named in mined for s in found for a in named if a in areas]
    rules = mine(spark, first, areas, least_count=scale(len(first)), least_confidence=least_confidence)
    rules.passages = passages

    def fit(docs: list) -> list[tuple[float, float]]:
        pairs = []
        for found, named in docs:
            for s in found:
                area, lead, _ = rules.top(s)
                if area >= 0 and rules.areas[area] != NO_AREA:
                    pairs.append((lead, rules.areas[area] in named))
        return calibrate(pairs)

    rules.steps = fit(kept)
    named_by: dict[frozenset[str], Counter[str]] = defaultdict(Counter)
    for found, named in mined:
        for s in set(found):
            named_by[s].update(named)
    idle = {s for s, n in named_by.items() if len(n) >= 3 and 2 * max(n.values()) <= sum(n.values())}
    second = []
    for found, _ in mined:
        for s in found:
            area = NO_AREA if s in idle else rules.area_of(s, 0.7)
            if area is not None:
                second.append((area, s))
    if any(a != NO_AREA for a, _ in second):
        rules = mine(spark, second, [*areas, NO_AREA], least_count=scale(len(second)), least_confidence=least_confidence)
        rules.steps = fit(kept)
        rules.passages = passages
    return rules


def assign(docs: DataFrame, key: str, text: str, rules: Rules, *, sure: float = 0.5, share: float = 0.25) -> DataFrame:
    """One row per document and area it is about: ``key``, area, sentences of the area, all sentences with one."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    narrow = docs.select(key, text).where(F.col(text).isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        remembered: dict[str, str | None] = {}
        for batch in batches:
            at, area, n, of = [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                counts: Counter[str] = Counter()
                for part in passages_in(value):
                    if part not in remembered:
                        if len(remembered) > 200_000:  # the bound of this memory alone; what it forgets is worked out again
                            remembered.clear()
                        words = sentence_words(part, held.passages)
                        remembered[part] = held.area_of(words, sure) if words else None
                    if remembered[part] is not None:
                        counts[remembered[part]] += 1
                total = sum(counts.values())
                for a, k in sorted(counts.items()):
                    if k >= share * total:
                        at.append(i)
                        area.append(a)
                        n.append(k)
                        of.append(total)
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(area, pa.string()), pa.array(n, pa.int32()), pa.array(of, pa.int32())], names=[key, "area", "sentences", "of"])

    return narrow.mapInArrow(run, f"`{key}` {dict(narrow.dtypes)[key]}, area string, sentences int, of int")


def subject_areas(docs: DataFrame, labels: DataFrame, areas: DataFrame, items: DataFrame, *, most_labelled: int = 4000, most_items: int = 20_000) -> DataFrame:
    """``assign`` with rules from at most ``most_labelled`` labelled documents (a bound, not a share).

    Passages of ``items`` have no area. They go to every task, so there may be ``most_items`` at most.
    """
    spark = docs.sparkSession
    names = sorted(r[0] for r in areas.select("area").where("area is not null").distinct().collect())
    texts = [r[0] for r in items.select("text").where("text is not null").limit(most_items + 1).collect()]
    if len(texts) > most_items:
        raise ValueError(f"more than {most_items} items; strip their passages from the documents in blocks first")
    sample = labelled_sample(docs, labels, key="doc_id", text="text", area="area", most=most_labelled)
    return assign(docs, "doc_id", "text", train(spark, sample, names, passages=passages_of(texts)))
