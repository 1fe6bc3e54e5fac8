"""Text that was once decoded with the wrong encoding: found and, where possible, restored.

A hidden Markov model reads each value from left to right. It has one clean state and one state for each
pair (right encoding, wrong encoding). The clean state emits characters as people write them. A pair's
state emits what clean characters look like after they were encoded rightly and decoded wrongly; so the
likelihood of a stretch under it is that of the stretch's inverse transform under the clean model. The
Viterbi path labels every character, and each stretch outside the clean state gets its state's inverse
transform. Text garbled twice is read again until nothing is found.

Defined results: null and empty values are clean. U+FFFD, written out or itself garbled, marks a value
as affected; what it stood for can't be restored. Character references (``&Atilde;``) are resolved only
if the text they give is garbled. Values of any length are read whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

LOST = "�"
#: (right, wrong): the pairs with a state.
PAIRS = (
    ("utf-8", "cp1252"),
    ("utf-8", "cp1250"),
    ("utf-8", "cp1251"),
    ("utf-8", "cp1254"),
    ("utf-8", "cp437"),
    ("utf-8", "cp850"),
    ("utf-8", "mac_roman"),
    ("utf-8", "koi8-r"),
    ("cp1251", "cp1252"),
    ("koi8-r", "cp1252"),
    ("koi8-r", "cp1251"),
    ("cp1251", "koi8-r"),
    ("cp1253", "cp1252"),
)

# --- the clean state -------------------------------------------------------------------------------

SPACE, DIGIT, LOWER, UPPER, ALOWER, AUPPER, CLOWER, CUPPER, GLOWER, GUPPER, PUNCT, NICE, PICTURE, HIDDEN, ODD, OTHER, GFINAL = range(17)
#: Cost (negative log-likelihood) of a character by its class.
_COST = {SPACE: 2.0, DIGIT: 3.0, LOWER: 2.9, UPPER: 3.6, ALOWER: 5.0, AUPPER: 6.5, CLOWER: 3.2, CUPPER: 4.2, GLOWER: 3.4, GUPPER: 4.4, PUNCT: 4.0, NICE: 6.0, PICTURE: 7.0, HIDDEN: 8.0, ODD: 11.0, OTHER: 8.0, GFINAL: 3.4}

# Accented letters that are usual in European languages, and signs that are usual in mail.
_USUAL = set("éèàçêôûîâùëïœæÉÈÀÇÊÔÛÎÂÙËÏŒÆüöäßÜÖÄñóíáú¿¡ÑÓÍÁÚãõÃÕøåØÅłşışğřčžšýżźćńęąőűŁŞĞİŘČŽŠÝŻŹĆŃĘĄŐŰðþÞòìÒÌ")
_RARE_USUAL = set("ÃÂÐÅÄÆØÞãðþòìÌÒß")
_NICE = set("–—’‘“”€£§º°ª¿¡«»…№™©®·•´×±²³½¼¾µ")
_DISGUISES = set("іѕјһӏԁԛԝЅІЈҮ")  # letters outside Russian that pass for Latin ones
# Share of each letter in Russian text, in percent.
_RUSSIAN = "о 11 е 8.5 а 8 и 7.4 н 6.7 т 6.3 с 5.5 р 4.7 в 4.5 л 4.3 к 3.5 м 3.2 д 3 п 2.8 у 2.6 я 2 ы 1.9 ь 1.7 г 1.7 з 1.6 б 1.6 ч 1.4 й 1.2 х 1 ж 0.9 ш 0.7 ю 0.6 ц 0.5 щ 0.4 э 0.3 ф 0.3 ъ 0.04 ё 0.3"
# Share of each letter in Greek text, in percent.
_GREEK = "α 9.4 ο 8 ι 7.2 ε 7 τ 7.8 σ 4.9 ν 6.6 η 3.6 υ 3.6 ρ 4.2 π 4.2 κ 4 μ 3.4 λ 3.2 ς 3.2 ω 1.6 θ 1.3 γ 1.8 δ 1.7 χ 1.2 ξ 0.5 φ 0.8 β 0.8 ζ 0.4 ψ 0.2 ά 2 έ 1.6 ή 1.4 ί 2.2 ό 1.9 ύ 0.9 ώ 0.6"
_SHARE = {text.split()[i]: float(text.split()[i + 1]) for text in (_RUSSIAN, _GREEK) for i in range(0, len(text.split()), 2)}


@lru_cache(maxsize=4096)
def char_class(ch: str) -> int:
    o = ord(ch)
    if ch == " " or ch in "\t\n\r":
        return SPACE
    if o < 128:
        return DIGIT if ch.isdigit() else LOWER if ch.islower() else UPPER if ch.isupper() else PUNCT if o >= 32 and o != 127 else ODD
    if o < 0xA0 or 0x2500 <= o < 0x25A0 or ch == LOST or 0xE000 <= o < 0xF900:
        return ODD
    if ch in _NICE:
        return NICE
    kind = unicodedata.category(ch)
    if kind[0] == "L":
        upper = kind in ("Lu", "Lt")
        if 0x400 <= o < 0x530:
            return CUPPER if upper else CLOWER
        if ch == "ς":
            return GFINAL
        if 0x370 <= o < 0x400:
            return GUPPER if upper else GLOWER
        if o < 0x250:
            return AUPPER if upper else ALOWER
        return OTHER
    if kind in ("Cf", "Mn", "Zs"):
        return HIDDEN
    if kind == "So" or ch in "‼⁉":
        return PICTURE
    return ODD if kind in ("Sm", "Sc", "Cc", "Cn", "Co") else OTHER


_LETTERS = frozenset((LOWER, UPPER, ALOWER, AUPPER, CLOWER, CUPPER, GLOWER, GUPPER, GFINAL, OTHER))
_SCRIPT = {LOWER: 1, UPPER: 1, ALOWER: 1, AUPPER: 1, CLOWER: 2, CUPPER: 2, GLOWER: 3, GUPPER: 3, GFINAL: 3}
_UPPERS = frozenset((UPPER, AUPPER, CUPPER, GUPPER))
_LOWERS = frozenset((LOWER, ALOWER, CLOWER, GLOWER, GFINAL))


@lru_cache(maxsize=65536)
def clean_cost(before: int, ch: str) -> float:
    """Negative log-likelihood of ``ch`` after a character of class ``before``, as people write."""
    kind = char_class(ch)
    cost = _COST[kind]
    if kind in (ALOWER, AUPPER):
        if ch not in _USUAL:
            cost += 2.5
        elif ch in _RARE_USUAL:
            cost += 1.0
        if before in (ALOWER, AUPPER):
            cost += 2.5  # accented letters seldom follow each other
    elif kind in (CLOWER, CUPPER, GLOWER, GUPPER, GFINAL):
        share = _SHARE.get(ch.lower(), 0.02)
        cost += 1.6 - min(1.6, max(-3.0, 0.7 * (share - 2) if share < 2 else 0.25 * (share - 2)))
        if share <= 0.02:
            cost += 1.0 if ch in _DISGUISES else 3.5
    if ch == LOST:
        cost -= 6.0  # inside a garbled stretch a lost character is nothing odd
    if before == GFINAL and kind in _LETTERS:
        cost += 6.0  # a final letter ends the word
    if kind in _LETTERS and before in _LETTERS:
        if kind in _UPPERS and before in _LOWERS:
            cost += 4.5
        if _SCRIPT.get(kind, 0) != _SCRIPT.get(before, 0):
            cost += 5.0
    elif kind in (NICE, ODD, PICTURE) and before in _LETTERS and ch not in "’º°":
        cost += 4.0
    elif kind in _LETTERS and before in (NICE, ODD) :
        cost += 2.0
    return cost


# --- the garbled states ----------------------------------------------------------------------------

_ENTER, _STAY, _LEAVE, _INSIDE = 7.0, 0.05, 0.7, 5.0
_FOREIGN = 6.0  # a stretch of one script right beside letters of another; look-alike letters do that
_UNLIKELY = 8.0  # a right character that mail seldom has
_LIKELY_SIGNS = set("–—’‘“”„€£§º°ª¿¡«»…№™©®•·✅‼ " + LOST)


def _right_cost(before: int, ch: str, enters: bool, again: bool) -> float:
    """Cost of the character that a garbled stretch stands for; ``again``: it may itself be garbled."""
    kind = char_class(ch)
    cost = clean_cost(before, ch)
    if not again and kind in (HIDDEN, ODD, OTHER, NICE, PICTURE) and ch not in _LIKELY_SIGNS and not (kind == PICTURE and ord(ch) > 0x1F000):
        cost += _UNLIKELY
    elif kind in (ALOWER, AUPPER) and ch not in _USUAL:
        cost += _UNLIKELY / 2
    if enters and kind in _SCRIPT and before in _SCRIPT and _SCRIPT[kind] != _SCRIPT[before]:
        cost += _FOREIGN
    return cost


class _Pair(NamedTuple):
    name: str
    right: str
    byte_of: dict[str, int]


def _byte_table(encoding: str) -> dict[str, int]:
    """Characters of the wrong encoding by byte; bytes it leaves undefined stand for themselves."""
    table = {}
    for b in range(128, 256):
        try:
            table[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            table.setdefault(chr(b), b)
    if encoding == "cp1252":  # and what a strict Latin-1 decoder leaves
        table |= {chr(b): b for b in range(128, 160)}
    return table


@lru_cache(maxsize=1)
def _pairs() -> tuple[_Pair, ...]:
    return tuple(_Pair(f"{right} as {wrong}", right, _byte_table(wrong)) for right, wrong in PAIRS)


def _unit(pair: _Pair, text: str, i: int) -> tuple[int, str] | None:
    """How many characters from ``i`` on the pair's state takes for one right character, and that one."""
    first = pair.byte_of.get(text[i])
    if first is None:
        return None
    if pair.right != "utf-8":
        try:
            return 1, bytes([first]).decode(pair.right)
        except UnicodeDecodeError:
            return None
    size = 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 0
    if not size or i + size > len(text):
        return None
    raw = [first]
    for ch in text[i + 1 : i + size]:
        b = pair.byte_of.get(ch)
        if b is None:
            return None
        raw.append(b)
    try:
        return size, bytes(raw).decode("utf-8")
    except UnicodeDecodeError:
        return None


class Label(NamedTuple):
    start: int
    end: int
    state: str
    restored: str


def viterbi(text: str) -> list[Label]:
    """Stretches of ``text`` outside the clean state, each with its inverse transform."""
    n, pairs = len(text), _pairs()
    states = len(pairs) + 1
    inf = float("inf")
    # best[i][s]: (cost, class before i as the right text has it, from position, from state, character)
    best: list[list[tuple | None]] = [[None] * states for _ in range(n + 1)]
    best[0][0] = (0.0, SPACE, -1, -1, "")
    for i in range(n):
        ch = text[i]
        plain = ord(ch) < 128
        row = best[i]
        here = [(s, r) for s, r in enumerate(row) if r is not None]
        if not here:
            continue
        # stretches seldom begin or end between two letters of a foreign word
        inside = _INSIDE if i and not plain and text[i - 1] > "\x7f" and text[i - 1].isalpha() and ch.isalpha() else 0.0
        units = [] if plain else [(k + 1, u) for k, p in enumerate(pairs) if (u := _unit(p, text, i)) is not None]
        for s, (cost, before, _, _, _) in here:
            c = cost + clean_cost(before, ch)
            if s:
                kind = char_class(ch)
                c += _LEAVE + inside + (_FOREIGN if kind in _SCRIPT and before in _SCRIPT and _SCRIPT[kind] != _SCRIPT[before] else 0.0)
            old = best[i + 1][0]
            if old is None or c < old[0]:
                best[i + 1][0] = (c, char_class(ch), i, s, ch)
            if plain and s:  # ASCII looks the same in every encoding
                c = cost + clean_cost(before, ch) + _STAY
                old = best[i + 1][s]
                if old is None or c < old[0]:
                    best[i + 1][s] = (c, char_class(ch), i, s, ch)
            for t, (size, right) in units:
                c = cost + _right_cost(before, right, s != t, t == 1) + (_STAY if s == t else _ENTER + inside + (_LEAVE + _INSIDE if s else 0.0))
                old = best[i + size][t]
                if old is None or c < old[0]:
                    best[i + size][t] = (c, char_class(right), i, s, right)
    i, s, steps = n, min(range(states), key=lambda k: best[n][k][0] if best[n][k] else inf), []
    while i > 0:
        _, _, j, t, ch = best[i][s]
        steps.append((j, i, s, ch))
        i, s = j, t
    labels: list[Label] = []
    for a, b, s, ch in reversed(steps):
        if s == 0:
            continue
        name = pairs[s - 1].name
        if labels and labels[-1].end == a and labels[-1].state == name:
            labels[-1] = Label(labels[-1].start, b, name, labels[-1].restored + ch)
        else:
            labels.append(Label(a, b, name, ch))
    return [x for x in labels if x.restored != text[x.start : x.end]]


_REFERENCE = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|\w+);")


class Reading(NamedTuple):
    garbled: bool
    restored: str | None  # None where nothing could be restored
    complete: bool  # nothing is lost
    states: tuple[str, ...]


_CLEAN = Reading(False, None, True, ())


@lru_cache(maxsize=50_000)
def read_value(value: str | None) -> Reading:
    """Whether ``value`` is garbled, and the right text as far as it can be had."""
    if not value or (value.isascii() and "&" not in value):
        return _CLEAN
    text, states = value, []
    resolved = html.unescape(text) if "&" in text and _REFERENCE.search(text) else text
    seen = set()
    while not resolved.isascii() and resolved not in seen:
        seen.add(resolved)  # garbling between one-byte encodings keeps the length, so readings could go in a circle
        labels = viterbi(resolved)
        if not labels:
            break
        out, at = [], 0
        for x in labels:
            out += [resolved[at : x.start], x.restored]
            at = x.end
            states.append(x.state)
        text = resolved = "".join(out) + resolved[at:]
    lost = LOST in text
    if not states and not lost:
        return _CLEAN
    return Reading(True, text if text != value else None, not lost, tuple(dict.fromkeys(states)))


def detect(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """One row per garbled value: ``keep``, field, value, restored (null if nothing can be), complete, states."""
    narrow = df.select(*keep, *[df[f].cast("string").alias(f) for f in fields])
    kinds = dict(narrow.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "field string, value string, restored string, complete boolean, states array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, field in enumerate(fields):
                values = batch.column(len(keep) + i).to_pylist()
                found = [(k, r) for k, v in enumerate(values) if (r := read_value(v)).garbled]
                rows = batch.take(pa.array([k for k, _ in found], pa.int64()))
                arrays = [
                    *[rows.column(j) for j in range(len(keep))],
                    pa.array([field] * len(found), pa.string()),
                    pa.array([values[k] for k, _ in found], pa.string()),
                    pa.array([r.restored for _, r in found], pa.string()),
                    pa.array([r.complete for _, r in found], pa.bool_()),
                    pa.array([list(r.states) for _, r in found], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "field", "value", "restored", "complete", "states"])

    return narrow.mapInArrow(run, schema)


def mark(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``garbled``, whether the column ``value`` is; a column it had by that name makes way."""
    df = df.drop("garbled")
    at = df.columns.index(value)
    schema = ", ".join([*(f"`{name}` {kind}" for name, kind in df.dtypes), "garbled boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([read_value(v).garbled for v in batch.column(at).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "garbled"])

    return df.mapInArrow(run, schema)
