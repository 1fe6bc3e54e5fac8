"""Nested records as flat tables, with Merkle identities.

Each record is taken apart bottom-up. Every object and every array is a node, whatever key it stands
under, and so is every plain element of an array. A node's identity is the hash of its canonical form, in
which the containers below it stand as their own identities; as plain values never look like those, nodes
have equal identities only if they are equal. ``objects`` holds each identity once; ``bridge`` holds
one row for each occurrence with its record, its parent's identity, its key, ordinal and path. The
record itself is an occurrence without parent, so ``rebuild`` gives it back from its root.

Keys named in ``lists`` hold lists: a value stored there without an array has ordinal 0, and text there
(or as an element there) that is JSON counts as what it holds, as does a whole record. Elsewhere text is
text. An array has no ordinal as such; its elements are below it.

Defined results: a null record, a record that isn't complete JSON, or JSON that isn't an object has no
nodes. Null elements take up an ordinal but have no node. Null, an empty array, a single value and an
array of one have different identities. Text under a key of ``lists`` that starts like JSON but isn't
complete JSON stays text and has no children. Repeated records give their own bridge rows and no
new objects. Layers of text have no bound; records nested deeper than the JSON reader takes (some thousand
levels) count as not complete.
Further columns of the input are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayscope.session import materialize

#: Keys that hold lists of children, and keys that hold a single record which may be stored as text.
LISTS = ("to_addresses", "attachments", "issues", "spf", "dkim", "dmarc")
SINGLES = ("embedded",)
#: Child keys by the kind of record they stand in.
META_CHILDREN = ("to_addresses", "attachments", "issues")
AUTH_CHILDREN = ("spf", "dkim", "dmarc")
#: Where a record's children stand: lists of the message and of messages attached to it, those messages themselves, verdicts.
_ATTACHED = r"(?:attachments/\d+/embedded(?:/\d+)?/)*"
META_PLACES = rf"^{_ATTACHED}(?:(?:to_addresses|attachments|issues)/\d+|attachments/\d+/embedded(?:/\d+)?)$"
AUTH_PLACES = r"^(?:spf|dkim|dmarc)/\d+$"
#: Keys whose elements are plain values; the element itself is the item.
PLAIN = frozenset({"to_addresses"})
#: The field that names an object.
ITEM_FIELD = {"attachments": "sha256", "embedded": "sha256", "issues": "field", "spf": "result", "dkim": "result", "dmarc": "result"}

MIXED_SCHEMA = "id string, source string, parent_hash string, key string, ordinal int, path string, hash string, content string, n long"
_DEPTH = 1_000_000  # more than the JSON reader's own limit, so whatever it reads can be taken apart
_BROKEN = object()  # text that starts like JSON but isn't


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


_loads = json.JSONDecoder(parse_constant=_refuse).decode


def unwrap(value: object) -> object:
    """The value that JSON text holds, through any layers of text; other text stays; broken JSON is None."""
    held = _unwrap(value)
    return None if held is _BROKEN else held


def _unwrap(value: object) -> object:
    while isinstance(value, str):
        if value.lstrip()[:1] not in ("{", "[", '"'):
            return value
        try:
            value = _loads(value)  # each layer is shorter than the one around it
        except (ValueError, RecursionError):
            return _BROKEN
    return value


def parse_record(text: str | None) -> dict | None:
    """A stored record as a dict, or None if the text isn't one."""
    if text is None:
        return None
    value = unwrap(text)
    return value if isinstance(value, dict) else None


def identity(canonical: str) -> str:
    """128 bits of SHA-256, as hex."""
    return hashlib.sha256(canonical.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def _canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=True, separators=(",", ":"))


def _step(key: str) -> str:
    """A key as part of a path."""
    return key.replace("~", "~0").replace("/", "~1") if "/" in key or "~" in key else key


Link = tuple[str, "int | None", str, str, list]  # key, ordinal, step of the path, identity, links below


class _Shredder:
    """Takes records apart and keeps the rows of one batch."""

    def __init__(self, lists: frozenset[str], singles: frozenset[str]) -> None:
        self.lists, self.singles = lists, singles
        self.rows: list[tuple] = []
        self.seen: dict[str, int] = {}

    def _stored(self, canonical: str) -> str:
        digest = identity(canonical)
        if digest in self.seen:
            self.seen[digest] += 1
        else:
            self.seen[digest] = 1
            self.rows.append((None, None, None, None, None, None, digest, canonical))
        return digest

    def _object(self, value: dict) -> tuple[str, list[Link]]:
        """Identity of an object and the links to what is below it."""
        links: list[Link] = []
        shown: dict[str, object] = {}
        for key, held in value.items():
            is_list = key in self.lists
            if is_list or key in self.singles:
                inside = _unwrap(held)
                if inside is _BROKEN:  # text without children
                    shown[key] = held
                    continue
                held = inside
            if isinstance(held, list):
                digest, below = self._array(key, held, is_list or key in self.singles)
                links.append((key, None, _step(key), digest, below))
                shown[key] = ["#", digest]
            elif isinstance(held, dict):
                digest, below = self._object(held)
                links.append((key, 0, f"{key}/0", digest, below) if is_list else (key, None, _step(key), digest, below))
                shown[key] = ["#", digest]
            else:
                shown[key] = held
                if is_list and held is not None:
                    links.append((key, 0, f"{key}/0", self._stored(_canonical(held)), []))
        return self._stored(_canonical(shown)), links

    def _array(self, key: str, held: list, text_too: bool) -> tuple[str, list[Link]]:
        """Identity of an array and the links to its elements, which keep its key."""
        links: list[Link] = []
        shown: list[object] = []
        for ordinal, element in enumerate(held):
            if text_too:
                inside = _unwrap(element)
                if inside is _BROKEN:
                    shown.append(element)
                    continue
                element = inside
            if isinstance(element, dict):
                digest, below = self._object(element)
            elif isinstance(element, list):
                digest, below = self._array(key, element, text_too)
            else:
                shown.append(element)
                if element is not None:
                    links.append((key, ordinal, str(ordinal), self._stored(_canonical(element)), []))
                continue
            shown.append(["#", digest])
            links.append((key, ordinal, str(ordinal), digest, below))
        return self._stored(_canonical(shown)), links

    def record(self, rid: str, source: str, text: str | None) -> None:
        value = parse_record(text)
        if value is None:
            return
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, _DEPTH))
        try:
            digest, links = self._object(value)
        finally:
            sys.setrecursionlimit(limit)
        self.rows.append((rid, source, None, None, None, "", digest, None))
        stack = [(digest, "", links)]
        while stack:
            parent, prefix, below = stack.pop()
            for key, ordinal, step, child, deeper in below:
                path = prefix + step
                self.rows.append((rid, source, parent, key, ordinal, path, child, None))
                if deeper:
                    stack.append((child, path + "/", deeper))

    def batch(self) -> pa.RecordBatch:
        """Objects come once a batch, with the number of times they were met."""
        columns = list(zip(*self.rows)) or [()] * 8
        counts = [self.seen[h] if c is not None else None for h, c in zip(columns[6], columns[7])]
        strings = pa.string()
        arrays = [pa.array(columns[i], pa.int32() if i == 4 else strings) for i in range(8)] + [pa.array(counts, pa.int64())]
        names = ["id", "source", "parent_hash", "key", "ordinal", "path", "hash", "content", "n"]
        self.rows, self.seen = [], {}
        return pa.RecordBatch.from_arrays(arrays, names=names)


def rebuild(root: str, content_of: Callable[[str], str]) -> object:
    """The value with the identity ``root``; ``content_of`` looks up the content of an identity."""

    def whole(held: object) -> object:
        return rebuild(held[1], content_of) if isinstance(held, list) else held

    held = json.loads(content_of(root))
    if isinstance(held, dict):
        return {k: whole(v) for k, v in held.items()}
    return [whole(v) for v in held] if isinstance(held, list) else held


@dataclass(frozen=True)
class Shredded:
    """``bridge``: id, source, parent_hash, key, ordinal, path, hash. ``objects``: hash, content, n (occurrences).

    ``stored``: hash and content, not yet once each.
    """

    bridge: DataFrame
    objects: DataFrame
    stored: DataFrame


def shred(df: DataFrame, id_col: str, records: list[str], lists: tuple[str, ...] = LISTS, singles: tuple[str, ...] = SINGLES) -> Shredded:
    """Take the JSON columns ``records`` of ``df`` apart.

    One narrow pass writes a mixed table to the shared folder; ``bridge`` and ``objects`` are views of
    it. Objects are counted within each batch before the shuffle that stores each of them once, so an
    object that a third of all records share costs one row a batch there.
    """
    wanted = df.select(F.col(id_col).cast("string").alias("_id"), *[F.col(c).alias(f"_r{i}") for i, c in enumerate(records)])
    names = list(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shredder = _Shredder(frozenset(lists), frozenset(singles))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, name in enumerate(names):
                for rid, text in zip(ids, batch.column(i + 1).to_pylist()):
                    shredder.record(rid, name, text)
            yield shredder.batch()

    mixed = materialize(wanted.mapInArrow(run, MIXED_SCHEMA), "shredded")
    bridge = mixed.where(F.col("content").isNull()).select("id", "source", "parent_hash", "key", "ordinal", "path", "hash")
    stored = mixed.where(F.col("content").isNotNull()).select("hash", "content", "n")
    return Shredded(bridge, stored.groupBy("hash").agg(F.first("content").alias("content"), F.sum("n").alias("n")), stored.drop("n"))


def _plain_value(content: Column) -> Column:
    """A plain value's canonical JSON as text; null for an object or array."""
    return F.when(~F.substring(content, 1, 1).isin("{", "["), F.get_json_object(F.concat(F.lit('{"v":'), content, F.lit("}")), "$.v"))


def children(shredded: Shredded, places: dict[str, str]) -> DataFrame:
    """One row per child: id, source, path, parent_hash, hash, key, ordinal, item.

    ``places``: for each column of records the pattern of its children's paths. Items are read where objects
    are stored, so only hashes and items are shuffled, and joined to the occurrences; objects that name
    nothing aren't joined. An identity says nothing about the keys it hangs under, so every naming field
    is read, and the occurrence's key picks one. Occurrences may be skewed towards a few objects, which
    AQE splits.
    """
    fields = sorted(set(ITEM_FIELD.values()))
    names = [f"_{f}" for f in fields]
    read = shredded.stored.select("hash", _plain_value(F.col("content")).alias("_value"), F.json_tuple("content", *fields).alias(*names))
    items = [*names, "_value"]
    named = read.where(F.coalesce(*items).isNotNull()).groupBy("hash").agg(*[F.first(c).alias(c) for c in items])
    item = F.when(F.col("key").isin(*PLAIN), F.col("_value"))
    for f, name in zip(fields, names):
        item = item.when(F.col("key").isin(*(k for k, x in ITEM_FIELD.items() if x == f)), F.col(name))
    placed = reduce(or_, [(F.col("source") == source) & F.col("path").rlike(pattern) for source, pattern in places.items()])
    chosen = shredded.bridge.where(placed)
    return chosen.join(named, "hash", "left").select("id", "source", "path", "parent_hash", "hash", "key", "ordinal", item.alias("item"))
