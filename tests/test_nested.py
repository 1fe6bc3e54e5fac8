import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from relayscope.operators.nested import AUTH_PLACES, LISTS, META_PLACES, SINGLES, _Shredder, children, identity, rebuild, shred

PLACES = {"meta_json": META_PLACES, "authentication_json": AUTH_PLACES}
ATT = {"filename": "a.pdf", "sha256": "aa"}


def run(spark, rows):
    df = spark.createDataFrame(rows, "id string, meta_json string, authentication_json string, path string, hash string")
    made = shred(df, "id", list(PLACES))
    return made, {(r["id"], r["path"], r["item"]) for r in children(made, PLACES).collect()}


def test_paths_and_items(spark):
    inner = {"sha256": "in", "to_addresses": ["x@t", None, "y@t"], "attachments": json.dumps([{"sha256": "deep", "embedded": json.dumps({"sha256": "dd", "issues": {"field": "f"}})}])}
    meta = {"to_addresses": json.dumps(["a@t", "b@t"]), "attachments": [None, {"sha256": "s1", "embedded": inner}], "issues": {"field": "subject"}}
    auth = {"spf": {"result": "pass"}, "dkim": [{"result": "fail"}, None, {"result": "none"}], "dmarc": None}
    _, got = run(spark, [("1", json.dumps(json.dumps(meta)), json.dumps(auth), "clash", "clash")])
    assert got == {
        ("1", "to_addresses/0", "a@t"),
        ("1", "to_addresses/1", "b@t"),
        ("1", "attachments/1", "s1"),
        ("1", "attachments/1/embedded", "in"),
        ("1", "attachments/1/embedded/to_addresses/0", "x@t"),
        ("1", "attachments/1/embedded/to_addresses/2", "y@t"),
        ("1", "attachments/1/embedded/attachments/0", "deep"),
        ("1", "attachments/1/embedded/attachments/0/embedded", "dd"),
        ("1", "attachments/1/embedded/attachments/0/embedded/issues/0", "f"),
        ("1", "issues/0", "subject"),
        ("1", "spf/0", "pass"),
        ("1", "dkim/0", "fail"),
        ("1", "dkim/2", "none"),
    }


def test_nulls_broken_and_plain_text(spark):
    rows = [
        ("n", None, None, None, None),
        ("b", '{"to_addresses": ["a@t"', "null", None, None),
        ("p", '{"to_addresses": "solo@t", "attachments": "[{\\"sha256\\": \\"x", "issues": []}', "[1]", None, None),
        ("e", "{}", "", None, None),
    ]
    _, got = run(spark, rows)
    assert got == {("p", "to_addresses/0", "solo@t")}


def test_equal_objects_are_stored_once_and_all_occurrences_kept(spark):
    a = json.dumps({"attachments": [ATT, {"sha256": "aa", "filename": "a.pdf"}]})
    b = json.dumps({"attachments": json.dumps([ATT])})
    made, got = run(spark, [("1", a, None, None, None), ("2", b, None, None, None), ("2", b, None, None, None)])
    assert len([g for g in got if g[2] == "aa"]) == 3
    stored = {r["hash"]: r["n"] for r in made.objects.collect()}
    assert stored[identity('{"filename":"a.pdf","sha256":"aa"}')] == 4
    # two records twice over: three roots, three arrays, four attachments
    assert made.bridge.count() == 10 and len(stored) == 5


def test_children_of_bridge_belong_to_parent_identities(spark):
    made, _ = run(spark, [("1", json.dumps({"attachments": [{"sha256": "s", "embedded": {"sha256": "m"}}]}), None, None, None)])
    rows = {r["path"]: r for r in made.bridge.collect()}
    assert rows["attachments/0/embedded"]["parent_hash"] == rows["attachments/0"]["hash"]


def test_empty_table_and_long_text(spark):
    assert run(spark, [])[1] == set()
    many = json.dumps({"to_addresses": [f"u{i}@t" for i in range(20_000)]})
    assert len(run(spark, [("1", many, None, None, None)])[1]) == 20_000


def rows_of(value):
    shredder = _Shredder(frozenset(LISTS), frozenset(SINGLES))
    shredder.record("1", "meta_json", value if isinstance(value, str) else json.dumps(value))
    return shredder.rows


def root(value):
    return next(r[6] for r in rows_of(value) if r[0] is not None and r[2] is None)


PLAIN = st.none() | st.booleans() | st.integers(-(10**18), 10**18) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]).filter(lambda c: c not in '[{"'), max_size=6)
VALUES = st.recursive(PLAIN, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["a", "parts", "attachments", "embedded", "issues", "x/y"]), x, max_size=3), max_leaves=12)
DICTS = st.dictionaries(st.sampled_from(["a", "parts", "attachments", "to_addresses", "embedded", "spf"]), VALUES, max_size=4)


@settings(max_examples=300, deadline=None)
@given(DICTS)
def test_records_come_back_from_their_root(value):
    rows = rows_of(value)
    contents = {r[6]: r[7] for r in rows if r[7] is not None}
    assert rebuild(root(value), contents.__getitem__) == value
    assert {r[6] for r in rows if r[7] is None} == set(contents)  # no object without an occurrence
    paths = [r[5] for r in rows if r[7] is None]
    parents = {r[6] for r in rows if r[7] is None}
    assert all(r[2] in parents for r in rows if r[7] is None and r[5])
    assert paths.count("") == 1


@settings(max_examples=300, deadline=None)
@given(DICTS, DICTS)
def test_only_equal_records_have_equal_identities(a, b):
    assert (root(a) == root(b)) == (json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True))


def test_forms_that_look_alike_have_identities_of_their_own():
    forms = [None, [], {}, [[]], [None], [{"a": 1}], {"a": 1}, [[{"a": 1}]], [[{"a": 2}]], "x", ["x"], [["x"]], ["#", "x"], [["#", "x"]]]
    assert len({root({"attachments": f}) for f in forms}) == len(forms)
    assert len({root({"parts": f}) for f in forms}) == len(forms)


def test_every_object_is_a_node():
    paths = {r[5] for r in rows_of({"parts": [{"b": {"c": 1}}, [{"d": [2]}]], "x/y": {"z": 1}}) if r[7] is None}
    assert paths == {"", "parts", "parts/0", "parts/0/b", "parts/1", "parts/1/0", "parts/1/0/d", "parts/1/0/d/0", "x~1y"}


@pytest.mark.parametrize("layers", [1, 7, 8, 9, 12])
def test_any_number_of_text_layers(layers):
    text = json.dumps({"to_addresses": ["a@t"]})
    for _ in range(layers):
        text = json.dumps(text)
    assert "to_addresses/0" in {r[5] for r in rows_of(text)}


def test_children_only_at_their_places(spark):
    _, got = run(spark, [("1", json.dumps({"spf": {"result": "x"}, "other": {"issues": [{"field": "f"}]}, "attachments": [[{"sha256": "in a list"}]]}), None, None, None)])
    assert got == {("1", "attachments/0", None)}


@pytest.mark.parametrize("depth", [900, 1500, 4000, 200_000])
def test_deep_records(depth):
    for text in ('{"a":' * depth + "1" + "}" * depth, '{"a":' + "[" * depth + "1" + "]" * depth + "}"):
        rows = rows_of(text)
        assert len([r for r in rows if r[7] is None]) >= depth or rows == []
