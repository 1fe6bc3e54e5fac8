import pytest

from relayscope.llm import queries

COLUMNS = {
    "p2_found": {"id", "field", "kind"},
    "p5_found": {"id", "field"},
    "p6_found": {"id", "field"},
    "p7_ids": {"doc_id", "ids"},
    "p8_found": {"doc_id", "item_id"},
    "p9_found": {"doc_id", "area"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, small, name):
    if name.startswith("p9"):  # a few dozen labels are too few to learn from
        small = small.replace("sf0.001", "sf0.01")
    df = queries.QUERIES[name](spark, small)
    if name in COLUMNS:
        assert set(df.columns) == COLUMNS[name]
    rows = df.collect()
    assert rows
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)


def test_disguised_and_garbled_are_apart(spark, small):
    five = {(r["id"], r["field"]) for r in queries.p5_found(spark, small).collect()}
    six = {(r["id"], r["field"]) for r in queries.p6_found(spark, small).collect()}
    assert not five & six
