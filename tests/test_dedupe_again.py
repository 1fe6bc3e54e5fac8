import pandas as pd
import pyarrow as pa

from relayscope.streaming.dedupe import _thin


def batch(ids):
    n = len(ids)
    return pa.RecordBatch.from_pandas(pd.DataFrame({"page": pd.Series([5] * n, dtype="int32"), "key": ["hot"] * n, "at": list(range(n)), "id": ids, "event_time": pd.to_datetime([0] * n)}), preserve_index=False)


def placed(rows):
    (out,) = _thin(iter([rows]), 16)
    assert out.schema.field("page").type == pa.int32()
    pdf = out.to_pandas()
    assert not pdf["surplus"].iloc[0] and pdf["page"].iloc[0] == 5 and pdf["surplus"].sum() == len(pdf) - 1
    return pdf[pdf["surplus"]]


def test_a_task_that_runs_again_uses_the_same_pages():
    rows = batch([f"r{i:04d}" for i in range(1000)])
    first, again = placed(rows), placed(rows)
    assert first["page"].tolist() == again["page"].tolist()
    assert first["page"].between(0, 15).all() and first["page"].value_counts().max() < 120
    back = placed(rows.take(pa.array([0, *range(999, 0, -1)])))
    assert back.set_index("id")["page"].to_dict() == first.set_index("id")["page"].to_dict()


def test_equal_ids_load_no_page():
    for ids in (["same"] * 1000, [None] * 1000):
        assert placed(batch(ids))["page"].value_counts().max() < 80
