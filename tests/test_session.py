import os

import pytest

from relayscope import session


def test_tables_are_written_to_the_shared_folder_and_forgotten(spark):
    kept = list(session._WRITTEN)
    session._WRITTEN.clear()
    try:
        df = session.materialize(spark.range(10).selectExpr("id", "array(id) AS a"), "t")
        folder = session._WRITTEN[0]
        assert folder.startswith(session.shared_dir(spark)) and df.count() == 10
        assert session.forget(spark) == 1 and not os.path.exists(folder.removeprefix("file:").replace("//", "/")) and not session._WRITTEN
    finally:
        session._WRITTEN[:] = kept


class Stub:
    """As much of a session as the choice of the folder needs."""

    def __init__(self, master, named=None):
        self.conf = self.sparkContext = self
        self.master, self.applicationId, self.named = master, f"app-{master}", named

    def get(self, key, default=None):
        assert key == session.CHECKPOINT_KEY
        return self.named

    def getConf(self):
        return self


def test_the_choice_of_the_folder():
    assert session.shared_dir(Stub("spark://x", "hdfs://shared/")) == "hdfs://shared"
    local = session.shared_dir(Stub("local[2]"))
    assert local.startswith("file:///") and session.shared_dir(Stub("local[2]")) == local
    with pytest.raises(RuntimeError):
        session.shared_dir(Stub("spark://x"))
