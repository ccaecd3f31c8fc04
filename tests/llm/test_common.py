import os

import pytest

from broadsheet.llm import common


def test_scratch_tables(spark):
    df = common.stored(spark.range(3), "t")
    path = common._WRITTEN[-1].removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path) and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()
    assert common.stored(spark.range(0), "t").count() == 0
    common.release(spark)
    assert not os.path.exists(path) and not common._WRITTEN


def test_configured_scratch_folder(spark, monkeypatch, tmp_path):
    class Conf:
        def get(self, key, default=None):
            return f"file://{tmp_path}/shared/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert common.scratch_root(Session()) == f"file://{tmp_path}/shared"


def test_no_local_folder_on_a_cluster():
    class Session:
        def __init__(self, master):
            self.conf = {"spark.master": master}

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.scratch_root(Session(master))
    for master in ("local", "local[4]", "local[*]"):
        assert common.scratch_root(Session(master)).startswith("file:///")


def test_whole_keys():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"k": [1, 1, 2, 2, 2, 3, 4, 4]})
    for size in (1, 3, 100):
        for step in (1, 2, 8):
            tables = list(common.whole_keys((rows.slice(i, step) for i in range(0, 8, step)), "k", size))
            assert [x for t in tables for x in t["k"].to_pylist()] == rows["k"].to_pylist()
            groups = [set(t["k"].to_pylist()) for t in tables]
            assert all(not a & b for i, a in enumerate(groups) for b in groups[:i])
    rows = pa.RecordBatch.from_pydict({"k": [1, 1, 1, 2, 2], "s": [0, 0, 1, 1, 1]})
    tables = list(common.whole_keys((rows.slice(i, 1) for i in range(5)), "k", 1, "s"))
    assert [t["k"].to_pylist() for t in tables] == [[1, 1], [1], [2, 2]]


def test_batches_are_bounded(spark):
    common.bounded_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == 4 << 20
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20)
    common.bounded_batches(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == 1 << 20
