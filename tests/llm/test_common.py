import pyarrow as pa
import pytest

from boreal.llm import common


class Far:
    """A session of a cluster, as far as shared_dir looks."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "spark://host:7077"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Far)


def test_slices_by_size():
    texts = ["ab", None, "", "x" * 25, "y", "é" * 4, "z" * 9] * 3
    got = list(common.by_size([pa.RecordBatch.from_pydict({"k": list(range(21)), "t": texts})], "t", rows=5, size=10))
    assert [k for b in got for k in b.column("k").to_pylist()] == list(range(21))
    for b in got:
        sizes = sorted(len((t or "").encode()) for t in b.column("t").to_pylist())
        assert b.num_rows <= 5 and sum(sizes[:-1]) <= 10
    assert list(common.by_size([pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})], "t")) == []
