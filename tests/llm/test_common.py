from __future__ import annotations

from pathlib import Path

import pyarrow as pa

from gleanery.llm import common


def test_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "", "b" * 20, "c", "é"])], ["id", "text"])
    got = [(p.column(0).to_pylist(), p.column(1).to_pylist()) for p in common.in_slices([batch, batch.slice(0, 0)], 1, 8)]
    assert [i for ids, _ in got for i in ids] == list(range(6))
    assert [x for _, t in got for x in t] == batch.column(1).to_pylist()
    assert all(len(t) == 1 or sum(len((x or "").encode()) for x in t) <= 8 for _, t in got)


def test_written_tables_can_be_cleared(spark):
    df = common.written(spark.range(5), "five")
    assert df.count() == 5
    folder = Path(common.shared_dir(spark).removeprefix("file:")) / "gleanery"
    assert folder.is_dir()
    common.clear(spark)
    assert not folder.exists()
    common.clear(spark)
