"""What a Python worker holds while Spark hands it from one operator's tasks to the next one's."""

import tracemalloc
import weakref
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import bytebpe, packing, queries, simhash, toxicity

EMPTY = toxicity.Scorer(np.zeros(0, np.int64), np.zeros(0), -50.0)
BEGIN = {
    "toxicity": lambda: toxicity._scores(iter(()), EMPTY),
    "signatures": lambda: simhash._signed(iter(()), 5),
    "keys": lambda: simhash._with_key(iter(())),
    "sets": lambda: simhash._sets(iter(()), 5),
}


@pytest.mark.parametrize("name", BEGIN)
def test_an_encoder_does_not_stay_beside_another_operators_work(name):
    path = queries.tokenizer_path()
    kept = weakref.ref(packing.encoder(path))
    assert kept() is packing.encoder(path)
    list(BEGIN[name]())
    assert kept() is None


def test_one_encoder_at_a_time():
    kept = weakref.ref(packing.encoder(queries.tokenizer_path()))
    assert bytebpe.encoder(queries.byte_tokenizer_path()) is bytebpe.encoder(queries.byte_tokenizer_path())
    assert kept() is None


@pytest.mark.parametrize("keep_ids", [False, True])
def test_a_shard_is_not_held_twice(monkeypatch, keep_ids):
    """Short pieces cost their ids and numbers, not an array each; without `keep_ids` no piece is kept."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    monkeypatch.setattr(packing, "encoder", lambda path: lambda text: np.arange(2, int(text) + 2, dtype="<u4").tobytes())
    lengths = [500_000 + n for n in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(map(str, lengths))], ["doc_id", "text"])
    tracemalloc.start()
    (got,) = packing._pack_partition(iter([batch]), "", 2048, 1 << 40, 1 << 40, keep_ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(got["length"].to_pylist()) == sum(lengths) + 8
    if keep_ids:
        assert got.schema.field("ids").type == pa.list_(pa.int32())
        for row in got.to_pylist():
            whole = [*range(2, lengths[row["doc_id"]] + 2), packing.END_ID]
            assert row["ids"] == whole[row["start"] : row["start"] + row["length"]]
    ids = 4 * sum(lengths)
    assert most < (3.4 if keep_ids else 1.7) * ids, f"{most / ids:.2f} times the ids"


def test_clean_sends_a_text_once(spark, capsys):
    rows = spark.createDataFrame([(1, "fine words", "x"), (2, None, None), (None, "", "y")], "doc_id long, text string, other string")
    got = toxicity.clean(rows, EMPTY)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect())) and got.columns == rows.columns
    got.explain()
    assert "_text" not in capsys.readouterr().out
    assert toxicity.clean(rows.withColumn("text", rows.text.cast("binary")), EMPTY).count() == 3
