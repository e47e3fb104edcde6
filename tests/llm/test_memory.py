"""What Python workers and executors keep from stage to stage."""

import pytest

from tests.llm.helpers import odd_docs
from tidemark.llm import common as cm
from tidemark.llm import packing as pk

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def count_encoders():
    """A task's function that gives the number of packing's encoders that its worker holds."""

    def run(batch):
        import gc

        import pyarrow as pa

        n = sum(type(x).__name__ == "WordBpe" for x in gc.get_objects())
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return run


def test_a_worker_lets_the_tokenizer_go(spark):
    docs = odd_docs(spark).repartition(16)
    assert pk.pieces_of(docs).count() > 0
    held = cm.arrow_map(spark.range(0, 16, 1, 16), count_encoders, "n long").collect()
    assert len(held) == 16 and not any(r["n"] for r in held)


def test_one_stage_keeps_its_tokenizer(monkeypatch):
    monkeypatch.setattr(cm, "KEPT", {})
    made = []
    ask = lambda: cm.kept("a", lambda: made.append(1) or object())
    first = cm.begun(ask)
    assert cm.begun(ask) is first and made == [1]
    cm.begun(object)
    assert cm.KEPT == {}


def test_stages_collect_the_executors_garbage(spark, data):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    corpus_pipeline.packing(spark, odd_docs(spark).limit(2), data)
    assert full() > before
