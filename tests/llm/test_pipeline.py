"""The pipeline's stages, each on its own input, and the whole against plain Python where that is possible."""

import pytest

from tests.llm.test_sets import slow_components, word_sets
from tests.llm.test_tokens import packed_well
from tidemark.llm.common import stored, table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, data), name)
        assert docs.columns == COLUMNS
        old, new = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (before, docs))
        assert set(new) <= set(old)
        if name in ("toxicity", "quality"):
            assert 0.5 * len(old) < len(new) < len(old) and all(old[i] == t for i, t in new.items())
        if name == "near_dedup":
            want = slow_components(word_sets(old.items()))
            assert set(new) == {i for i, c in want.items() if i == c}
        if name == "pii":
            assert set(new) == set(old)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    packed_well(rows, 2048)
    assert {r["doc_id"] for r in rows} == set(new)


def test_run_and_empty(spark, data, tmp_path):
    assert corpus_pipeline.run(spark, data).count() > 0
    for t in ("documents", "labels"):
        table(spark, data, t).filter("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
