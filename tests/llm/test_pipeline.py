"""The stages against a plain version, on the smallest tables."""

from __future__ import annotations

import brute
import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from digestmill.llm import rows
from digestmill.llm.quality_rules import quality_rules
from digestmill.llm.rows import numbered_rows
from digestmill.llm.secrets import STRONG, masked

SF = "/root/testdata/sf0.001"


def test_stages(shared, documents):
    kept, frame = {}, documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(shared, frame, SF)
        assert out.columns == documents.columns and out.dtypes == documents.dtypes
        out = shared.createDataFrame(out.collect(), documents.schema)
        kept[name] = {row.doc_id: row.text for row in out.collect()}
        frame = out
    good = {row.doc_id for row in quality_rules(documents).filter("kept").collect()}
    assert set(kept["quality rules"]) == good
    first = {}
    for doc_id, text in sorted(kept["quality rules"].items()):
        first.setdefault(text.encode().lower(), doc_id)
    assert set(kept["exact dedup"]) == set(first.values())
    components = brute.components(kept["exact dedup"])
    assert set(kept["n-gram Jaccard join"]) == {component for _, component in components.values()}
    texts = kept["n-gram Jaccard join"]
    assert kept["secret scan"] == {doc_id: masked(text, "[secret]", STRONG) for doc_id, text in texts.items()}
    pieces = corpus_pipeline.STAGES[-1][1](shared, frame, SF).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(text, add_special_tokens=False).ids) + 1 for text in kept["secret scan"].values())
    assert sum(piece.length for piece in pieces) == want


def test_run(shared):
    rows = corpus_pipeline.run(shared, SF)
    assert rows.count() > 100 and {"doc_id", "sequence_id", "offset"} <= set(rows.columns)


def test_stages_take_odd_rows(shared, odd):
    for name, stage in corpus_pipeline.STAGES:
        # No row of the odd ones passes the quality rules.
        assert (stage(shared, odd, SF).count() > 0) == (name != "quality rules")
        assert stage(shared, odd.limit(0), SF).count() == 0


def test_rows_are_numbered_without_workers(documents, monkeypatch):
    """The list of files reaches Spark without an RDD of Python rows, whose workers would stay on every executor."""

    def refused(*_, **__):
        raise AssertionError("rows of Python were handed to Spark")

    monkeypatch.setattr(type(documents.sparkSession.sparkContext), "parallelize", refused)
    numbers = [row["number"] for row in numbered_rows(documents, "number").select("number").collect()]
    assert len(set(numbers)) == len(numbers) == documents.count()


def test_workers_give_memory_back(shared):
    """Between tasks a worker holds little of the batches it has read, as the same worker serves the next stage."""

    def kept(batches):
        import pyarrow as pa

        for batch in rows.released(batches):
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    calls = []

    class Pool:
        def release_unused(self):
            calls.append(1)

    table = shared.range(10).mapInArrow(kept, "n long")
    assert sum(row["n"] for row in table.collect()) == 10
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rows.pa, "default_memory_pool", Pool)
        assert list(rows.released(iter("abc"))) == ["a", "b", "c"] and len(calls) == 3
