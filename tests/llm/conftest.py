"""Helpers of the tests of the training-data operators."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    """The session with a folder for checkpoints, which a cluster names itself."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


@pytest.fixture
def documents(shared):
    return shared.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def odd(shared):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like results."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string, score string, spans string, shard string"
    extra = ("x", "x", "x", "x", "x")
    long_text = "word " * 30000 + "a" * 50000
    rows = [
        (1, None, None, None, None, *extra), (2, "", "en", "a", 0, *extra), (3, " \n\t ", "en", "a", 4, *extra), (4, long_text, "en", "b", 1, *extra),
        (5, "same text here", "en", "b", 1, *extra), (5, "same text here", "en", "b", 1, *extra), (6, "Same TEXT here", "en", None, 1, *extra),
        (None, "same text here", "en", "b", 1, *extra), (None, None, None, None, None, *([None] * 5)),
    ]
    return shared.createDataFrame(rows, schema)
