"""Packing: every token once, windows within capacity, little padding."""

from __future__ import annotations

import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from digestmill.llm.packing import differencing, pack_documents, pack_items, text_encoder


def test_differencing_is_a_partition():
    random.seed(9)
    for ways in (1, 2, 5, 16):
        weights = [random.randint(1, 500) for _ in range(60)]
        largest, packed = differencing(weights, ways)
        loads = [sum(weights[item] for item in way) for way in packed]
        assert sorted(item for way in packed for item in way) == list(range(60)) and max(loads) == largest
        assert max(loads) - min(loads) <= max(weights)
    # Differencing ends with the two halves 2 apart here.
    assert differencing([8, 7, 6, 5, 4], 2)[0] == 16


def test_count_rises_when_capacity_is_exceeded():
    windows = pack_items([(at, 0, 60) for at in range(4)], 100)
    assert all(sum(length for _, _, length in window) <= 100 for window in windows)
    covered = sorted((document, start + at) for window in windows for document, start, length in window for at in range(length))
    assert covered == [(document, at) for document in range(4) for at in range(60)]
    assert pack_items([], 100) == []


def pieces_of(frame):
    return [row.asDict() for row in frame.collect()]


def test_given_documents(documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {row.doc_id: row.text or "" for row in documents.collect()}
    ids = {key: np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4") for key, text in texts.items()}
    pieces = pieces_of(pack_documents(documents))
    ends, fill = dict.fromkeys(ids, 0), {}
    for piece in sorted(pieces, key=lambda piece: (piece["doc_id"], piece["start"])):
        tokens = ids[piece["doc_id"]]
        assert piece["start"] == ends[piece["doc_id"]] and piece["doc_tokens"] == len(tokens)
        ends[piece["doc_id"]] += piece["length"]
        assert piece["ids_crc32"] == zlib.crc32(tokens[piece["start"] : ends[piece["doc_id"]]].tobytes())
    assert ends == {key: len(tokens) for key, tokens in ids.items()}
    for piece in sorted(pieces, key=lambda piece: (piece["sequence_id"], piece["offset"])):
        assert piece["offset"] == fill.get(piece["sequence_id"], 0)
        fill[piece["sequence_id"]] = piece["offset"] + piece["length"]
    assert max(fill.values()) <= 2048
    padding = sum(2048 - used for used in fill.values() if used & (used - 1))
    assert padding <= 0.05 * sum(map(len, ids.values()))


def test_odd_rows(odd):
    pieces = pieces_of(pack_documents(odd))
    assert sum(piece["start"] == 0 for piece in pieces) == odd.count()
    assert sum(piece["length"] for piece in pieces if piece["doc_id"] == 1) == 1
    assert pack_documents(odd.limit(0)).count() == 0
    assert {piece["length"] for piece in pieces_of(pack_documents(odd.filter("doc_id = 5"), capacity=2))} <= {1, 2}


def test_cache_of_a_worker_stays_small():
    """Words that hardly repeat are not all kept: a worker outlives its stage."""
    tokens = text_encoder(public_tokenizers.path("byte_bpe_50k.json"), 1)
    tracemalloc.start()
    try:
        for start in range(0, 500_000, 1000):
            tokens(" ".join(f"w{number}x" for number in range(start, start + 1000)))
        assert tracemalloc.get_traced_memory()[0] < 50e6
    finally:
        tracemalloc.stop()
