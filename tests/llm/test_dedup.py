"""Exact and near duplicates against plain comparisons."""

from __future__ import annotations

import random
import uuid

import brute
import numpy as np
import pytest

from digestmill.llm import ngram_join
from digestmill.llm.components import connected
from digestmill.llm.exact_dedup import drop_duplicates, exact_duplicates
from digestmill.llm.ngram_join import TOccurrence, near_duplicates, one_of_each
from digestmill.llm.shingles import packed, packed_rising, shingle_set, unpacked, unpacked_rising


def texts_with_copies() -> dict[int, str | None]:
    random.seed(5)
    word = lambda: random.choice("abcdefghij") + random.choice("klmnopqrst")
    texts: dict[int, str | None] = {}
    passage = [word() for _ in range(60)]
    bases = [[word() for _ in range(random.choice([3, 4, 5, 6, 12, 40, 90]))] for _ in range(25)] + [[word() for _ in range(80)]] * 12
    for base in bases:
        for _ in range(random.choice([1, 2, 5])):
            words = list(base)
            for _ in range(random.choice([0, 1, 1, 2, 3, 8])):
                words[random.randrange(len(words))] = random.choice("xyz") + str(len(texts))
            words += passage if random.random() < 0.3 else []
            texts[len(texts)] = " ".join(words).upper() if random.random() < 0.3 else " \n".join(words)
    return texts | {1000: None, 1001: "", 1002: " \t", 1003: texts[0], 1004: "one", 1005: "ONE"}


@pytest.mark.parametrize("cell", [1_000_000, 1500, 300])
def test_components_are_those_of_all_pairs(shared, monkeypatch, cell):
    """In one cell and in many; blocks of a few documents, so that tokens meet across blocks."""
    monkeypatch.setattr(ngram_join, "CELL_TOKENS", cell)
    monkeypatch.setattr(ngram_join, "REPRESENTATIVES", 16 if cell > 1000 else 2)
    texts = texts_with_copies()
    frame = shared.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in near_duplicates(frame).collect()} == brute.components(texts)


def test_given_documents(documents):
    want = brute.components({row.doc_id: row.text for row in documents.collect()})
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in near_duplicates(documents).collect()} == want
    assert {row.doc_id for row in one_of_each(documents).collect()} == {component for _, component in want.values()}


def test_search_between_those_that_ask():
    """Pairs of two that do not ask are left out, and what is joined already is not searched."""
    generator = np.random.default_rng(8)
    base = np.unique(generator.integers(0, 2**63, 60, dtype=np.uint64))
    sets = [np.unique(np.r_[base[4:], generator.integers(0, 2**63, 4, dtype=np.uint64)]) for _ in range(12)]
    asks = np.arange(12) == 5
    for label, wanted in ((np.arange(12), 11), (np.where(asks, 5, 0), 1)):
        search = TOccurrence(sets, 80, label, asks)
        assert sorted(search.run()) == ([(0, at) for at in range(1, 12)] if wanted > 1 else [(0, 5)]) and set(search.label.tolist()) == {0}


def test_search_finds_every_component_of_random_sets():
    generator = np.random.default_rng(7)
    for _ in range(60):
        pool = generator.integers(0, 2**63, 60, dtype=np.uint64)
        sets = [np.unique(generator.choice(pool, generator.integers(1, 40))) for _ in range(30)]
        sets += [np.unique(np.r_[one[1:], generator.integers(0, 2**63, 1, dtype=np.uint64)]) for one in sets[:10]]
        search = TOccurrence(sorted(sets, key=len), 80)
        search.run()
        label = search.label
        root = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                one, other = set(search.sets[a].tolist()), set(search.sets[b].tolist())
                if 100 * len(one & other) >= 80 * len(one | other) and root[a] != root[b]:
                    low, high = sorted((root[a], root[b]))
                    root = [low if value == high else value for value in root]
        assert label.tolist() == root


def test_odd_rows(odd):
    got = {(row.doc_id, row.n_shingles, row.component_id) for row in near_duplicates(odd).collect()}
    assert (1, 0, 1) in got and (2, 0, 2) in got and (3, 0, 3) in got and (5, 1, 5) in got and (6, 1, 5) in got and (None, 1, 5) in got and (None, 0, None) in got
    assert near_duplicates(odd).count() == odd.count() and near_duplicates(odd.limit(0)).count() == 0
    exact = {(row.doc_id, row.keep_id, row.group_size, row.kept) for row in exact_duplicates(odd, keep="largest").collect()}
    assert (6, 6, 4, True) in exact and (5, 6, 4, False) in exact and (None, 6, 4, False) in exact and (1, 2, 3, False) in exact and (2, 2, 3, True) in exact
    assert exact_duplicates(odd.limit(0)).count() == 0
    assert sorted(row.doc_id for row in drop_duplicates(odd).collect()) == [1, 3, 4, 5]
    assert sorted(row.doc_id for row in drop_duplicates(odd, "largest").collect()) == [2, 3, 4, 6]
    assert sorted((row.doc_id or 0, row.text or "") for row in one_of_each(odd).collect() if len(row.text or "") < 40) == [(0, ""), (1, ""), (2, ""), (3, " \n\t "), (5, "same text here")]


def test_exactly_one_row_of_a_group_stays(shared):
    """Also where rows repeat an id with another text, repeat both, or have no id; from a frame and from files."""
    text_a, text_b = "a b c d e f g", "one two three four five six seven"
    rows = [(3, text_b), (5, text_a), (5, text_b), (5, text_b), (None, text_b), (None, "null and alone"), (None, "null and alone")]
    frame = shared.createDataFrame(rows, "doc_id int, text string")
    path = f"{shared.sparkContext.getCheckpointDir()}/few-{uuid.uuid4().hex}"
    frame.repartition(3).write.parquet(path)
    want = [(0, "null and alone"), (3, text_b), (5, text_a)]
    for docs in (frame, shared.read.parquet(path)):
        for operator in (drop_duplicates, one_of_each):
            out = operator(docs)
            assert sorted((row.doc_id or 0, row.text) for row in out.collect()) == want and out.columns == docs.columns
    assert sorted((row.doc_id or 0, row.text) for row in drop_duplicates(frame, "largest").collect()) == [(0, "null and alone"), (5, text_a), (5, text_b)]


def test_one_hot_text(shared):
    frame = shared.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'Hot Text' WHEN id % 3 = 1 THEN 'hot text' ELSE concat('t', id) END AS text")
    for keep, best in (("smallest", 0), ("largest", 2998)):
        rows = exact_duplicates(frame, keep, rounds=3).collect()
        assert len(rows) == 3000
        for row in rows:
            hot = row.doc_id % 3 < 2
            assert (row.keep_id, row.group_size) == ((best, 2000) if hot else (row.doc_id, 1))
            assert row.text_sha256 == brute.digest("hot text" if hot else f"t{row.doc_id}")


def test_components_of_shapes(shared):
    path = [(at, at + 1) for at in range(200)]
    star = [(1000, 1000 + at) for at in range(1, 100)]
    frame = shared.createDataFrame(path + star + [(5, 5), (2000, 2001), (2001, 2000)], "a long, b long")
    roots = {}
    for row in connected(frame).collect():
        roots.setdefault(row.root, set()).add(row.node)
    assert sorted(map(sorted, roots.values())) == [list(range(201)), list(range(1000, 1100)), [2000, 2001]]
    assert connected(frame.limit(0)).count() == 0


def test_packing_of_integers():
    values = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (unpacked_rising(packed_rising(values)) == values).all() and (unpacked(packed(values)) == values).all()
    assert len(shingle_set("a b c d")) == 1 and len(shingle_set("")) == 0 and len(shingle_set("a b c d e f")) == 2
