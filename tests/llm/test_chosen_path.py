"""The chosen-path join against comparisons of all pairs."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from digestmill.llm import chosen_path
from digestmill.llm.chosen_path import LEAST_ALIKE, POSITIONS, minwise, near_documents, sketch
from digestmill.llm.shingles import shingle_set


def families() -> dict[int, str | None]:
    """Families of near copies of many sizes, one of them large, beside texts of their own."""
    draw = random.Random(11)
    word = lambda: draw.choice("abcdefghijklm") + draw.choice("nopqrstuvwxyz") + draw.choice("aeiou")
    texts: dict[int, str | None] = {}
    for size in [1] * 60 + [2] * 20 + [5] * 6 + [30, 90]:
        base = [word() for _ in range(draw.choice([2, 5, 30, 60, 120]))] if size < 90 else [word() for _ in range(80)]
        for _ in range(size):
            words = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3, 5, 8])):
                words[draw.randrange(len(words))] = f"x{len(texts)}y{draw.randrange(99)}"
            texts[len(texts)] = " ".join(words).upper() if draw.random() < 0.3 else "\n ".join(words)
    return texts | {5000: None, 5001: "", 5002: " \t", 5003: texts[0], 5004: "one", 5005: "ONE", 5006: "one two"}


@pytest.mark.parametrize(("node", "cell"), [(64, 2_000), (4, 2_000), (4, 12)])
def test_components_are_those_of_all_pairs(shared, monkeypatch, node, cell):
    """With small nodes, so that trees are deep, and with clusters of many cells."""
    monkeypatch.setattr(chosen_path, "NODE", node)
    monkeypatch.setattr(chosen_path, "CELL_DOCUMENTS", cell)
    monkeypatch.setattr(chosen_path, "REPRESENTATIVES", 3 if cell < 100 else 32)
    texts = families()
    frame = shared.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {row.doc_id: (row.n_shingles, row.component_id) for row in near_documents(frame).collect()}
    assert got == brute.components(texts, 2)


def test_given_documents(documents):
    want = brute.components({row.doc_id: row.text for row in documents.collect()}, 2)
    rows = near_documents(documents).collect()
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in rows} == want
    assert all(row.kept == (row.doc_id == row.component_id) for row in rows)


def test_odd_rows(odd):
    rows = near_documents(odd).collect()
    got = {(row.doc_id, row.n_shingles, row.component_id, row.kept) for row in rows}
    assert len(rows) == odd.count() and near_documents(odd.limit(0)).count() == 0
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 2, 5, True), (6, 2, 5, False), (None, 2, 5, False), (None, 0, None, True)} <= got


def test_repeated_ids_are_judged_by_their_texts(shared):
    rows = [(3, "b b c d e f"), (5, "a lone text of its own"), (5, "b b c d e f")]
    got = sorted((row.doc_id, row.n_shingles, row.component_id) for row in near_documents(shared.createDataFrame(rows, "doc_id int, text string")).collect())
    assert got == [(3, 5, 3), (5, 5, 3), (5, 5, 5)]


def test_sketches_tell_similarity():
    generator = np.random.default_rng(2)
    kept = 0
    for _ in range(300):
        base = generator.integers(0, 2**63, 400, dtype=np.uint64)
        other = np.unique(np.r_[base[:356], generator.integers(0, 2**63, 44, dtype=np.uint64)])  # 0.802
        differing = np.bitwise_count(sketch(minwise(np.unique(base))) ^ sketch(minwise(other))).sum()
        kept += POSITIONS - differing >= LEAST_ALIKE
    assert kept == 300
    one, two = (sketch(minwise(shingle_set(" ".join(f"{name}{k}" for k in range(300)), 2))) for name in "ab")
    assert POSITIONS - np.bitwise_count(one ^ two).sum() < LEAST_ALIKE


def test_links_of_a_tight_node_grow_with_its_documents(shared, tmp_path):
    """Forty near copies meet in a few nodes; what is handed on connects them without being all their pairs."""
    base = [f"w{n}" for n in range(200)]
    frame = shared.createDataFrame([(n, " ".join([*base, f"own{n}"])) for n in range(40)], "doc_id long, text string").coalesce(1)
    marks = chosen_path.set_marks(frame, 2).selectExpr("doc_id AS node", "n_shingles AS n", "sketch_a", "sketch_b", "tokens")
    links = chosen_path.candidates(marks, str(tmp_path / "links"), 80, 2)
    assert chosen_path.connected(links).select("root").distinct().count() == 1
    assert links.count() <= 40 * 2 * 2


def near_copies(count: int, own: int) -> list[tuple[int, str]]:
    """Texts that share a passage, and each have ``own`` words that nobody else has."""
    base = [f"w{n}" for n in range(120)]
    return [(n, " ".join([*base, *(f"own{n}x{k}" for k in range(own))])) for n in range(count)]


def test_rows_of_deep_levels_are_made_once(shared, monkeypatch, tmp_path):
    """A large open node costs its documents once a level: no join makes rows again for each level above."""
    monkeypatch.setattr(chosen_path, "NODE", 4)
    joins = []
    frame = shared.createDataFrame(near_copies(60, 70), "doc_id long, text string")
    marks = chosen_path.set_marks(frame, 2).selectExpr("doc_id AS node", "n_shingles AS n", "sketch_a", "sketch_b", "tokens")
    kind = type(marks)
    join = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, on=None, how=None: joins.append(how) or join(self, other, on, how))
    chosen_path.candidates(marks, str(tmp_path / "levels"), 80, 3)
    levels = sorted(tmp_path.glob("levels/level-*/rows"))
    assert len(levels) > 2 and "left_semi" not in joins
    sizes = [shared.read.parquet(str(path)).count() for path in levels]
    assert max(sizes) <= 60 * 3 * 1.25 ** len(levels) + 60


@pytest.mark.parametrize("most", [0, 40, 1_000_000])
def test_many_open_paths_are_joined(shared, monkeypatch, most):
    """Beyond the bound of the broadcast the levels go on from written rows, with the same classes."""
    monkeypatch.setattr(chosen_path, "NODE", 4)
    monkeypatch.setattr(chosen_path, "MOST_BROADCAST", most)
    texts = families()
    frame = shared.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {row.doc_id: (row.n_shingles, row.component_id) for row in near_documents(frame).collect()} == brute.components(texts, 2)
