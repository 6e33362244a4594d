"""Phrase mining against plain counting, and the parse."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from digestmill.llm import phrases
from digestmill.llm.phrases import chunks, collocations, parse, pieces

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text: str | None) -> list[list[str]]:
    parts = re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER))
    return [words for words in (re.findall(r"[^\x20\x09]+", part) for part in parts) if words]


def plain(rows, least: int, most: int) -> list[tuple]:
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        for words in split(text):
            totals[lang or "und"] += len(words)
            counts[lang or "und"].update(tuple(words[at : at + size]) for size in (1, 2, 3, 4) for at in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        kept = []
        for gram, a in found.items():
            if len(gram) < 2 or a < least:
                continue
            longer = [n for other, n in found.items() if len(other) > len(gram) and any(other[at : at + len(gram)] == gram for at in range(len(other)))]
            if any(n >= least and 100 * n >= 80 * a for n in longer):
                continue
            score, k = min((2_000_000 * a // (found[gram[:k]] + found[gram[k:]]), k) for k in range(1, len(gram)))
            kept.append((-score, -a, " ".join(gram).encode(), gram, found[gram[:k]], found[gram[k:]]))
        for rank, (score, a, _, gram, left, right) in enumerate(sorted(kept)[:most], 1):
            out.append((lang, rank, " ".join(gram), -a, left, right, totals[lang], -score))
    return sorted(out)


def some_rows() -> list[tuple[str | None, str | None]]:
    draw = random.Random(4)
    words = ["The", "of", "été", "a", "x-y", " ", "New", "York", "City", "\x0e", "日本"]
    passage = "New York City of the,  New\tYork. City the of a a a a a a a a x-y\n" * 2
    rows = [(draw.choice(["en", "de", None]), " ".join(draw.choice([word, word + draw.choice(",.\n")]) for word in draw.choices(words, k=draw.randrange(25)))) for _ in range(300)]
    return rows + [("en", passage)] * 40 + [("en", None), ("de", ""), ("few", "one two"), ("en", " \t ,,. ")]


def test_equals_plain_counting(shared, monkeypatch):
    """Whatever the bitmap holds: one of 64 bits lets everything pass."""
    rows = some_rows()
    frame = shared.createDataFrame([(*row, "x", 1) for row in rows], "lang string, text string, phrase string, n int").repartition(4)
    want = plain(rows, 5, 25)
    assert len(want) > 40 and max(row[1] for row in want) == 25 and sorted(map(tuple, collocations(frame, least=5, most=25).collect())) == want
    monkeypatch.setattr(phrases, "BITMAP_BITS", 64)
    assert sorted(map(tuple, collocations(frame, least=5, most=25).collect())) == want


def test_chunks_hold_each_phrase_once():
    draw = random.Random(9)
    text = " ".join(draw.choice("abcdefgh") + draw.choice("xyz") + draw.choice(["", "", "", "", "", "."]) for _ in range(3000)) + " " + "w " * 300
    found, want = Counter(), Counter()
    parsed = list(zip(*chunks(text), strict=True))
    for chunk, starts in parsed:
        words = chunk.split(b" ")
        found.update(tuple(words[at : at + size]) for size in (1, 2, 3, 4) for at in range(starts) if at + size <= len(words))
    for words in pieces(text):
        want.update(tuple(words[at : at + size]) for size in (1, 2, 3, 4) for at in range(len(words) - size + 1))
    assert found == want and len(parsed) > len(pieces(text))


def test_same_content_is_cut_alike(shared):
    passage = " ".join(f"word{at}" for at in range(400))
    frame = shared.createDataFrame([("en", f"start{at} {passage} end{at}") for at in range(50)], "lang string, text string")
    dictionary = parse(frame).collect()
    assert sum(row.parsed > 1 for row in dictionary) > 10 and len(dictionary) < 50 * 4


def test_odd_rows(odd):
    assert collocations(odd.limit(0)).count() == 0
    rows = collocations(odd).collect()
    assert [(row.lang, row.phrase, row.a, row.n) for row in rows] == [("en", "word word word word", 29997, 30001 + 12)] and collocations(odd, least=10**6).count() == 0
