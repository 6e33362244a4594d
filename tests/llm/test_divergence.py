"""Source divergence against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.ml.feature import CountVectorizer

from digestmill.llm.divergence import kept_terms, language_terms, share, source_divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least: int, most: int) -> set[tuple]:
    documents, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall((text or "").translate(UPPER))
        documents[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = set()
    for (lang, source), own in counts.items():
        kept = sorted(term for term, n in documents[lang].items() if n >= least)

        def shares(count, kept=kept):
            total = sum(count[term] for term in kept)
            return {term: 1 + 10**9 * (count[term] + 5) // (total + 5 * len(kept)) for term in kept}

        mine = shares(own)
        pairs = []
        for (other_lang, other), count in counts.items():
            if other_lang == lang and other != source:
                theirs = shares(count)
                pairs.append((sum(abs(mine[term] - theirs[term]) for term in kept), other))
        whole = shares(sum((count for (other_lang, _), count in counts.items() if other_lang == lang), Counter()))
        terms = [(mine[term] - whole[term], term) for term in kept if own[term] and mine[term] > whole[term]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda item: (-item[0], item[1].encode()))
            out |= {(lang, source, part, item, value, rank) for rank, (value, item) in enumerate(found, 1) if part == "pair" or rank <= most}
    return out


@pytest.mark.parametrize("slice_terms", [2_000_000, 12])
def test_equals_plain_counting(shared, slice_terms):
    """With one slice of the vocabulary and with several."""
    draw = random.Random(3)
    words = ["The", "the", "zwölf", "été", "a", "b7b", "日本", "x_y", "Q", "K", "\U0001f600z"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ,".join(draw.choices(words, k=draw.randrange(12))), draw.choice(["en", "en", "de", None, "", "few"]), draw.choice(["a", "b", "c", None, "Ä"])) for _ in range(300)]
    rows += [(None, "en", "empty"), ("", "none", "a"), ("lone words", "none", "b"), rows[0], rows[0]]
    frame = shared.createDataFrame([(*row, "x", 1) for row in rows], "text string, lang string, source string, term string, rank int")
    got = {tuple(row) for row in source_divergence(frame, least=10, most_terms=4, slice_terms=slice_terms).collect()}
    assert got == plain(rows, 10, 4)


def test_empty_and_null(shared, odd):
    assert source_divergence(odd.limit(0)).count() == 0
    rows = source_divergence(odd).collect()
    assert rows and all(row.part == "pair" and row.value == 0 for row in rows)


def test_shares_are_exact_beyond_64_bits(shared):
    n, total, terms = 9 * 10**15 + 7, 9 * 10**16 + 11, 10**9
    frame = shared.createDataFrame([(n, total, terms)], "n long, total long, v long")
    assert frame.select(share("n", "total", "v")).first()[0] == 1 + 10**9 * (n + 5) // (total + 5 * terms)


def test_kept_terms_are_the_vocabulary_of_the_library(documents):
    """By language, as CountVectorizer fits it with the same least number of documents."""
    terms = language_terms(documents.selectExpr("lang", "source", "text"))
    kept = {tuple(row.term.split("\0")) for row in kept_terms(terms, 30).collect()}
    for (lang,) in documents.select("lang").distinct().collect():
        own = terms.filter(terms.lang == lang)
        model = CountVectorizer(inputCol="terms", outputCol="v", minDF=30.0, vocabSize=2**31 - 1).fit(own)
        assert {term.split("\0")[1] for term in model.vocabulary} == {term for of, term in kept if of == lang}
