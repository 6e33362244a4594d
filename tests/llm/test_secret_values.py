"""Secrets in a credential context: whole values, and prose left alone."""

from __future__ import annotations

import random
import string

import pytest

from digestmill.llm import secrets
from digestmill.llm.rows import largest

BASE64 = string.ascii_letters + string.digits + "+/"


def guessed(text: str, **options) -> list[str]:
    return [text[start:end] for kind, start, end in secrets.find_secrets(text, **options) if kind == "guess"]


@pytest.mark.parametrize("cue", ["private_key: ", "auth=", "credential=", "pwd=", "password="])
@pytest.mark.parametrize("size", [6, 127, 128, 129, 800, 20_000])
def test_values_are_found_whole(cue, size):
    random.seed(size)
    value = "".join(random.choice(BASE64) for _ in range(size - 1)) + "k"
    if cue == "password=":
        value = value[: size // 2] + "#" + value[size // 2 + 1 :]
    assert guessed(f"see {cue}{value} end") == [value]


def test_long_values_are_masked_whole(shared):
    random.seed(5)
    value = "".join(random.choice(BASE64) for _ in range(800))
    frame = shared.createDataFrame([(1, f"private_key: {value} end"), (2, "pwd=" + "=" * 5000 + " end")], "doc_id long, text string")
    assert {row.doc_id: row.text for row in secrets.without_secrets(frame).collect()} == {1: "private_key: [secret] end", 2: "pwd=" + "=" * 5000 + " end"}
    spans = {row.doc_id: [(span.start, span.end) for span in row.spans] for row in secrets.secrets(frame).collect()}
    assert spans == {1: [(13, 813)], 2: []}


PROSE = ["when all was revealed at last we saw", "it was revealed a second time", "their friendship lasted", "a second friendship", "für Entschuldigungsgründe hier", "keine Entschuldigungsgründe"]
CLEAN = ["the secret is revealed", "auth: second", "pass: friendship", "pass: Entschuldigungsgründe"]


def test_clean_prose_after_a_cue_is_left_alone(shared):
    rows = list(enumerate([*PROSE, *CLEAN, "pwd is xkvqmvlptj end", "credential=xkvqmvlptj"]))
    frame = shared.createDataFrame(rows, "doc_id long, text string")
    words = secrets.learn_words(frame)
    assert {"revealed", "second", "friendship", "entschuldigungsgr"} <= set(words) and "xkvqmvlptj" not in words
    out = [row.text for row in secrets.without_secrets(frame).orderBy("doc_id").collect()]
    assert out == [*PROSE, *CLEAN, "pwd is [secret] end", "credential=[secret]"]
    spans = {row.doc_id: row.spans for row in secrets.secret_digests(frame).collect()}
    assert [doc_id for doc_id in sorted(spans) if spans[doc_id]] == [10, 11]
    assert {row.doc_id for row in secrets.secrets(frame).collect() if row.spans} == {10, 11}


def test_words_are_ranked_by_documents(shared):
    frame = shared.createDataFrame([(1, "Rare rare rare common"), (2, "COMMON other"), (3, "common, other ab/common+x1common"), (4, None)], "doc_id long, text string")
    assert secrets.learn_words(frame) == ("common", "other") and secrets.learn_words(frame, most=1) == ("common",)
    costs = [secrets.guess_cost(word, secrets.GuessCosts(["common", "other"]))[0] for word in ("common", "other", "rarely")]
    assert costs == sorted(costs) and costs[1] < 1 < secrets.STRONG < costs[2]


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ('password: "correct horse battery staple" end', '[secret]" end'),
        ('pwd="xK9 mQ2vL7pZ8" x', 'pwd="[secret]" x'),
        ("auth = 'Zq 8! kR \u00e4 4w' and", "auth = '[secret]' and"),
        ('{"token": "a b 9Kx.Lw, 7q"}', '{"token": "[secret]"}'),
        ('pwd="xK9 mQ2vL7pZ8\nno end', 'pwd="xK9 mQ2vL7pZ8\nno end'),
        ('pass: "password 1" x', 'pass: "password 1" x'),
    ],
)
def test_values_in_quotes_are_masked_whole(text, masked):
    assert secrets.masked(text, "[secret]", secrets.STRONG, None) == masked


def test_the_words_of_most_documents_come_back(shared):
    """More words than wanted with equal counts, and more distinct counts than a histogram has parts."""
    frame = shared.range(3000).selectExpr("concat('w', translate(cast(id AS string), '0123456789', 'abcdefghij')) AS word", "2 + (id div 2) AS n", "id AS rank")
    for most in (0, 1, 7, 100, 2999, 5000):
        assert [row.rank for row in largest(frame, "rank", most)] == list(range(2999, max(-1, 2999 - most), -1))
    assert largest(frame.limit(0), "rank", 5) == []
    text = shared.range(600).selectExpr("concat('common ', translate(cast(id div 2 AS string), '0123456789', 'abcdefghij'), 'xyz') AS text")
    words = secrets.learn_words(text, most=50)
    assert len(words) == 50 and words[0] == "common" and list(words[1:]) == sorted(words[1:])
