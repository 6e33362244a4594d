"""Personal data and secrets against plain regular expressions."""

from __future__ import annotations

import random
import re
from math import log10

import brute
import pytest

from digestmill.llm import pii, secrets
from digestmill.llm.secrets import guess_cost

PIECES = ["password", "TOKEN", "api_key", "apikey", "secret", " ", "=", ":", "'", '"', "abc", "1234567", "AKIA", "ABCDEF0123456789XYZ", "0123456789abcdef", "f", "é", "ſecret", "\n", "passwd"]


def base(spans, kinds):
    return [span for span in spans if span[0] in kinds]


def test_personal_data_on_random_strings():
    random.seed(3)
    for _ in range(40_000):
        text = "".join(random.choice("01 2.-+@ab.A(4") for _ in range(random.randint(0, 30)))
        assert base(pii.find_personal_data(text), pii.BASE_KINDS) == brute.personal_data(text), text


def test_secrets_on_random_strings():
    random.seed(4)
    for _ in range(20_000):
        text = "".join(random.choice(PIECES) for _ in range(random.randint(0, 9)))
        assert base(secrets.find_secrets(text), secrets.BASE_KINDS) == brute.secrets(text), text


@pytest.mark.parametrize("text", ["1." * 5000 + "1", "1 " * 5000, "a@" * 3000, "+1" * 3000, "+1 " + "(" * 5000, "0" * 9000 + ".1.1.1", "password=" * 2000])
def test_long_runs(text):
    assert base(pii.find_personal_data(text), pii.BASE_KINDS) == brute.personal_data(text)
    assert base(secrets.find_secrets(text), secrets.BASE_KINDS) == brute.secrets(text)


def test_queries_follow_the_plain_versions(documents, odd):
    from digestmill.llm.queries import QUERIES

    for frame in (documents, odd):
        texts = {row.doc_id: row.text or "" for row in frame.filter("doc_id IS NOT NULL").collect()}
        for row in pii.personal_data_digests(frame).filter("doc_id IS NOT NULL").collect():
            spans = brute.personal_data(texts[row.doc_id])
            counts = tuple(sum(span[0] == kind for span in spans) for kind in pii.BASE_KINDS)
            assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == counts
            assert row.base_sha256 == brute.digest(brute.listed(spans)) and set(brute.listed(spans).split(",")) <= {*row.spans.split(","), ""}
        for row in secrets.secret_digests(frame).filter("doc_id IS NOT NULL").collect():
            spans = brute.secrets(texts[row.doc_id])
            assert (row.n_assign, row.n_access, row.n_hex) == tuple(sum(span[0] == kind for span in spans) for kind in secrets.BASE_KINDS)
            assert row.base_sha256 == brute.digest(brute.listed(spans)) and set(brute.listed(spans).split(",")) <= {*row.spans.split(","), ""}
        assert pii.personal_data(frame).count() == secrets.secrets(frame).count() == frame.count()
    assert {"op3_personal_data", "op4_secret_scan"} <= set(QUERIES)


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("Account no. 12345678 closed", "account", "12345678"),
        ("IBAN: DE89 3704 0044 0532 0130 00, please", "iban", "DE89 3704 0044 0532 0130 00"),
        ("at https://joe:pw1@host.example/x", "login", "joe:pw1"),
        ("accounts 12345678", "account", None),
        ("account of the year", "account", None),
        ("IBAN DE88 3704 0044 0532 0130 00", "iban", None),
        ("https://host.example/x", "login", None),
    ],
)
def test_added_spans(text, kind, found):
    spans = [text[start:end] for name, start, end in pii.find_personal_data(text) if name == kind]
    assert spans == ([found] if found else [])


def cheapest(value: str, words: dict[str, float]) -> float:
    """The guess cost by trying every cut of a short value into segments of every kind."""
    leet = value.lower().translate(str.maketrans("013457@$!", "oieastasi"))
    char = log10(max(10, 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)))
    rows = ["1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm"]

    def kinds(start: int, end: int):
        piece, size = value[start:end], end - start
        yield "brute", char * size
        if leet[start:end] in words:
            changed = 1 + (leet[start:end] != piece.lower()) + (piece != piece.lower())
            yield "word", words[leet[start:end]] + log10(changed)
        if re.fullmatch(r"(19|20)\d\d", piece):
            yield "date", log10(120)
        if re.fullmatch(r"(19|20)\d\d[-/.]?(0[1-9]|1[0-2])([-/.]?(0[1-9]|[12]\d|3[01]))?|(0[1-9]|[12]\d|3[01])[-/.]?(0[1-9]|1[0-2])[-/.]?((19|20)?\d\d)", piece):
            yield "date", log10(120) if size == 4 else log10(365 * 120)
        if size >= 3 and len(set(piece)) == 1:
            yield "repeat", char + log10(size)
        if size >= 3 and all(any(pair in row or pair[::-1] in row for row in rows) for pair in (piece.lower()[at : at + 2] for at in range(size - 1))):
            yield "walk", log10(72) + log10(size)

    def least(start: int, before: str) -> float:
        if start == len(value):
            return 0.0
        return min(
            cost + (log10(2) if start and not before == kind == "brute" else 0.0) + least(end, kind)
            for end in range(start + 1, len(value) + 1) for kind, cost in kinds(start, end)
        )

    return least(0, "")


def test_guess_cost_is_the_least_of_all_cuts():
    draw = random.Random(6)
    pieces = ["pass", "Love", "k3y", "1990", "12", "aaa", "aa", "qwe", "ewq", "0", "x", "T", "-", "31", "01", "zxc", "m", "10", "9", "$"]
    costs = secrets.GuessCosts()
    for value in ["1990000", "passsss", "qweeee", "20200101", *("".join(draw.choices(pieces, k=draw.randrange(1, 5)))[:8] for _ in range(400))]:
        assert abs(guess_cost(value)[0] - cheapest(value, costs.words)) < 1e-9, value


def test_guess_cost_prefers_patterns():
    order = ["password", "aaaaaaaa", "qwertyuiop", "20240131", "xk9mqvlp", "xK9#mQ2$vL7p"]
    costs = [guess_cost(value)[0] for value in order]
    assert costs == sorted(costs) and costs[3] < secrets.STRONG <= costs[4]
    assert [segment[0] for segment in guess_cost("hunter1987qwerty")[1]] == ["word", "date", "walk"]
    for value in order:
        segments = guess_cost(value)[1]
        assert segments[0][1] == 0 and segments[-1][2] == len(value) and all(a[2] == b[1] for a, b in zip(segments, segments[1:], strict=False))


def test_guess_spans_and_masking(shared):
    rows = [(1, "pwd is xK9#mQ2$vL7p ok", 22), (2, "password: password1", 19), (3, None, None), (4, 'token = "0123456789abcdef0123456789abcdef"', 40), (5, "", 0)]
    frame = shared.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kinds = {row.doc_id: [span.kind for span in row.spans] for row in secrets.secrets(frame).collect()}
    assert kinds == {1: ["guess"], 2: ["assign"], 3: [], 4: ["assign", "hex", "guess"], 5: []}
    out = {row.doc_id: (row.text, row.n_chars) for row in secrets.without_secrets(frame, n_chars_col="n_chars").collect()}
    assert out == {1: ("pwd is [secret] ok", 18), 2: ("[secret]", 8), 3: (None, None), 4: ('[secret]"', 9), 5: ("", 0)}
