"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digit pairs, plus signs before digits, address
schemes and words that announce an identifier. A small deterministic parser at each anchor expands to the
left and right over the characters its kind allows and validates what it found. Nothing is tried twice: a
parser reads each stretch of text once, and anchors inside a stretch that was read are passed over.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from digestmill.llm.rows import Span, in_order, per_document, slim, span_digest, span_text

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "account", "login")
KINDS = BASE_KINDS + ADDED_KINDS

_DIGITS = frozenset("0123456789")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOCAL = _LETTERS | _DIGITS | frozenset("._%+-")
_LABEL = _LETTERS | _DIGITS | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_USER = _LETTERS | _DIGITS | frozenset("._~%!$&'*+,;=:-")
_CUES = ("account", "acct", "iban", "konto", "compte", "cuenta")
_CUE_WORDS = ("number", "no", "nr", "id")
_SCHEMES = ("://",)


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Every anchor string with its parser's name; the ten digits give the pair patterns by rule."""
    automaton = ahocorasick.Automaton()
    kinds: dict[str, str] = {"@": "email"}
    for first in "0123456789":
        kinds[f"+{first}"] = "phone"
        for second in "0123456789":
            kinds[f"{first}.{second}"] = "ip"
            for between in ("", " ", "-"):
                kinds[f"{first}{between}{second}"] = "card"
    for scheme in _SCHEMES:
        kinds[scheme] = "login"
    for cue in _CUES:
        for shape in (cue, cue.capitalize(), cue.upper()):
            kinds[shape] = "account"
    for anchor, kind in kinds.items():
        automaton.add_word(anchor, (kind, len(anchor)))
    automaton.make_automaton()
    return automaton


def run_end(text: str, at: int, allowed: frozenset[str]) -> int:
    """Where the run of allowed characters that begins at ``at`` ends."""
    size = len(text)
    while at < size and text[at] in allowed:
        at += 1
    return at


def run_start(text: str, at: int, allowed: frozenset[str], floor: int) -> int:
    """Where the run of allowed characters that ends before ``at`` starts, not before ``floor``."""
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def email_at(text: str, sign: int, floor: int) -> tuple[int, int] | None:
    start = run_start(text, sign, _LOCAL, floor)
    end = run_end(text, sign + 1, _LABEL)
    if start == sign or end == sign + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == ".":
        after = run_end(text, end + 1, _LABEL)
        if after == end + 1:
            break
        end, labels = after, labels + 1
    return (start, end) if labels > 1 else None


def dotted_runs(text: str, at: int) -> list[tuple[int, int]]:
    """The digit runs joined by single dots from the run around ``at`` on."""
    start = run_start(text, at, _DIGITS, 0)
    runs = [(start, run_end(text, start, _DIGITS))]
    while (end := runs[-1][1]) + 1 < len(text) and text[end] == "." and text[end + 1] in _DIGITS:
        runs.append((end + 1, run_end(text, end + 1, _DIGITS)))
    return runs


def part_valid(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def digit_chain(text: str, at: int) -> int:
    """The end of digits that begin at ``at`` with at most one space or hyphen between two."""
    size = len(text)
    at = run_end(text, at, _DIGITS)
    while at + 1 < size and text[at] in " -" and text[at + 1] in _DIGITS:
        at = run_end(text, at + 1, _DIGITS)
    return at


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    end = run_end(text, plus + 2, _PHONE)
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    return (plus, end) if end > plus + 3 else None


def iban_valid(code: str) -> bool:
    if not (15 <= len(code) <= 34 and code[:2].isalpha() and code[2:4].isdigit()):
        return False
    number = "".join(str(int(char, 36)) for char in code[4:] + code[:4])
    return int(number) % 97 == 1


def after_separators(text: str, at: int) -> int:
    limit = min(len(text), at + 8)
    while at < limit and text[at] in " :#=\t.-":
        at += 1
    return at


def account_after(text: str, at: int) -> Span | None:
    """An IBAN, or 6 to 18 digits with an optional short letter prefix, right after a cue word.

    Between the cue and the value may stand one of a few short words and up to 8 separators on either side of
    it; the value must end at a word boundary.
    """
    start = after_separators(text, at)
    for word in _CUE_WORDS:
        if text[start : start + len(word)].lower() == word:
            start = after_separators(text, start + len(word))
            break
    if start == at or start >= len(text):
        return None
    if text[start] in _LETTERS:
        end, code = start, ""
        while end < len(text) and len(code) < 34 and (text[end] in _LETTERS or text[end] in _DIGITS or (text[end] == " " and end + 1 < len(text) and (text[end + 1] in _DIGITS))):
            code += "" if text[end] == " " else text[end].upper()
            end += 1
        return ("iban", start, end) if iban_valid(code) else None
    end = start
    n_digits = 0
    while end < len(text) and (text[end] in _DIGITS or (text[end] in " -" and end + 1 < len(text) and text[end + 1] in _DIGITS)):
        n_digits += text[end] in _DIGITS
        end += 1
    bounded = end == len(text) or not (text[end].isalnum() or text[end] == "_")
    return ("account", start, end) if bounded and 6 <= n_digits <= 18 else None


def login_after(text: str, at: int) -> Span | None:
    """The user part of an address right after its scheme: what stands before an at-sign and names a user."""
    end = run_end(text, at, _USER)
    if end == at or end >= len(text) or text[end] != "@" or end + 1 >= len(text) or text[end + 1] not in _LABEL:
        return None
    return ("login", at, end) if ":" in text[at:end] else None


def find_personal_data(text: str) -> list[Span]:
    """All spans of a text as (kind, start, end), by start and then kind; end is exclusive."""
    spans: list[Span] = []
    done = dict.fromkeys(KINDS, 0)  # where the last stretch read for a kind ended
    for last, (kind, size) in anchors().iter(text):
        start = last - size + 1
        if kind == "card" or kind == "ip":
            if kind == "ip" and start >= done["ip"]:
                runs = dotted_runs(text, start)
                for place in range(0, len(runs) - 3, 4):
                    four = runs[place : place + 4]
                    if all(part_valid(text[begin:end]) for begin, end in four):
                        spans.append(("ip", four[0][0], four[3][1]))
                done["ip"] = runs[-1][1]
            if kind == "card" and start >= done["card"]:
                end = digit_chain(text, start)
                digits = [char for char in text[start:end] if char in _DIGITS]
                if 14 <= len(digits) <= 19 and luhn("".join(digits)):
                    spans.append(("card", start, end))
                done["card"] = end
        elif kind == "email":
            found = email_at(text, start, done["email"])
            if found:
                spans.append(("email", *found))
                done["email"] = found[1]
        elif kind == "phone":
            if start >= done["phone"]:
                found = phone_at(text, start)
                if found:
                    done["phone"] = found[1]
                    if 10 <= sum(char in _DIGITS for char in text[found[0] : found[1]]) <= 15:
                        spans.append(("phone", *found))
        elif kind == "login":
            if found := login_after(text, last + 1):
                spans.append(found)
        elif last + 1 > done["account"] and not (start and text[start - 1].isalnum()):
            if found := account_after(text, last + 1):
                spans.append(found)
                done["account"] = found[2]
    return in_order(spans, KINDS)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end>>`` of every whole text, in code points, end exclusive.

    Base kinds are email, ip, card and phone. Beside them stand account numbers and valid IBANs right after a
    cue word, and user:secret parts of addresses. A null or empty text has no spans; a null id stays null;
    repeated rows give repeated results; an empty table gives none; other columns are left out.
    """
    return per_document(
        slim(docs, id_col, text_col),
        "spans array<struct<kind:string,start:long,end:long>>",
        lambda: lambda text: ([{"kind": kind, "start": start, "end": end} for kind, start, end in find_personal_data(text)],),
    )


def personal_data_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as text; cases as above."""

    def summarize(text: str) -> tuple:
        spans = find_personal_data(text)
        base = [span for span in spans if span[0] in BASE_KINDS]
        counts = [sum(span[0] == kind for span in base) for kind in BASE_KINDS]
        return (*counts, span_digest(base), span_text(spans))

    schema = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return per_document(slim(docs, id_col, text_col), schema, lambda: summarize)
