"""Secrets: fixed shapes, and values in a credential context judged by their guess cost.

The guess cost of a value is the least sum of log10 guesses over all ways to cut it into words, dates,
repeats, keyboard walks and brute-force spans, found by dynamic programming over end positions. A value that
stands where a credential is expected and would cost many guesses is reported beside the fixed shapes, whole
at any length. The words are those of the documents themselves, ranked by how many documents hold them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestmill.functions.scale import materialize
from digestmill.llm.rows import Span, in_order, largest, per_document, released, slim, span_digest, span_text

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "guess")

_assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""").finditer
_access = re.compile(r"AKIA[A-Z0-9]+").finditer
_hex = re.compile(r"[0-9a-f]{24,}").finditer
# Further names that announce a credential. A value in quotes goes on to the closing one of the same line, whatever it
# holds; any other goes up to a space.
_CUE = (
    r"""\b(?:password|passwd|passphrase|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"""
)
_VALUE = r"""["']?(?:\x20*[:=]\x20*|\x20+is\x20+)(?:"([^"\r\n]{6,})"|'([^'\r\n]{6,})'|["']?([!-&(-~]{6,}))"""
_context = re.compile(f"(?ai:{_CUE}){_VALUE}").finditer
# The same for Spark, and the words it counts: ASCII letters, as values are ASCII, that are no part of an encoded run.
_SPARK_CONTEXT = f"(?i:{_CUE}){_VALUE}"
_SPARK_WORD = r"(?<![0-9A-Za-z+/=_])[A-Za-z]{3,40}(?![0-9A-Za-z+/=_])"
# So many of the most frequent words are learned, each from that many documents or more.
MOST_WORDS = 20_000
LEAST_DOCUMENTS = 2

# What may follow a value in a sentence or a listing.
TRAILING = ".,;:!?)]}\"'"

# Log10 of the guesses above which a value counts as a secret: beyond what a quick dictionary attack tries.
STRONG = 8.0
# Costs of values up to this length are kept by a worker; longer ones are worked out anew.
KNOWN_LENGTH = 128
_KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
# The words guessed first whatever the documents say, most frequent first; a word's cost is its place.
_WORDS = (
    "password", "welcome", "admin", "letmein", "login", "master", "monkey", "dragon", "secret", "sunshine", "princess", "football",
    "shadow", "baseball", "superman", "trustno", "hello", "freedom", "whatever", "test", "guest", "default", "changeme", "example",
    "user", "root", "access", "summer", "winter", "spring", "autumn", "hunter", "love", "money", "token", "key", "value", "pass",
    "null", "none", "true", "false", "your", "here", "string", "required", "optional", "the", "and", "for", "with", "this", "that",
)
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_DATE = re.compile(r"(?:19|20)\d{2}(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d{2}")
_DATE_LENGTHS = range(4, 11)


@lru_cache(maxsize=1)
def _walk_steps() -> frozenset[str]:
    """Every two neighbouring keys of a row, in both directions."""
    return frozenset(row[at : at + 2][::way] for row in _KEY_ROWS for at in range(len(row) - 1) for way in (1, -1))


def _alphabet(text: str) -> int:
    size = 26 * any(char.islower() for char in text) + 26 * any(char.isupper() for char in text)
    size += 10 * any(char.isdigit() for char in text)
    return max(10, size + 33 * any(not char.isalnum() for char in text))


class GuessCosts:
    """Guess costs by a ranked list of words, most frequent first; the costs of short values are kept."""

    def __init__(self, ranked: Sequence[str] = ()):
        self.words = {word: log10(place + 2) for place, word in enumerate(_WORDS)}
        for place, word in enumerate(ranked):
            self.words[word] = min(log10(place + 2), self.words.get(word, float("inf")))
        self.longest = max(map(len, self.words))
        self.known = lru_cache(maxsize=65536)(self.whole)

    def of(self, value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
        return self.known(value) if len(value) <= KNOWN_LENGTH else self.whole(value)

    def whole(self, value: str) -> tuple[float, tuple[tuple[str, int, int], ...]]:
        size = len(value)
        lowered = value.lower()
        plain = lowered.translate(_LEET)
        per_char = log10(_alphabet(value))
        words, longest, steps = self.words, self.longest, _walk_steps()
        # Least costs of cuts that end at a place, by whether their last segment is a brute-force span: that one may go
        # on, any other segment costs the cut as well. Each remembers its kind, its start and the state before it.
        never = (float("inf"), "", 0, False)
        reach = max(longest, _DATE_LENGTHS[-1])
        ends = [{True: never, False: (0.0, "", 0, False)}] + [{True: never, False: never} for _ in range(size)]
        further = log10(2)
        repeat = walk = 0  # where the repeat and the keyboard walk that end here began
        for end in range(1, size + 1):

            def offer(kind: str, start: int, cost: float, end: int = end) -> None:
                brute = kind == "brute"
                for before in (True, False):
                    total = ends[start][before][0] + cost + (further if start and not (brute and before) else 0.0)
                    if total < ends[end][brute][0] - 1e-12:
                        ends[end][brute] = (total, kind, start, before)

            offer("brute", end - 1, per_char)
            for length in range(3, min(longest, end) + 1):
                start = end - length
                piece = plain[start:end]
                if piece in words:
                    changed = 1 + (piece != lowered[start:end]) + (value[start:end] != lowered[start:end])
                    offer("word", start, words[piece] + log10(changed))
            for length in _DATE_LENGTHS:
                if length <= end and _DATE.fullmatch(value, end - length, end):
                    offer("date", end - length, log10(365 * 120) if length > 4 else log10(120))
            if end > 1 and value[end - 1] != value[end - 2]:
                repeat = end - 1
            if end > 1 and lowered[end - 2 : end] not in steps:
                walk = end - 1
            # A word or date may end inside a run, which then begins later; nothing longer is worth that.
            for start in range(repeat, min(repeat + reach, end - 3) + 1):
                offer("repeat", start, per_char + log10(end - start))
            for start in range(walk, min(walk + reach, end - 3) + 1):
                offer("walk", start, log10(len("".join(_KEY_ROWS)) * 2) + log10(end - start))
        segments, end = [], size
        brute = ends[size][True][0] < ends[size][False][0]
        least = ends[size][brute][0]
        while end:
            _, kind, start, before = ends[end][brute]
            if segments and kind == "brute" == segments[-1][0]:
                segments[-1] = ("brute", start, segments[-1][2])
            else:
                segments.append((kind, start, end))
            end, brute = start, before
        return least, tuple(reversed(segments))


@lru_cache(maxsize=1)
def _fixed_costs() -> GuessCosts:
    return GuessCosts()


def guess_cost(value: str, costs: GuessCosts | None = None) -> tuple[float, tuple[tuple[str, int, int], ...]]:
    """Least log10 guesses of a value and the segments of that cut, as (kind, start, end).

    Each further segment costs a factor of two on top of its own guesses, for not knowing the cut. Time is
    linear in the length: no segment but a repeat, a walk or a brute-force span is longer than the longest
    word, and those three are extended one character at a time. Without ``costs`` only the fixed words count.
    """
    return (costs or _fixed_costs()).of(value)


def learn_words(docs: DataFrame, most: int = MOST_WORDS, text_col: str = "text") -> tuple[str, ...]:
    """The words that most documents hold, most frequent first, in lower case; equal counts by the word (at the end of the list, by a hash).

    Values in a credential context are left out, so no password vouches for itself. A word is a run of 3 to 40 ASCII
    letters in ``LEAST_DOCUMENTS`` documents or more; all documents are counted. The driver gets the words above a
    cut-off that a histogram finds, so about ``most`` of them whatever the number of partitions.
    """
    prose = F.regexp_replace(docs[text_col], _SPARK_CONTEXT, " ")
    words = F.array_distinct(F.regexp_extract_all(F.lower(prose), F.lit(_SPARK_WORD), F.lit(0)))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCUMENTS)
    # The upper bits of the rank are the count, the lower ones part words of equal counts.
    rank = F.shiftleft(F.least("n", F.lit(1 << 41)), 20) + F.pmod(F.xxhash64("word"), F.lit(1 << 20))
    rows = largest(materialize(counted.select("word", "n", rank.alias("rank"))), "rank", most)
    return tuple(row["word"] for row in sorted(rows, key=lambda row: (-row["n"], row["word"])))


def find_secrets(text: str, strong: float = STRONG, costs: GuessCosts | None = None) -> list[Span]:
    """All spans of a text as (kind, start, end), by start and then kind; end is exclusive."""
    spans: list[Span] = []
    for found in _assign(text):
        if found.end(2) - found.start(2) >= 6:
            spans.append(("assign", *found.span()))
    spans += [("access", *found.span()) for found in _access(text) if found.end() - found.start() >= 20]
    spans += [("hex", *found.span()) for found in _hex(text)]
    for found in _context(text):
        at = found.lastindex
        value = found[at].rstrip(TRAILING) if at == 3 else found[at]
        if len(value) >= 6 and guess_cost(value, costs)[0] >= strong:
            spans.append(("guess", found.start(at), found.start(at) + len(value)))
    return in_order(spans, KINDS)


def secrets(
    docs: DataFrame, strong: float = STRONG, id_col: str = "doc_id", text_col: str = "text", words: Sequence[str] | None = None, most: int = MOST_WORDS
) -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end, cost>>`` of every whole text, in code points, end exclusive.

    ``cost`` is the log10 guess cost of a ``guess`` value and null for the fixed shapes. ``words`` is a ranked word
    list; without one the ``most`` words of most documents are learned from all rows by ``learn_words``. A null or empty text has no spans; a null id
    stays null; repeated rows give repeated results; an empty table gives none; other columns are left out.
    """
    shared = _shared_words(docs, text_col, words, most)

    def worker():
        costs = GuessCosts(shared.value)

        def rows(text: str) -> tuple:
            return (
                [
                    {"kind": kind, "start": start, "end": end, "cost": guess_cost(text[start:end], costs)[0] if kind == "guess" else None}
                    for kind, start, end in find_secrets(text, strong, costs)
                ],
            )

        return rows

    return per_document(slim(docs, id_col, text_col), "spans array<struct<kind:string,start:long,end:long,cost:double>>", worker)


def secret_digests(
    docs: DataFrame, strong: float = STRONG, id_col: str = "doc_id", text_col: str = "text", words: Sequence[str] | None = None, most: int = MOST_WORDS
) -> DataFrame:
    """Counts of the fixed shapes, the digest of their spans, and all spans as text; cases and words as in ``secrets``."""
    shared = _shared_words(docs, text_col, words, most)

    def worker():
        costs = GuessCosts(shared.value)

        def summarize(text: str) -> tuple:
            spans = find_secrets(text, strong, costs)
            base = [span for span in spans if span[0] in BASE_KINDS]
            return (*(sum(span[0] == kind for span in base) for kind in BASE_KINDS), span_digest(base), span_text(spans))

        return summarize

    schema = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return per_document(slim(docs, id_col, text_col), schema, worker)


def _shared_words(docs: DataFrame, text_col: str, words: Sequence[str] | None, most: int):
    """The word list as a broadcast of at most ``most`` words, or of those given."""
    return docs.sparkSession.sparkContext.broadcast(learn_words(docs, most, text_col) if words is None else tuple(words))


def masked(text: str | None, mask: str, strong: float, costs: GuessCosts | None = None) -> str | None:
    """A text with its secrets replaced; overlapping spans become one mask."""
    spans = find_secrets(text, strong, costs) if text else []
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def without_secrets(
    docs: DataFrame, mask: str = "[secret]", strong: float = STRONG, text_col: str = "text", n_chars_col: str | None = None, words: Sequence[str] | None = None,
    most: int = MOST_WORDS,
) -> DataFrame:
    """The same rows and columns with every secret in ``text_col`` replaced by ``mask``.

    ``n_chars_col`` names a column that holds the text's length and follows it; a null length stays null. A null
    text stays null; no row is added or lost and no other column changes. ``words`` as in ``secrets``.
    """
    shared = _shared_words(docs, text_col, words, most)

    @F.arrow_udf("string")
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        costs = GuessCosts(shared.value)
        for texts in released(batches):
            yield pa.array([masked(text, mask, strong, costs) for text in texts.to_pylist()], pa.string())

    clean = docs.withColumn(text_col, redact(docs[text_col]))
    if n_chars_col is None:
        return clean
    kind = dict(docs.dtypes)[n_chars_col]
    length = F.when(F.col(n_chars_col).isNotNull(), F.coalesce(F.char_length(text_col), F.lit(0)).cast(kind))
    return clean.withColumn(n_chars_col, length)
