"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded texts.

Folding lower-cases a text, replaces look-alike letters and digits by the letters they stand for and drops
invisible characters, so that spelled-around words meet their plain form. The lexicon's words and weights, the
exception phrases in which such words mean no harm, and the curve from the length-normalised sum to a score
are learned from labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import exp, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill.llm.rows import per_document, slim

# Labelled rows used at most, those with the smallest hash of their id: the bound of what learning gathers.
MOST_LABELLED = 200_000
MOST_WORDS = 4096
MOST_EXCEPTIONS = 4096
# A word enters the lexicon when it is in so many toxic rows, at least, and so many times likelier there.
LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 3, 0.004, 4.0
# Words counted in a task before partial counts are handed on.
COUNTED_WORDS = 200_000
# Words added to every length, so that one word of a very short text does not decide alone.
LENGTH_FLOOR = 20
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = dict(zip("авсԁеғһіјкӏмпоԛрѕтцѵԝхуαβεικνορτυχɡıł", "abcdefhijklmnoqpstuvwxyabeiknoptuxgil", strict=True))
_DIGITS = dict(zip("0123456789", "oizeasgtbg", strict=True))


def fold_table() -> dict[int, str | None]:
    """Code points to letters; l and i are one class because the digit 1 stands for both."""
    table: dict[int, str | None] = {ord(wide): chr(ord(wide) - 0xFEE0) for wide in map(chr, range(0xFF01, 0xFF5F))}
    table |= {ord(letter): plain for letter, plain in _LOOKALIKES.items()}
    table = {code: _DIGITS.get(plain, plain.lower()) for code, plain in table.items()}
    table |= {ord(digit): letter for digit, letter in _DIGITS.items()}
    table |= dict.fromkeys([0xAD, 0xFEFF, *range(0x200B, 0x2010), *range(0x300, 0x370)])
    table[ord("l")] = "i"
    return {code: "i" if letter == "l" else letter for code, letter in table.items()}


_FOLD = fold_table()
_words = re.compile(r"\w+").findall


def folded_words(text: str) -> list[str]:
    return _words(text.lower().translate(_FOLD))


@dataclass(frozen=True)
class ToxicityModel:
    """What scoring needs: a bounded table of words, a bounded list of phrases and two numbers."""

    weights: dict[str, float]
    exceptions: tuple[str, ...]
    slope: float
    intercept: float

    def automaton(self) -> ahocorasick.Automaton:
        """Words and exception phrases between single spaces; a phrase has no weight."""
        machine = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            machine.add_word(f" {word} ", (len(word) + 2, weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        machine.make_automaton()
        return machine

    def score(self, density: float) -> float:
        return 1 / (1 + exp(-min(max(self.slope * density + self.intercept, -60.0), 60.0)))


def hits(machine: ahocorasick.Automaton, words: list[str]) -> list[tuple[str, float]]:
    """Lexicon words of a text with their weights, without those inside an exception phrase."""
    if not words or not len(machine):
        return []
    line = f" {' '.join(words)} "
    found, safe = [], []
    for last, (size, weight) in machine.iter(line):
        if weight is None:
            safe.append((last - size + 1, last))
        else:
            found.append((last - size + 1, last, weight))
    if safe:
        found = outside(found, safe)
    return [(line[start + 1 : last], weight) for start, last, weight in found]


def outside(found: list[tuple[int, int, float]], safe: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """Hits that lie in no safe stretch; both lists are walked once, by start."""
    safe.sort()
    kept, at, reach = [], 0, -1
    for hit in sorted(found):
        while at < len(safe) and safe[at][0] <= hit[0]:
            reach = max(reach, safe[at][1])
            at += 1
        if hit[1] > reach:
            kept.append(hit)
    return kept


def density(found: list[tuple[str, float]], n_words: int) -> float:
    """Weight per hundred words, on a logarithmic scale."""
    return log1p(100 * sum(weight for _, weight in found) / (n_words + LENGTH_FLOOR))


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, n_hits, hit_words array<string>`` for every whole text.

    ``hit_words`` lists the folded words met, each once. A null or empty text has no hits and the score of
    none; a null id stays null; repeated rows give repeated results; an empty table gives none; other columns
    are left out.
    """

    def worker():
        machine = model.automaton()

        def judge(text: str) -> tuple[float, int, list[str]]:
            words = folded_words(text)
            found = hits(machine, words)
            return model.score(density(found, len(words))), len(found), sorted({word for word, _ in found})

        return judge

    return per_document(slim(docs, id_col, text_col), "score double, n_hits long, hit_words array<string>", worker)


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from the rows of ``labels`` that have a document; at most ``MOST_LABELLED`` of them.

    The rows are halved by a hash of their id. Each half is scored with the lexicon of the other, and the curve
    is fitted to those scores, so it knows how much a lexicon is worth on texts it has not seen. The lexicon
    returned is that of both halves. A null id or label is left out; of repeated labels the largest counts; with
    no toxic or no other row nothing is learned and every score is the share of toxic rows.
    """
    chosen = (
        labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MOST_LABELLED)
    )
    # At most MOST_LABELLED small rows: a broadcast of known size, so no text is shuffled.
    rows = slim(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "label", F.pmod(F.hash("doc_id"), F.lit(2)).alias("half"))
    # Needs no text, so no text is read for it.
    sizes = {(row["half"], row["is_toxic"]): row["count"] for row in rows.groupBy("half", (F.col("label") > 0).alias("is_toxic")).count().collect()}
    toxic, clean = (sum(n for (_, is_toxic), n in sizes.items() if is_toxic == wanted) for wanted in (True, False))
    if not toxic or not clean:
        share = toxic / (toxic + clean) if toxic + clean else 0.0
        return ToxicityModel({}, (), 0.0, log((share + 1e-6) / (1 - share + 1e-6)))
    counted = rows.mapInArrow(_word_counts(None), "word string, half int, toxic long, clean long")
    by_word = counted.groupBy("word").agg(
        *(F.sum(F.when(F.col("half") == half, F.col(kind)).otherwise(0)).alias(f"{kind}{half}") for half in (0, 1) for kind in ("toxic", "clean"))
    )
    total_toxic, total_clean = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    odds = ((total_toxic + 0.5) / (toxic + 1)) / ((total_clean + 0.5) / (clean + 1))
    candidates = by_word.filter((total_toxic >= LEAST_ROWS) & (odds >= LEAST_ODDS)).orderBy((total_toxic * F.log(odds)).desc(), "word").limit(MOST_WORDS).collect()
    lexicons = [_lexicon(candidates, sizes, halves) for halves in ((0,), (1,), (0, 1))]
    exceptions = _exceptions(rows, lexicons[2])
    pairs = rows.mapInArrow(_densities([ToxicityModel(lexicon, exceptions, 0.0, 0.0) for lexicon in lexicons[:2]]), "density double, label int").collect()
    slope, intercept = _curve(np.array([row["density"] for row in pairs]), np.array([row["label"] > 0 for row in pairs], float))
    return ToxicityModel(lexicons[2], exceptions, slope, intercept)


def _word_counts(model: ToxicityModel | None):
    """Rows with a word by half and label; with a model, with a phrase of a lexicon word and one neighbour."""

    def items_of(text: str, weights) -> set[str]:
        words = folded_words(text)
        if weights is None:
            return {word for word in words if 2 < len(word) <= 40}
        places = [at for at, word in enumerate(words) if word in weights]
        return {" ".join(words[start : start + 2]) for at in places for start in (at - 1, at) if 0 <= start < len(words) - 1}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = None if model is None else model.weights
        counts: Counter = Counter()
        for batch in batches:
            for text, label, half in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                is_toxic = label > 0
                counts.update((item, half, is_toxic) for item in items_of(text, weights))
                if len(counts) > COUNTED_WORDS:
                    yield _counts(counts)
                    counts = Counter()
        if counts:
            yield _counts(counts)

    return run


def _counts(counts: Counter) -> pa.RecordBatch:
    rows = [(word, half, n if toxic else 0, 0 if toxic else n) for (word, half, toxic), n in counts.items()]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["word", "half", "toxic", "clean"])


def _lexicon(candidates, sizes: dict, halves: tuple[int, ...]) -> dict[str, float]:
    """Words with their log odds, from the counts of some halves."""
    toxic, clean = (sum(sizes.get((half, wanted), 0) for half in halves) for wanted in (True, False))
    least = max(LEAST_ROWS * len(halves) / 2, LEAST_SHARE * toxic)
    weights = {}
    for row in candidates:
        with_toxic, with_clean = (sum(row[f"{kind}{half}"] for half in halves) for kind in ("toxic", "clean"))
        odds = ((with_toxic + 0.5) / (toxic + 1)) / ((with_clean + 0.5) / (clean + 1))
        if with_toxic >= least and odds >= LEAST_ODDS:
            weights[row["word"]] = log(odds)
    return weights


def _exceptions(rows: DataFrame, weights: dict[str, float]) -> tuple[str, ...]:
    """Two-word phrases with a lexicon word that are in clean rows only, and in two of them at least."""
    if not weights:
        return ()
    counted = rows.mapInArrow(_word_counts(ToxicityModel(weights, (), 0.0, 0.0)), "word string, half int, toxic long, clean long")
    phrases = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic = 0 AND clean >= 2")
    return tuple(row["word"] for row in phrases.orderBy(F.desc("clean"), "word").limit(MOST_EXCEPTIONS).collect())


def _densities(models: list[ToxicityModel]):
    """Density and label of each row, by the lexicon of the half it is not in."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [model.automaton() for model in models]
        for batch in batches:
            out = []
            for text, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = folded_words(text)
                out.append(density(hits(machines[1 - half], words), len(words)))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), batch.column(1)], ["density", "label"])

    return run


def _curve(density: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a little ridge on the slope."""
    features = np.column_stack([density, np.ones_like(density)])
    weights = np.array([0.0, log((toxic.sum() + 0.5) / (len(toxic) - toxic.sum() + 0.5))])
    ridge = np.diag([0.01, 1e-6])
    for _ in range(50):
        chance = 1 / (1 + np.exp(-np.clip(features @ weights, -40, 40)))
        gradient = features.T @ (toxic - chance) - ridge @ weights
        step = np.linalg.solve((features * (chance * (1 - chance))[:, None]).T @ features + ridge, gradient)
        weights = weights + np.clip(step, -5, 5)
        if abs(step).max() < 1e-9:
            break
    return float(weights[0]), float(weights[1])


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
