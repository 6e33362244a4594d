"""Phrase collocations by prefix-free parsing.

1. Pieces of text between marks are parsed into chunks: where a window of three words hashes to a trigger, one chunk
   ends with the window and the next begins with it. The same content is cut alike wherever it stands, so what
   documents share becomes few distinct chunks: the dictionary, with the number of times each was parsed.
2. Phrases are counted inside distinct chunks, weighted by those numbers. Chunks overlap by three words, so each
   phrase of up to four words lies in one; it is counted where its first word is not in the overlap, hence once.
3. Lengths are counted one after the other. A longer phrase is as frequent as its parts at most, so only phrases whose
   two parts pass are handed on. The test is a bitmap of fixed size over hashes of the frequent shorter ones: it lets
   all of them pass and few others, and the counts themselves are of words, not of hashes.

Scores, drops and ranks are joins and aggregates of frequent phrases only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from digestmill.functions.scale import shared_folder
from digestmill.llm.shingles import mixed

LONGEST = 4
LEAST = 30
# A longer phrase with this share of a candidate's occurrences, in percent, drops the candidate.
ABSORBED = 80
MOST = 2_000
SCALE = 2_000_000
# Words of the window that ends a chunk and begins the next, one less than the longest phrase; one window in TRIGGER does.
WINDOW, TRIGGER = LONGEST - 1, 16
# Bits of the bitmap of frequent phrases: 8 MB, whatever the corpus.
BITMAP_BITS = 1 << 26
# Parts in which the first ranks of a language are found before they are put together.
SALTS = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# A-Z lower-cased; the marks between pieces become line breaks.
_BYTES = bytes(10 if byte in b".,;:!?\n\x0b\x0c\r" else byte + 32 if 0x41 <= byte <= 0x5A else byte for byte in range(256))
_GRAMS = "lang string, phrase string, n long"


def pieces(text: str) -> list[list[bytes]]:
    """The words of each piece of a text; pieces without words are left out."""
    return [words for words in map(bytes.split, text.encode().translate(_BYTES).split(b"\n")) if words]


def chunks(text: str) -> tuple[list[bytes], list[int]]:
    """The chunks of a text, as words joined by spaces, and the number of words of each whose phrases count there."""
    parsed = pieces(text)
    found, starts = [b" ".join(piece) for piece in parsed], [len(piece) for piece in parsed]
    words = [word for piece in parsed for word in piece]
    if len(words) <= WINDOW:
        return found, starts
    codes = np.fromiter(map(crc32, words), np.uint64, len(words))
    window = phrase_hashes(codes, WINDOW)
    triggers = np.flatnonzero(window % np.uint64(TRIGGER) == 0)
    # Those within a piece and not at its start cut it.
    ends = np.cumsum(starts)
    piece = np.searchsorted(ends, triggers, side="right")
    first = ends[piece] - np.array(starts)[piece]
    cuts = (triggers > first) & (triggers + WINDOW <= ends[piece])
    by_piece: dict[int, list[int]] = {}
    for at, place in zip(piece[cuts].tolist(), (triggers - first)[cuts].tolist(), strict=True):
        by_piece.setdefault(at, []).append(place)
    for at, places in by_piece.items():
        own = parsed[at]
        for start, end in zip([0, *places], places, strict=False):
            found.append(b" ".join(own[start : end + WINDOW]))
            starts.append(end - start)
        found[at], starts[at] = b" ".join(own[places[-1] :]), len(own) - places[-1]
    return found, starts


def parse(docs: DataFrame) -> DataFrame:
    """``lang, chunk, starts, parsed``: the dictionary of a table of ``lang, text`` with its parse frequencies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found, starts = [], [], []
            for lang, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                own, n_starts = chunks(text)
                found += own
                starts += n_starts
                langs += [lang] * len(own)
            columns = [pa.array(langs, pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(starts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "starts"])

    rows = docs.mapInArrow(run, "lang string, chunk string, starts int")
    return rows.groupBy("lang", "chunk", "starts").agg(F.count("*").alias("parsed"))


def phrase_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` words from each place on; the last places have none."""
    hashes = codes[: max(0, len(codes) - size + 1)]
    for place in range(1, size):
        hashes = mixed(hashes ^ (codes[place : place + len(hashes)] * _MULTIPLIER))
    return hashes


def language_codes(lang: str, words: list[str]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(word, seed) for word in words], np.uint64)


def bitmap(frequent: DataFrame, size: int) -> np.ndarray:
    """The bitmap of a table of frequent phrases of ``size`` words: ``BITMAP_BITS`` bits come to the driver at most."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [phrase_hashes(language_codes(lang, phrase.split(" ")), size)[0] for lang, phrase in zip(*(column.to_pylist() for column in batch.columns), strict=True)]
            bits = np.array(hashes, np.uint64) % np.uint64(BITMAP_BITS)
            masks = (np.uint64(1) << (bits % np.uint64(64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((bits // np.uint64(64)).astype(np.int32)), pa.array(masks)], ["word", "mask"])

    rows = frequent.select("lang", "phrase").mapInArrow(run, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return out


def counted(dictionary: DataFrame, size: int, shorter: np.ndarray | None) -> DataFrame:
    """``lang, phrase, n`` of the phrases of ``size`` words whose two shorter parts are in the bitmap."""
    shared = None if shorter is None else dictionary.sparkSession.sparkContext.broadcast(shorter)

    def passing(hashes: np.ndarray) -> np.ndarray:
        bits = hashes % np.uint64(BITMAP_BITS)
        return (shared.value[(bits // np.uint64(64)).astype(np.int64)] >> (bits % np.uint64(64))) & np.uint64(1) == 1

    def grams(lang: str, chunk: pa.Array, starts: np.ndarray, parsed: np.ndarray) -> pa.RecordBatch:
        lists = pc.split_pattern(chunk, " ")
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        words, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        lengths = np.diff(offsets)
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(ids)) - (offsets[:-1] - offsets[0])[row]
        fits = (place < starts[row]) & (place + size <= lengths[row])
        if shared is not None and len(ids) >= size:
            codes = language_codes(lang, words.to_pylist())[ids]
            passes = passing(phrase_hashes(codes, size - 1))
            fits[: len(passes) - 1] &= passes[:-1] & passes[1:]
        at = np.flatnonzero(fits)
        # Exact numbers of the phrases of this batch, a word at a time.
        same = ids[at]
        for next_ in range(1, size):
            same = pd.factorize(same * len(words) + ids[at + next_])[0].astype(np.int64)
        same = same if size > 1 else pd.factorize(same)[0]
        first = np.empty(int(same.max()) + 1 if len(same) else 0, np.int64)
        first[same[::-1]] = np.arange(len(same))[::-1]
        totals = np.bincount(same, weights=parsed[row[at]], minlength=len(first)).astype(np.int64)
        columns = [words.take(pa.array(ids[at[first] + next_])) for next_ in range(size)]
        phrase = pc.binary_join_element_wise(*columns, " ") if size > 1 else columns[0]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), phrase, pa.array(totals)], ["lang", "phrase", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0)
            for lang in pc.unique(langs).to_pylist():
                part = batch.filter(pc.equal(langs, lang))
                if part.num_rows:
                    yield grams(lang, part.column(1), part.column(2).to_numpy(), part.column(3).to_numpy())

    rows = dictionary.select("lang", "chunk", "starts", "parsed").mapInArrow(run, _GRAMS)
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(dictionary: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """``lang, phrase, size, n``: all phrases of up to ``LONGEST`` words with ``least`` occurrences or more."""
    spark = dictionary.sparkSession
    shorter = None
    for size in range(1, LONGEST + 1):
        counted(dictionary, size, shorter).filter(F.col("n") >= least).write.parquet(f"{folder}/phrases/size={size}")
        if size < LONGEST:
            shorter = bitmap(spark.read.parquet(f"{folder}/phrases/size={size}"), size)
    return spark.read.schema("lang string, phrase string, n long, size int").parquet(f"{folder}/phrases")


def scored(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, score``: every candidate by its lowest-scoring cut, the earliest of equal ones."""
    candidates = frequent.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)")).withColumn("right", F.substr("phrase", F.char_length("left") + 2))
    parts = frequent.filter(F.col("size") < LONGEST)
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(10,0)) * CAST(a AS DECIMAL(19,0)) div CAST(l + r AS DECIMAL(19,0))").cast("long")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def absorbed(frequent: DataFrame) -> DataFrame:
    """``lang, phrase, within``: the most occurrences of a longer phrase that holds a phrase of two words or more."""
    longer = frequent.filter("size > 2").select("lang", "n", F.split("phrase", " ").alias("words"))
    sub = [F.slice("words", start + 1, size) for size in range(2, LONGEST) for start in range(LONGEST - size + 1)]
    # A slice beyond the end is shorter; those as long as asked for and shorter than the whole count.
    whole = [F.when((F.size(part) == size) & (F.size("words") > size), F.array_join(part, " ")) for part, size in zip(sub, [s for s in range(2, LONGEST) for _ in range(LONGEST - s + 1)], strict=True)]
    rows = longer.select("lang", "n", F.explode(F.array_distinct(F.array_compact(F.array(*whole)))).alias("phrase"))
    return rows.groupBy("lang", "phrase").agg(F.max("n").alias("within"))


def collocations(docs: DataFrame, least: int = LEAST, most: int = MOST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``most`` phrases of each language.

    A phrase has two to four words of one piece, in lower case (A-Z), joined by a space; ``a``, ``l`` and ``r`` are the
    occurrences of the phrase, of its first words and of the rest, ``n`` the words of the language. The score is
    floor(2000000 * a / (l + r)) of the lowest-scoring cut. Phrases with ``least`` occurrences count; one that a longer
    phrase holds in 80 % of its occurrences or more is dropped. Ranks go by score, ``a``, and the phrase in byte order.

    A null text has no words; a null language is ``und``; repeated rows count each; texts of any length are read whole;
    an empty table, and one without frequent phrases, gives no row; no other column is read.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    wanted = docs.select(F.coalesce(docs[lang_col], F.lit("und")).alias("lang"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    parse(wanted).write.option("compression", "zstd").parquet(f"{folder}/dictionary")
    dictionary = spark.read.parquet(f"{folder}/dictionary")
    frequent = frequent_phrases(dictionary, folder, least)
    totals = dictionary.groupBy("lang").agg(F.sum(F.col("starts") * F.col("parsed")).alias("n"))
    kept = scored(frequent).join(absorbed(frequent), ["lang", "phrase"], "left").filter(F.expr(f"within IS NULL OR 100 * within < {ABSORBED} * a")).drop("within")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # The first of each part are all that can be among the first of the language.
    leading = salted.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("place") <= most)
    ranked = leading.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
