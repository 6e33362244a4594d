"""Source divergence audit: how far the word shares of the sources of a language lie apart.

Each language has the vocabulary that CountVectorizer fits with ``minDF`` and the largest integer as ``vocabSize``
(documents are counted by an aggregate first, and the fit is to the terms that remain), and every document becomes an exact sparse vector of counts over it. Terms carry their language as a prefix, so one
fit serves all languages and a term counts within its own language only. The vectors are summed by (language,
source), sparsely, as a summarizer sums them, and pairs of sources are evaluated on the sums: only terms that a
source has make rows; all others of the vocabulary enter as one product.

The vocabulary passes the driver, so beyond ``SLICE_TERMS`` kept terms it is fitted in slices (by a hash of the term); a
slice is one fit and one pass over the written terms.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestmill.functions.scale import shared_folder

LEAST_DOCUMENTS = 30
# Terms listed per group; pairs are listed all.
MOST_TERMS = 50
# The largest integer that ``vocabSize`` takes: no term is left out.
WHOLE_VOCABULARY = 2**31 - 1
# Kept terms of one slice of the vocabulary, which passes the driver and is broadcast.
SLICE_TERMS = 2_000_000
SCALE, PRIOR = 1_000_000_000, 5
# ASCII other than letters stands between terms; A-Z are lower-cased; bytes of other characters stay.
_BYTES = bytes(byte if byte >= 0x80 or 0x61 <= byte <= 0x7A else byte + 32 if 0x41 <= byte <= 0x5A else 0x20 for byte in range(256))
# Never part of a term, so it parts the language from the term.
_MARK = "\0"
_VECTOR = "lang string, source string, vector struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def distinct_first(text: str) -> tuple[list[bytes], int]:
    """The terms of a text, each once and then the further occurrences, and the number of distinct ones."""
    counts = Counter(text.encode().translate(_BYTES).split())
    further = [repeat(term, n - 1) for term, n in counts.items() if n > 1]
    return [*counts, *chain.from_iterable(further)], len(counts)


def language_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, terms, n_distinct``: the terms of every document, each behind its language, distinct ones first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, texts = (column.to_pylist() for column in batch.columns)
            data, lengths, ends, distinct = [], [np.zeros(1, np.int64)], [0], []
            for lang, text in zip(langs, texts, strict=True):
                terms, n_distinct = distinct_first(text)
                prefix = (lang + _MARK).encode()
                # Terms hold no space, so the prefix can stand in for the spaces before them.
                data.append(b" ".join([b"", *terms]).replace(b" ", prefix))
                lengths.append(np.fromiter(map(len, terms), np.int64, len(terms)) + len(prefix))
                ends.append(ends[-1] + len(terms))
                distinct.append(n_distinct)
            offsets = np.cumsum(np.concatenate(lengths))
            flat = pa.LargeStringArray.from_buffers(ends[-1], pa.py_buffer(offsets), pa.py_buffer(b"".join(data))).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(distinct, pa.int32())], ["lang", "source", "terms", "n_distinct"])

    return docs.mapInArrow(run, "lang string, source string, terms array<string>, n_distinct int")


def kept_terms(terms: DataFrame, least: int) -> DataFrame:
    """``term``: what CountVectorizer keeps with ``minDF`` = ``least`` and the largest ``vocabSize``, as a table.

    Its fit counts in Java objects, which costs more than all the rest; the same counts are a plain aggregate here.
    """
    once = terms.select(F.explode(F.slice("terms", 1, F.col("n_distinct"))).alias("term"))
    return once.groupBy("term").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= least).select("term")


def _in_slice(number: int, slices: int, term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(slices)) == number


def source_counts(terms: DataFrame, kept: DataFrame, folder: str, most: int = SLICE_TERMS) -> DataFrame:
    """``lang, source, term, n``: occurrences of the kept terms by source, where there are any.

    One vocabulary of at most about ``most`` terms passes the driver at a time.
    """
    spark = terms.sparkSession
    n_terms = kept.count()
    if not n_terms:
        return spark.createDataFrame([], "lang string, source string, term string, n long")
    slices = -(-n_terms // most)
    for number in range(slices):
        part, own = terms, kept
        if slices > 1:
            in_slice = partial(_in_slice, number, slices)  # of this turn of the loop
            part, own = terms.withColumn("terms", F.filter("terms", lambda term: in_slice(term))), kept.filter(in_slice(F.col("term")))
            if own.isEmpty():
                spark.createDataFrame([], "lang string, source string, term string, n long").write.parquet(f"{folder}/counts-{number}")
                continue
        model = CountVectorizer(inputCol="terms", outputCol="vector", minDF=1.0, vocabSize=WHOLE_VOCABULARY).fit(own.select(F.array("term").alias("terms")))
        model.transform(part).select("lang", "source", "vector").write.parquet(f"{folder}/vectors-{number}")
        words = pa.table({"place": pa.array(range(len(model.vocabulary)), pa.int32()), "word": pa.array(model.vocabulary, pa.string())})
        entries = F.explode(F.arrays_zip("vector.indices", "vector.values")).alias("entry")
        vectors = spark.read.schema(_VECTOR).parquet(f"{folder}/vectors-{number}")
        cells = vectors.select("source", entries).select("source", F.col("entry.indices").alias("place"), F.col("entry.values").cast("long").alias("n"))
        # A place belongs to one language, so (source, place) is (language, source, term).
        sums = cells.groupBy("source", "place").agg(F.sum("n").alias("n"))
        term = F.substring_index("word", _MARK, -1)
        named = spark.createDataFrame(words).select("place", term.alias("term"), F.substr("word", F.lit(1), F.char_length("word") - F.char_length(term) - 1).alias("lang"))
        sums.join(named, "place").select("lang", "source", "term", "n").write.parquet(f"{folder}/counts-{number}")
    return spark.read.parquet(*(f"{folder}/counts-{number}" for number in range(slices)))


def share(n: str, total: str, terms: str) -> Column:
    """The smoothed share of a count in parts of ``SCALE``, by whole-number arithmetic of 38 digits."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(19,0)) * CAST({n} + {PRIOR} AS DECIMAL(19,0))) div CAST({total} + {PRIOR} * {terms} AS DECIMAL(19,0))").cast("long")


def pair_divergence(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang, source, item, value``: summed differences of every two sources of a language.

    ``groups`` has ``lang, source, p0, v``: the share of a term the group lacks and the size of the vocabulary;
    ``shares`` has ``lang, source, p0, p`` and ``term`` of the terms a group has. With d0 the difference of two p0, all
    terms add v * d0; a term of one source adds its distance to the other's p0, less d0; a term of both corrects that.
    """
    left, right = (groups.select("lang", F.col("source").alias(name), F.col("p0").alias(f"p0_{name}"), "v") for name in ("a", "b"))
    both = left.join(right.drop("v"), "lang").filter("a <> b")
    everything = both.select("lang", "a", "b", F.expr("v * abs(p0_a - p0_b)").alias("part"))
    # Equal shares of a source count once, with their number.
    levels = shares.groupBy("lang", "source", "p0", "p").agg(F.count("*").alias("n"))
    others = right.drop("v")
    own = levels.select("lang", F.col("source").alias("a"), F.col("p0").alias("p0_a"), "p", "n").join(others, "lang").filter("a <> b")
    one_sided = own.groupBy("lang", "a", "b").agg(F.sum(F.expr("n * (abs(p - p0_b) - abs(p0_a - p0_b))")).alias("part"))
    one_sided = one_sided.unionByName(one_sided.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "part"))
    a, b = (shares.select("lang", "term", F.col("source").alias(name), F.col("p").alias(f"p_{name}"), F.col("p0").alias(f"p0_{name}")) for name in ("a", "b"))
    met = a.join(b, ["lang", "term"]).filter("a < b")
    shared = met.groupBy("lang", "a", "b").agg(F.sum(F.expr("abs(p_a - p_b) + abs(p0_a - p0_b) - abs(p_a - p0_b) - abs(p0_a - p_b)")).alias("part"))
    shared = shared.unionByName(shared.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "part"))
    summed = everything.unionByName(one_sided).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    return summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def source_divergence(
    docs: DataFrame, least: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS, slice_terms: int = SLICE_TERMS,
    text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: sources that differ (``pair``) and the terms a source is rich in (``term``).

    Shares are 1 + floor(10^9 * (count + 5) / (N + 5 * V)) over the V terms that ``least`` documents of the language hold.
    Part ``pair`` lists every other source of the language with the sum of all differences of shares, part ``term`` the
    ``most_terms`` terms whose share lies furthest above that of the whole language. Ranks run from 1 by falling value,
    then by item in byte order.

    A null text, language or source is the empty string; a document without terms still makes its group; a language
    without a kept term has pairs of value 0; repeated rows count each; an empty table gives no row; no other column is read.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/divergence-{uuid.uuid4().hex}"
    wanted = docs.select(*(F.coalesce(docs[name], F.lit("")).alias(to) for name, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    language_terms(wanted).write.parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    kept_terms(terms, least).write.parquet(f"{folder}/kept")
    counts = source_counts(terms, spark.read.parquet(f"{folder}/kept"), folder, slice_terms)
    by_lang = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"))
    sizes = by_lang.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n_lang").alias("total_lang"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = terms.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.fillna(0, ["total", "v", "total_lang"])
    # Without a vocabulary there is nothing to share out, and every difference is 0.
    none = F.when(F.col("v") == 0, F.lit(0).cast("long"))
    groups.withColumn("p0", none.otherwise(share("0", "total", "greatest(v, 1)"))).write.parquet(f"{folder}/groups")
    groups = spark.read.parquet(f"{folder}/groups")
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))
    pairs = pair_divergence(groups.select("lang", "source", "p0", "v"), shares.select("lang", "source", "term", "p0", "p"))
    q = share("n_lang", "total_lang", "v")
    rich = shares.join(by_lang, ["lang", "term"]).withColumn("q", q).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    listed = rich.withColumn("rank", place).filter(F.col("rank") <= most_terms).withColumn("part", F.lit("term"))
    return pairs.withColumn("rank", place).withColumn("part", F.lit("pair")).unionByName(listed).select("lang", "source", "part", "item", "value", "rank")
