"""Quality rules of documents and of the hosts they come from.

Each document is measured inside its row. Rule failures are then summed by host, and each host's failure
rates are shrunk towards the rate of the whole corpus by a beta prior whose strength is estimated from the
spread between hosts: a host with few documents is judged mostly by the prior. Hosts whose shrunk rate
passes a limit are rejected and their verdict is joined back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill.functions.scale import materialize
from digestmill.llm.rows import numbered_rows, without_rows

WHITE = r"[\x20\x09-\x0D]+"
VISIBLE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"

# Rules as failure conditions over the measures. The first two reject a document by themselves; all of them
# are summed by host.
RULES = {
    "short": "n_words < 50",
    "repeated": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
}
BASE_RULES = ("short", "repeated")
# A host goes when its shrunk rate of failures of one rule is above this share of its documents.
HOST_LIMIT = 0.5
# Bounds of the prior's strength in documents.
WEAKEST, STRONGEST = 1.0, 1e6
MEASURES = ("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
# Parts a host is dealt over when verdicts go back to the documents.
SALTS = 64


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` per row, without a shuffle."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[host_col].alias("host"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    split = rows.select(
        "doc_id",
        "host",
        F.array_remove(F.split("text", WHITE), "").alias("words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(VISIBLE)).alias("lines"),
    )
    counted = split.select(
        "doc_id",
        "host",
        "words",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") < 3, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda at: F.xxhash64(*(F.get("words", at + k) for k in range(3)))))
        .alias("hashes"),
    )
    # Windows are told apart by hash first: where all hashes differ, so do all windows. Only the other texts
    # sort the windows themselves, and a window repeats when it equals a neighbour in that order.
    windows = F.transform(
        F.sequence(F.lit(0), F.size("words") - 3),
        lambda at: F.struct(F.concat_ws(" ", *(F.get("words", at + k) for k in range(3))).alias("text"), at.alias("at")),
    )
    none = F.array().cast("array<struct<text:string,at:int>>")
    ordered = counted.withColumn("ordered", F.when(F.size(F.array_distinct("hashes")) == F.size("hashes"), none).otherwise(F.sort_array(windows)))

    def text_at(place: Column) -> Column:
        return F.get("ordered", place)["text"]

    def repeats(place: Column) -> Column:
        return F.coalesce(text_at(place) == text_at(place - 1), F.lit(False)) | F.coalesce(text_at(place) == text_at(place + 1), F.lit(False))

    starts = F.transform(F.filter(F.sequence(F.lit(0), F.size("ordered") - 1), repeats), lambda place: F.get("ordered", place)["at"])
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda at: F.array(at, at + 1, at + 2))))
    return ordered.withColumn("n_repeat_words", F.when(F.size("ordered") == 0, F.lit(0)).otherwise(F.size(covered)).cast("long")).select(*MEASURES)


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``host, n_docs, rate_<rule> ..., host_failed``: one row per host of a table of measures.

    The beta prior of a rule has the corpus rate as its mean; its strength comes from the method of moments,
    from what the hosts' rates vary beyond what their sizes explain. Documents without a host belong to none.
    """
    failed = {rule: F.sum(F.expr(condition).cast("long")).alias(f"n_{rule}") for rule, condition in RULES.items()}
    hosts = measured.filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), *failed.values())
    # One row for the whole corpus: sums and sums of squares by rule.
    totals = hosts.agg(
        F.count("*").alias("n_hosts"),
        F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
        *(F.sum(f"n_{rule}").alias(f"sum_{rule}") for rule in RULES),
        *(F.sum(F.col(f"n_{rule}") * F.col(f"n_{rule}") / F.col("n_docs")).alias(f"squares_{rule}") for rule in RULES),
    ).first()
    rates = {}
    for rule in RULES:
        alpha, strength = prior(totals["n_hosts"], totals["n_docs"], totals[f"sum_{rule}"], totals[f"squares_{rule}"])
        rates[rule] = (F.col(f"n_{rule}") + F.lit(alpha)) / (F.col("n_docs") + F.lit(strength))
    worst = F.greatest(*rates.values())
    return hosts.select("host", "n_docs", *(rate.alias(f"rate_{rule}") for rule, rate in rates.items()), (worst > limit).alias("host_failed"))


def prior(n_hosts: int, n_docs: int, failures: int | None, squares: float | None) -> tuple[float, float]:
    """Alpha and alpha + beta of the prior of one rule."""
    if not n_docs:
        return 0.0, WEAKEST
    mean = failures / n_docs
    spread = mean * (1 - mean)
    between = squares / n_docs - mean * mean - spread * n_hosts / n_docs
    strength = STRONGEST if between <= 0 else min(max(spread / between - 1, WEAKEST), STRONGEST)
    return mean * strength, strength


def quality_rules(docs: DataFrame, limit: float = HOST_LIMIT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The measures, ``base_failed``, ``host_failed`` and ``kept`` for every row.

    A document fails by itself when it has fewer than 50 words or more than half of its words in repeated
    windows; otherwise it is kept unless its host is rejected. A null text has no words; a null host is never
    rejected; a null id stays null; repeated rows count and are judged each; an empty table gives none; other
    columns are left out. The slim measures are cut off through the shared checkpoint folder, so texts are
    measured once; verdicts travel on (host, salt), so that a host with a third of all rows is split.
    """
    measured = materialize(measures(docs, id_col, text_col, host_col))
    rejected = host_verdicts(measured, limit).filter("host_failed").select(F.col("host").alias("bad_host"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("bad_salt"))
    salted = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    judged = salted.join(rejected, (F.col("host") == F.col("bad_host")) & (F.col("salt") == F.col("bad_salt")), "left")
    base = F.expr(" OR ".join(f"({RULES[rule]})" for rule in BASE_RULES))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), F.col("bad_host").isNotNull().alias("host_failed")
    ).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def keep_good(docs: DataFrame, limit: float = HOST_LIMIT, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; rows are judged each, whatever their ids."""
    keyed = numbered_rows(docs, "_row")
    rejected = quality_rules(keyed, limit, "_row", text_col, host_col).filter("NOT kept").select(F.col("doc_id").alias("_row"))
    return without_rows(keyed, rejected, "_row").drop("_row")
