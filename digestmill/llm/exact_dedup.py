"""Exact duplicates by a tree merge of sorted digest runs.

Every row gets a digest and, by its id, a run. A run holds one entry per digest: the id that would stay and
the number of rows behind it. In each round eight neighbouring runs are merged into one, which is three
rounds of a binomial exchange at once, until one run is left; its entries then go back down the same tree to
the rows. No key at any level has more than eight entries to merge, so a text that a third of all rows share
is met by every task a little and by none wholly. Runs are spread over all tasks by (run, digest).

Digests are SHA-256 of the whole folded text, kept with its length: entries merge only if both agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill.functions.scale import materialize
from digestmill.llm.rows import numbered_rows, slim, without_rows

FAN_BITS = 3
# Runs per shuffle partition, at least: enough that a hot digest is spread over all of them.
RUNS_PER_PARTITION = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; an all-ASCII text takes the quick path to the same result."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def tree_rounds(docs: DataFrame) -> int:
    """Rounds for a tree with enough runs for the session's shuffle partitions."""
    wanted = RUNS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while (1 << (FAN_BITS * rounds)) < wanted:
        rounds += 1
    return rounds


def exact_duplicates(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", rounds: int | None = None) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per document, dropped ones too.

    Texts are equal when identical after lower-casing A-Z; a null text is empty. ``keep`` names the id that
    stays, "smallest" or "largest". A null id loses against any other and stays only where its group has none;
    rows that repeat both id and text count each and share one verdict. An empty table gives no row; other
    columns are left out.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    best = F.min if keep == "smallest" else F.max
    rounds = rounds or tree_rounds(docs)
    folded = slim(docs, id_col, text_col).select("doc_id", lower_ascii(F.col("text")).alias("folded"))
    rows = folded.select(
        "doc_id",
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << (FAN_BITS * rounds))).alias("run"),
        F.unhex(F.sha2("folded", 256)).alias("digest"),
        F.octet_length("folded").alias("n_bytes"),
    )
    key = ["run", "digest", "n_bytes"]
    first = rows.groupBy(*key).agg(best("doc_id").alias("best"), F.count("*").alias("n_rows")).sortWithinPartitions(*key)
    levels = [materialize(first)]
    for _ in range(rounds):
        parents = levels[-1].withColumn("run", F.shiftright("run", FAN_BITS))
        levels.append(parents.groupBy(*key).agg(best("best").alias("best"), F.sum("n_rows").alias("n_rows")))
    # Only texts with copies have anything to tell the rows.
    verdict = levels.pop().filter("n_rows > 1").select(*key, F.col("best").alias("keep_id"), F.col("n_rows").alias("group_size"))
    while levels:
        children = levels.pop().select("run", F.shiftright("run", FAN_BITS).alias("parent"), "digest", "n_bytes")
        verdict = children.join(verdict.withColumnRenamed("run", "parent"), ["parent", "digest", "n_bytes"]).drop("parent")
    found = rows.join(verdict, key, "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep_id.alias("keep_id"), size.alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256")).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_duplicates(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each text, with all its columns: that with the smallest or largest id.

    Rows are judged each, also where they repeat an id or have none; a null id loses against any other, and of equal
    ids the first row stays.
    """
    keyed = numbered_rows(docs, "_row")
    missing = keyed[id_col].isNull() if keep == "smallest" else keyed[id_col].isNotNull()
    row = F.col("_row") if keep == "smallest" else -F.col("_row")
    ranked = keyed.select(F.struct(missing.alias("missing"), keyed[id_col].alias("id"), row.alias("row")).alias("rank"), keyed[text_col].alias("text"))
    dropped = exact_duplicates(ranked, keep, "rank", "text").filter("NOT kept").select(F.abs("doc_id.row").alias("_row"))
    return without_rows(keyed, dropped, "_row").drop("_row")
