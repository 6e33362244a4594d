"""Small helpers the operators share: reading the wanted columns, Arrow batches, spans."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from digestmill.functions.scale import materialize, shared_folder

# Row numbers and ids are broadcast up to this number, 8 bytes each; more are joined.
MOST_BROADCAST = 1_000_000
# Rows of one file at most, in bits.
_FILE_BITS = 40

# Span lists are ordered by start, then by the order in which an operator lists its kinds.
Span = tuple[str, int, int]


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under the names ``doc_id`` and ``text``; a null text is empty.

    Whatever else a table carries, clashing names included, stays out of the operator's plan.
    """
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def release() -> None:
    """Give back what Arrow keeps of earlier batches: a worker outlives its task, and its memory counts for the next stage."""
    pa.default_memory_pool().release_unused()


def released(batches: Iterable) -> Iterator:
    """The same batches; Arrow keeps no memory of those that are done with."""
    for batch in batches:
        yield batch
        release()


def by_ids(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of a slim frame whose id is in ``ids`` (``doc_id``, a table that is cheap to count)."""
    return texts.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi")


def numbered_rows(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number for every row, the same each time it is computed.

    Rows of Parquet files are numbered by file and place in the file; any other frame is written to the shared folder
    first. The driver lists the files, as it does for every scan of them.
    """
    try:
        placed = bool(docs.inputFiles()) and docs.select("_metadata.row_index")
    except AnalysisException:
        placed = False
    if not placed:
        path = f"{shared_folder(docs.sparkSession)}/rows-{uuid.uuid4().hex}"
        docs.write.parquet(path)
        docs = docs.sparkSession.read.parquet(path)
    columns = docs.columns
    files = sorted(row["file"] for row in docs.select(F.col("_metadata.file_path").alias("file")).distinct().collect())
    # An Arrow table, as rows of Python would go through a second set of workers, which every executor then keeps.
    numbers = docs.sparkSession.createDataFrame(pa.table({"_number": pa.array(range(len(files)), pa.int64()), "_file": pa.array(files, pa.string())}))
    held = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    key = F.col("_number") * (1 << _FILE_BITS) + F.col("_place")
    return held.join(F.broadcast(numbers), "_file").select(*columns, key.alias(name))


def without_rows(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose number is in ``dropped``; few numbers are broadcast, so that no text moves."""
    dropped = materialize(dropped)
    return docs.join(F.broadcast(dropped) if dropped.count() <= MOST_BROADCAST else dropped, name, "left_anti")


def largest(frame: DataFrame, rank: str, most: int) -> list[Row]:
    """The ``most`` rows of a cut-off table with the largest whole numbers in ``rank``, in that order.

    A histogram of 1,024 parts is refined around the cut-off until the part that holds it is small; only rows from
    there on come to the driver, not the first ones of every partition.
    """
    low, high = frame.agg(F.min(rank), F.max(rank)).first()
    if low is None or most < 1:
        return []
    wanted = most
    while high > low:
        width = -(-(high - low + 1) // 1024)
        part = F.expr(f"({rank} - {low}L) div {width}L").alias("part")
        counts = {row["part"]: row["n"] for row in frame.filter(F.col(rank).between(low, high)).groupBy(part).agg(F.count("*").alias("n")).collect()}
        place = min(counts)
        for at in sorted(counts, reverse=True):
            if counts[at] >= wanted:
                place = at
                break
            wanted -= counts[at]
        low, high = low + place * width, min(high, low + place * width + width - 1)
        if counts[place] <= most:
            break
    return frame.filter(F.col(rank) >= low).orderBy(F.desc(rank)).limit(most).collect()


def per_document(frame: DataFrame, schema: str, worker: Callable[[], Callable[[str], tuple]]) -> DataFrame:
    """``doc_id`` and the columns of ``schema`` for every row of a ``slim`` frame.

    ``worker`` runs once per task and returns the function from a text to its column values, so tables
    and caches are built once and live as long as the task. Rows stay in their partition.
    """

    fields = StructType.fromDDL(schema).fields
    kinds = {field.name: to_arrow_type(field.dataType) for field in fields}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = worker()
        for batch in batches:
            if batch.num_rows:
                columns = zip(*map(function, batch.column(1).to_pylist()), strict=True)
                arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *kinds])

    id_type = dict(frame.dtypes)["doc_id"]
    return frame.mapInArrow(run, f"doc_id {id_type}, {schema}")


def span_text(spans: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def span_digest(spans: Iterable[Span]) -> str:
    return hashlib.sha256(span_text(spans).encode()).hexdigest()


def in_order(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    rank = {kind: place for place, kind in enumerate(kinds)}
    return sorted(spans, key=lambda span: (span[1], rank[span[0]], span[2]))
