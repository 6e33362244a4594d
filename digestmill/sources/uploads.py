"""Uploaded files: read, classify, decode, extract text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill import schemas as S
from digestmill.functions import markup as M
from digestmill.functions import text as T

_HIDDEN, _TITLE, _ARTICLE, _MAIN, _BODY = 1, 2, 4, 8, 16
# Kinds whose text another program has to extract first.
_FOREIGN = {"uploaded_pdf": "PDF", "uploaded_docx": "DOCX", "uploaded_epub": "EPUB"}


def _suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(path, "/", -1), r".\.([^.]*)$", 1))


def classify(files: DataFrame, max_bytes: int = K.MAX_UPLOAD_BYTES, cap_bytes: int | None = None) -> DataFrame:
    """Adds ``input_kind`` or an error to files ``(path, length, content)``; ``cap_bytes`` bounds what ``max_bytes`` may ask for."""
    suffix = _suffix(F.col("path"))
    limit = max(1, int(max_bytes) if cap_bytes is None else min(int(max_bytes), cap_bytes))
    kind = T.first_match(
        [
            (suffix.isin(*K.TEXT_SUFFIXES), "uploaded_text"), (suffix.isin(*K.HTML_SUFFIXES), "uploaded_html"),
            (suffix == "docx", "uploaded_docx"), (suffix == "epub", "uploaded_epub"), (suffix == "pdf", "uploaded_pdf"),
        ]
    )
    code = T.first_match(
        [
            (kind.isNull(), "unsupported_document"), ((F.col("length") <= 0) | (F.col("length") > limit), "document_too_large"),
            (kind.isin(*_FOREIGN), "dependency_missing"),
        ]
    )
    message = T.first_match(
        [
            (code == "unsupported_document", F.concat(F.lit("Unsupported local file type: "), T.first_present(suffix, F.lit("unknown")), F.lit("."))),
            (code == "document_too_large", F.lit(f"The attachment must be between 1 byte and {limit // (1024 * 1024)} MiB.")),
            *[(kind == name, F.lit(f"A {label} text extractor is required to extract uploaded {label} text.")) for name, label in _FOREIGN.items()],
        ]
    )
    return files.withColumn("input_kind", kind).withColumn("error_code", code).withColumn("error_message", message)


def read_uploads(spark: SparkSession, folder: str, max_bytes: int = K.MAX_UPLOAD_BYTES) -> DataFrame:
    """One row per file: ``path, length, content, input_kind, error_code, error_message``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return classify(files.select("path", "length", "content"), max_bytes)


def decode_text(content: Column) -> Column:
    """UTF-8 text without a byte-order mark; NULL for other encodings, which the Arrow stage decodes."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^﻿", ""))


def _decode(raw: bytes) -> str:
    for encoding in ("utf-8-sig", "gb18030"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def html_text(html: Column) -> Column:
    """Title and the text of the main element: article, main, body, or all of the page."""

    def mark(name: Column, tag: Column) -> Column:
        return M.marks([(name.isin("script", "style", "noscript", "template"), _HIDDEN), (name == "title", _TITLE), (name == "article", _ARTICLE), (name == "main", _MAIN), (name == "body", _BODY)])

    def read(page: Column) -> Column:
        found = page["found"]
        everything = F.struct(F.lit(-1).alias("at"), F.size(page["stream"]).alias("end"), F.lit(0).alias("mark"))
        body = F.coalesce(*[M.first_with(found, kind) for kind in (_ARTICLE, _MAIN, _BODY)], everything)

        def with_words(words: Column) -> Column:
            return F.concat_ws("\n", T.present(M.said(words, M.first_with(found, _TITLE), " ")), T.present(M.said(words, body, "\n")))

        return T.let(M.texts(page["stream"], M.with_mark(found, _HIDDEN)), with_words)

    return T.let(M.tokens(html, mark), lambda stream: T.let(F.struct(stream.alias("stream"), M.elements(stream, _HIDDEN).alias("found")), read))


_ARROW = pa.schema([("path", pa.string()), ("text", pa.string()), ("error_code", pa.string()), ("error_message", pa.string()), ("input_kind", pa.string())])


def _decode_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text of the files that came with bytes, which are not UTF-8; the others already have theirs."""
    for batch in batches:
        rows = batch.to_pylist()
        for row in rows:
            raw = row.pop("payload")
            if raw is not None:
                row["text"] = _decode(raw)
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def clean_lines(text: Column) -> Column:
    for pattern, value in ((r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, value)
    return T.strip(text)


def uploads_to_text(uploads: DataFrame) -> DataFrame:
    """``path, input_kind, text, error_code, error_message`` in one pass over the files.

    UTF-8 is decoded and HTML is read natively; only bytes of other encodings go through Python, and only to be decoded.
    """
    usable = F.col("error_code").isNull()
    staged = uploads.select("path", F.when(usable, decode_text(F.col("content"))).alias("text"), "error_code", "error_message", "input_kind", F.when(usable, F.col("content")).alias("content"))
    slim = staged.select("path", "text", "error_code", "error_message", "input_kind", F.when(F.col("text").isNull(), F.col("content")).alias("payload"))
    read = slim.mapInArrow(_decode_rest, S.UPLOAD_TEXT + ", input_kind STRING")
    return read.withColumn("text", F.when(F.col("input_kind") == "uploaded_html", clean_lines(html_text(F.col("text")))).otherwise(F.col("text")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Regression samples, one row each; absent keys are NULL."""
    return spark.read.schema(S.SAMPLES).option("multiLine", "true").json(path).select(F.explode("samples").alias("s")).select("s.*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages from Parquet: ``page_id, url, html``."""
    return spark.read.parquet(path).select("page_id", "url", "html")
