"""The main paths end to end: links to digests and uploads to digests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import text as T
from digestmill.functions import urls as U
from digestmill.functions.scale import materialize
from digestmill.operators import cache as C
from digestmill.operators import digest as D
from digestmill.operators import pages as P
from digestmill.operators.ledger import document_gate
from digestmill.operators.urls import route


@dataclass
class Ingested:
    """``rejected(job_id, error_code)``, ``cached(job_id, result_json)``, ``digests`` (one per distinct
    source) and ``jobs(job_id, doc_key, error_code)`` for the submissions that had to be worked on."""

    rejected: DataFrame
    cached: DataFrame
    digests: DataFrame
    jobs: DataFrame


def _whole(text: Column, max_chars: int | None, separator: str) -> Column:
    """The text, cut to ``max_chars`` where a caller asks for it."""
    return text if max_chars is None else T.truncate_text(text, max_chars, separator)


def _extract(pages: DataFrame, parser: bool) -> DataFrame:
    """``canonical_url, title, text, author, published_at, error_code`` per crawled page."""
    null = F.lit(None).cast("string")
    if not parser:
        light = P.extract_pages_light(pages)
        return light.select(F.col("url").alias("canonical_url"), "title", "text", null.alias("author"), null.alias("published_at"), null.alias("error_code"))
    chat = U.source_type(F.col("url")) == "wechat"
    article = P.extract_pages_article(pages.filter(~chat)).select(
        F.col("url").alias("canonical_url"), "title", "text", "author", "published_at", null.alias("error_code")
    )
    wechat = P.extract_wechat(pages.filter(chat)).select(
        F.col("url").alias("canonical_url"), "title", "text", "author", "published_at", "error_code"
    )
    return article.unionByName(wechat)


def ingest_links(
    submissions: DataFrame, pages: DataFrame, cache: DataFrame, library: DataFrame, context: str, now=None,
    ttl_seconds: int = K.CACHE_TTL_SECONDS, parser: bool = True, reuse: bool = True, max_chars: int | None = None,
) -> Ingested:
    """Submitted links ``(job_id, url, instruction, summary_quality, force_refresh)`` to digests.

    Cached answers leave before any page is read. Each distinct source and instruction is digested once,
    however many jobs ask for it, and only pages that are asked for reach the parser. With ``reuse`` the
    lookup and the extracts are kept in the checkpoint folder, because several outputs read them.
    """
    keep = materialize if reuse else lambda frame: frame
    checked = submissions.withColumn("reason", U.url_status(F.col("url")))
    rejected = checked.filter("reason IS NOT NULL").select("job_id", F.lit("invalid_url").alias("error_code"), F.col("reason").alias("error_message"))
    routed = route(checked.filter("reason IS NULL")).withColumn("canonical_url", U.canonical_url(F.col("url")))
    keyed = routed.withColumn(
        "cache_key", C.cache_key(F.col("canonical_url"), F.col("instruction"), F.col("summary_quality"), F.lit(context))
    )
    looked = keep(C.cache_lookup(keyed, cache, library, ttl_seconds, now))
    cached = looked.filter("hit").select("job_id", "result_json")
    misses = looked.filter("NOT hit").withColumn("doc_key", F.sha2("cache_key", 256))
    work = misses.groupBy("doc_key").agg(
        F.first("canonical_url").alias("canonical_url"), F.first("source_type").alias("source_type"), F.first(T.strip(F.col("instruction"))).alias("instruction")
    )
    # One page per asked-for address, chosen on keys alone before any HTML moves.
    keys = pages.select("page_id", U.canonical_url(F.col("url")).alias("url"))
    asked = keys.join(work.select(F.col("canonical_url").alias("url")).distinct(), "url", "left_semi")
    chosen = asked.groupBy("url").agg(F.min("page_id").alias("page_id"))
    wanted = pages.drop("url").join(chosen, "page_id")
    usable = P.usable_extracts(
        _extract(wanted, parser).withColumnRenamed("canonical_url", "url"), wanted.limit(0).select("url", F.lit("").alias("title"), F.lit("").alias("text"))
    ).withColumnRenamed("url", "canonical_url")
    documents = keep(
        work.join(usable.drop("from_fallback"), "canonical_url", "left").withColumn(
            "error_code", F.when(F.col("text").isNull(), F.coalesce("error_code", F.lit("extraction_failed")))
        )
    )
    ready = documents.filter("error_code IS NULL").select(
        F.col("doc_key").alias("doc_id"), "canonical_url", "source_type", "instruction", T.first_present(F.col("title"), F.col("canonical_url")).alias("title"),
        _whole(F.col("text"), max_chars, " ").alias("content_text"), F.lit("html_metadata_readability").alias("extraction_method"),
    )
    jobs = misses.select("job_id", "doc_key").join(documents.select("doc_key", "error_code"), "doc_key")
    return Ingested(rejected, cached, D.digests(ready), jobs)


def ingest_documents(uploads: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Upload texts ``(upload_id, title, content, source_url, instruction)`` to digests.

    A text that was uploaded several times is digested once; ``doc_id`` is the key of the content that is kept:
    whole texts, or their first ``max_chars`` characters.
    """
    gated = document_gate(uploads)
    source = U.connector_source(F.col("source_url"), F.col("title"))
    good = gated.filter("error_code IS NULL").withColumn("s", source).filter("s.error_code IS NULL")
    text = _whole(F.col("content"), max_chars, "\n")
    keyed = good.withColumn("content_text", text).withColumn(
        "doc_id", C.content_key(F.col("title"), F.col("content_text"), F.col("s.source_type"), F.col("s.source_url"))
    )
    # Keys first: the texts themselves are only fetched for the upload that stands for each key.
    chosen = keyed.groupBy("doc_id").agg(F.min("upload_id").alias("upload_id"))
    documents = keyed.join(chosen, ["doc_id", "upload_id"], "left_semi").select(
        "doc_id", "title", "content_text", "instruction", F.col("s.source_url").alias("canonical_url"), F.col("s.source_type").alias("source_type"),
        F.col("s.extraction_method").alias("extraction_method"),
    )
    return D.digests(documents)
