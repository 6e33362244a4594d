"""Sinks: library files, resource packages, snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestmill import constants as K
from digestmill.functions import text as T
from digestmill.functions.scale import exploded
from digestmill.operators import transcripts as R
from digestmill.operators.library import output_paths


def digest_content(markdown: Column, link: Column) -> Column:
    """Digest text as written: its timeline placeholder becomes a link."""
    return F.concat(F.replace(T.rstrip(markdown), F.lit(K.TIMELINE_LINK), link), F.lit("\n"))


def library_files(digests: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Digests with their path and written content; ``stored`` holds the files there are (see ``output_paths``)."""
    placed = output_paths(digests, stored)
    return placed.withColumn("content", digest_content(F.col("summary_markdown"), F.concat("file_stem", F.lit("/timeline.md"))))


def write_library(digests: DataFrame, root: str) -> None:
    """Append to a library partitioned by date and source.

    Names are numbered after those that are stored already, and digests whose ``doc_id`` the library holds at
    their date and source are left out, so that a retried write adds nothing twice. Only the slim columns of
    the touched dates are read. Ranges over the path keep the files of a day together and still split a day
    that holds a large share of the rows. One writer at a time.
    """
    spark = digests.sparkSession
    stored = None
    if stored_partitions(spark, root):
        touched = digests.select(F.date_format("written_at", "yyyy-MM-dd").alias("date")).distinct()
        stored = spark.read.parquet(root).select("doc_id", F.col("date").cast("string").alias("date"), "source_dir", "file_stem")
        stored = stored.join(touched, "date", "left_semi")
    files = library_files(digests, stored).repartitionByRange("date", "source_dir", "file_stem")
    files.write.mode("append").partitionBy("date", "source_dir").parquet(root)


def stored_partitions(spark: SparkSession, root: str) -> bool:
    """Whether a library was written at ``root``, on whatever file system Spark reaches it by."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _or_null(frame: DataFrame, name: str) -> Column:
    return F.col(name) if name in frame.columns else F.lit(None).cast("string")


def _file(name: str, content: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), content.alias("content"))


def resource_package(digests: DataFrame) -> DataFrame:
    """``doc_id, file_name, content``: every non-empty file of a digest's package, in one projection."""

    def col(name: str) -> Column:
        return _or_null(digests, name)

    def line_end(text: Column) -> Column:
        return F.concat(T.rstrip(T.present(text)), F.lit("\n"))

    marker = "\n\nTranscript:\n\n"
    inline = T.strip(F.substr(F.col("content_text"), F.locate(marker, F.col("content_text")) + len(marker)))
    stamped = F.coalesce(T.present(col("transcript_with_timestamps")), F.when(F.contains("content_text", F.lit(marker)), inline), F.lit(""))
    plain = F.coalesce(T.present(col("transcript_text")), R.plain_transcript(F.col("_stamped")))
    markdown = F.when(F.coalesce(col("content_markdown") != F.col("content_text"), F.lit(False)), col("content_markdown"))
    about = ["title", "canonical_url", "source_type", "author", "published_at", "extraction_method"]
    metadata = F.to_json(
        F.struct(
            *[_or_null(digests, name).alias(name) for name in (*about, "source_url", "language", "subtitle_status", "subtitle_source", "transcript_origin")],
            (F.col("tags") if "tags" in digests.columns else F.array().cast("array<string>")).alias("tags"),
        )
    )
    rows = digests.withColumn("_stamped", stamped)
    contents = {
        "summary.md": digest_content(F.col("summary_markdown"), F.lit("timeline.md")),
        "source_content.txt": line_end(F.col("content_text")),
        "source_markdown.md": line_end(markdown),
        "subtitle.vtt": line_end(col("subtitle_vtt")),
        "transcript_with_timestamps.txt": line_end(F.col("_stamped")),
        "transcript.txt": line_end(plain),
        "timeline.md": line_end(R.full_timeline(F.col("canonical_url"), F.col("_stamped"))),
        "raw_metadata.json": line_end(col("raw_metadata")),
        "metadata.json": line_end(metadata),
    }
    files = F.filter(F.array(*[_file(name, content) for name, content in contents.items()]), lambda file: file["content"].isNotNull())
    packed = rows.select("*", files.alias("_files"))
    info = F.to_json(
        F.struct(
            F.col("title"), F.col("canonical_url").alias("url"), *[_or_null(packed, name).alias(name) for name in about[2:]],
            *[_or_null(packed, name).alias(name) for name in ("subtitle_status", "subtitle_source", "transcript_origin", "transcript_origin_label", "duration")],
            F.array_sort(F.transform("_files", lambda file: file["name"])).alias("resource_files"),
        )
    )
    whole = F.concat("_files", F.array(_file("source_info.json", F.concat(info, F.lit("\n")))))
    return exploded(packed, ["doc_id"], whole, "f").select("doc_id", F.col("f.name").alias("file_name"), F.col("f.content").alias("content"))


def table_facts(name: str, frame: DataFrame) -> DataFrame:
    """``table_name, rows, checksum``: the checksum does not depend on the order of rows, and other engines can repeat it.

    It is the sum of the first 60 bits of the MD5 of each row, with columns as text in their order, a unit separator
    between them and one NUL character for a NULL. Floating-point numbers are written as ``text.number_text`` does.
    """
    texts = [
        F.coalesce(T.number_text(F.col(column)) if kind in ("double", "float") else F.col(column).cast("string"), F.lit("\0"))
        for column, kind in frame.dtypes
    ]
    number = F.conv(F.left(F.md5(F.concat_ws("\x1f", *texts)), F.lit(15)), 16, 10).cast("decimal(38,0)")
    checksum = F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")).cast("string")
    return frame.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows"), checksum.alias("checksum"))


def snapshot(tables: dict[str, DataFrame], root: str, at: dt.datetime | None = None) -> DataFrame:
    """Point-in-time copy of tables under a stamped folder, with a manifest row per table.

    Nothing is overwritten: a stamp is used once, and the manifest is written last, so a broken copy
    has none.
    """
    moment = at or dt.datetime.now(dt.timezone.utc)
    stamp = moment.strftime("%Y%m%d-%H%M%S")
    manifest = None
    for name, frame in tables.items():
        folder = f"{root}/{stamp}/{name}"
        frame.write.mode("errorifexists").parquet(folder)
        facts = table_facts(name, frame.sparkSession.read.parquet(folder)).withColumn("folder", F.lit(folder))
        manifest = facts if manifest is None else manifest.unionByName(facts)
    stamped = manifest.withColumn("created_at", F.lit(moment.isoformat(timespec="seconds")))
    stamped.coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifests/stamp={stamp}")
    return stamped


def latest_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """Manifest rows of the newest complete snapshot."""
    manifests = spark.read.option("basePath", f"{root}/manifests").parquet(f"{root}/manifests")
    newest = manifests.agg(F.max("created_at").alias("m"))
    return manifests.filter(F.col("created_at") == newest.scalar())
