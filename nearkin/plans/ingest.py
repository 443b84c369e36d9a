"""Incremental ingest: new files to text, vectors and stored documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.functions import text as X
from nearkin.operators import incremental
from nearkin.operators.embedding import Embedder, embed_documents
from nearkin.sources.files import extracted, read_folder, utf8_text
from nearkin.sources.storage import durable, read_or_empty, spread

STORED = (
    "id string, filename string, text string, embedding array<double>, "
    "ingested_at timestamp, error string, status string"
)
OK, REJECTED = "ok", "rejected"
EMPTY_TEXT = "no text after cleaning"


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents ingested so far; rejected files are another partition."""
    rows = read_or_empty(spark, path, STORED).where(F.col("status") == OK)
    return rows.drop("error", "status")


def rejected_files(spark: SparkSession, path: str) -> DataFrame:
    """Files that gave no document, and why; one row for each, however often tried."""
    rows = read_or_empty(spark, path, STORED).where(F.col("status") == REJECTED)
    last = F.max_by(F.struct("error", "ingested_at"), "ingested_at").alias("last")
    # a file is tried again by each run, the last try counts
    return rows.groupBy("id", "filename").agg(last).select("id", "filename", "last.*")


def prepare_documents(
    files: DataFrame,
    existing: DataFrame,
    embedder: Embedder,
    *,
    extractor: Callable[[bytes], str] = utf8_text,
    within_batch: str = incremental.KEEP,
    cache_path: str | None = None,
    **embed_options,
) -> DataFrame:
    """``filename, content`` rows to stored rows, both good and rejected.

    Files already stored leave before they are extracted or embedded, and only
    text that survived cleaning is embedded. Contents are never shuffled: they are
    read once for their hashes, and again for those that are new.
    """
    file_id = X.content_id(F.col("content")).alias("id")
    hashed = files.select(file_id, "filename", "content")
    new, twice = incremental.new_files(hashed, existing, within_batch)
    read = read_texts(new, extractor)
    if twice:
        read = read.dropDuplicates(["id"])
    return finished_documents(read, embedder, cache_path=cache_path, **embed_options)


def read_texts(files: DataFrame, extractor: Callable[[bytes], str]) -> DataFrame:
    """``id, filename, content`` rows to ``id, filename, text, error``, text cleaned."""
    read = files.withColumn("_x", extracted(F.col("content"), extractor)).select(
        "id", "filename", X.clean_text(F.col("_x.text")).alias("text"), "_x.error"
    )
    empty = F.when(F.col("text") == "", F.lit(EMPTY_TEXT))
    return read.withColumn("error", F.coalesce("error", empty))


def finished_documents(
    read: DataFrame, embedder: Embedder, *, cache_path: str | None = None, **embed_options
) -> DataFrame:
    """``id, filename, text, error`` rows to stored rows."""
    read = read.withColumnRenamed("error", "_bad")
    # from here on texts, which may move; with a cache they are read several times
    read = durable(read, "texts") if cache_path is not None else spread(read)
    out = embed_documents(
        read, embedder, cache_path=cache_path, spread_out=cache_path is not None, **embed_options
    )
    error = F.coalesce("_bad", "error")
    return out.select(
        "id",
        "filename",
        "text",
        "embedding",
        F.current_timestamp().alias("ingested_at"),
        error.alias("error"),
        F.when(error.isNull(), F.lit(OK)).otherwise(F.lit(REJECTED)).alias("status"),
    )


def ingest_files(files: DataFrame, path: str, embedder: Embedder, **options) -> None:
    """Append the new ones among ``filename, content`` rows to a document table.

    Good and rejected rows go out in one write, as two partitions, so nothing
    is extracted or embedded twice.
    """
    existing = stored_documents(files.sparkSession, path).select("id")
    store_documents(prepare_documents(files, existing, embedder, **options), path)


def store_documents(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("status").parquet(path)


def ingest_folder(
    spark: SparkSession,
    folder: str,
    path: str,
    embedder: Embedder,
    *,
    suffix: str = ".pdf",
    literal: str | None = None,
    **options,
) -> None:
    """Ingest the matching files of a folder that are not stored yet."""
    ingest_files(read_folder(spark, folder, suffix, literal), path, embedder, **options)
