"""Ingest as a stream of arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearkin.functions import text as X
from nearkin.operators.embedding import Embedder
from nearkin.operators.incremental import FIRST, new_only
from nearkin.plans.ingest import (
    finished_documents,
    ingest_files,
    read_texts,
    store_documents,
    stored_documents,
)
from nearkin.sources.files import read_hidden, stream_folder, utf8_text
from nearkin.sources.storage import durable
from nearkin.streaming.seen import fresh_files


def start_ingest(
    files: DataFrame,
    path: str,
    checkpoint: str,
    embedder: Embedder,
    *,
    extractor: Callable[[bytes], str] = utf8_text,
    **options,
) -> StreamingQuery:
    """Ingest all files that have arrived, then stop.

    ``files`` is a stream of ``filename, content``. Keyed state tells which ids are
    stored already, so what a micro-batch costs doesn't depend on how many are; texts
    are read before that, so that contents stay where they are. Of equal files in a
    micro-batch the first by name is kept. Only the first micro-batch of a run can be
    one that was stored before and not yet committed, and is held against the table.
    Files without text are told by ``rejected_files`` and tried again when they arrive
    again in a later run.
    """
    file_id = X.content_id(F.col("content")).alias("id")
    texts = read_texts(files.select(file_id, "filename", "content"), extractor)
    begun = False

    def store(batch: DataFrame, _: int) -> None:
        nonlocal begun
        if not begun:
            existing = stored_documents(batch.sparkSession, path).select("id")
            batch = new_only(durable(batch, "arrived"), existing)
            begun = True
        store_documents(finished_documents(batch, embedder, **options), path)

    writer = fresh_files(texts, path).writeStream.foreachBatch(store)
    return (
        writer.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_folder_ingest(
    spark: SparkSession,
    folder: str,
    path: str,
    checkpoint: str,
    embedder: Embedder,
    *,
    suffix: str = ".pdf",
    literal: str | None = None,
    max_files: int | None = None,
    **options,
) -> StreamingQuery:
    """``start_ingest`` over the matching files of a folder.

    Files with names no stream delivers are ingested in batch beforehand.
    """
    hidden = read_hidden(spark, folder, suffix, literal)
    if hidden is not None:
        ingest_files(hidden, path, embedder, within_batch=FIRST, **options)
    files = stream_folder(spark, folder, suffix, literal, max_files)
    return start_ingest(files, path, checkpoint, embedder, **options)
