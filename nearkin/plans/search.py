"""Searches: query texts or files to ranked hits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.functions import text as X
from nearkin.functions import vectors as V
from nearkin.operators.embedding import Embedder, embed_documents
from nearkin.operators.neighbors import hit_list, knn, knn_overfetch, with_metadata
from nearkin.operators.reduce import BACKGROUND, NEIGHBOUR, pca_2d, role_table
from nearkin.sources.files import extracted, utf8_text

PREVIEW_CHARS = 1000


def query_vectors(queries: DataFrame, embedder: Embedder, **embed_options) -> DataFrame:
    """``query_id, v`` from ``query_id, text``; an embedding failure is an error."""
    cleaned = queries.select("query_id", X.clean_text(F.col("text")).alias("text"))
    embedded = embed_documents(cleaned, embedder, **embed_options)
    failed = F.raise_error(
        F.concat(F.lit("query "), F.col("query_id").cast("string"), F.lit(": "), "error")
    )
    return embedded.select("query_id", F.coalesce("embedding", failed).alias("v"))


def search_texts(
    table: DataFrame,
    queries: DataFrame,
    embedder: Embedder,
    k: int = 5,
    *,
    id_map: DataFrame | None = None,
    knn_options: dict | None = None,
    **embed_options,
) -> DataFrame:
    """Nearest documents by L2 distance, queries chunked as documents are.

    Filenames ride along in the vector table; with a separate ``id_map`` a hit
    that has no entry fails the job.
    """
    wanted = query_vectors(queries, embedder, **embed_options)
    options = knn_options or {}
    if id_map is None:
        return knn(table, wanted, k, V.L2, carry=("filename",), **options)
    return with_metadata(knn(table, wanted, k, V.L2, **options), id_map, default=None)


def read_query_files(
    files: DataFrame, extractor: Callable[[bytes], str] = utf8_text
) -> DataFrame:
    """``query_id, text, preview, error`` from ``query_id, content``.

    Files that cannot be read or hold no text carry an error instead.
    """
    out = files.withColumn("_x", extracted(F.col("content"), extractor)).select(
        "query_id", X.clean_text(F.col("_x.text")).alias("text"), "_x.error"
    )
    empty = F.when(F.col("text") == "", F.lit("no text after cleaning"))
    error = F.coalesce("error", empty)
    preview = X.preview(F.col("text"), PREVIEW_CHARS)
    return out.select("query_id", "text", preview.alias("preview"), error.alias("error"))


def search_files(
    table: DataFrame,
    files: DataFrame,
    embedder: Embedder,
    k: int = 5,
    metric: str = V.L2,
    *,
    extractor: Callable[[bytes], str] = utf8_text,
    overfetch: bool = False,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    **knn_options,
) -> DataFrame:
    """Nearest documents to query files, each embedded whole.

    ``metric`` is the one the table was built for (``open_index``). With
    ``overfetch`` more are fetched as long as ``keep`` leaves too few, and ranked
    again. Unreadable files have no hits; ``read_query_files`` tells why.
    """
    readable = read_query_files(files, extractor).where(F.col("error").isNull())
    wanted = query_vectors(readable, embedder, chunk=False)
    if overfetch:
        hits = knn_overfetch(
            table, wanted, k, metric, keep=keep, carry=("filename",), **knn_options
        )
    else:
        hits = knn(table, wanted, k, metric, carry=("filename",), **knn_options)
    return hits.withColumn("filename", F.coalesce("filename", F.lit("unknown")))


def hit_roles(hits: DataFrame, query_id: str) -> DataFrame:
    """Roles for ``similarity_map``: a query file and the files it found."""
    mine = hits.where(F.col("query_id") == query_id)
    near = mine.select("filename", F.lit(NEIGHBOUR).alias("role"))
    return near.union(role_table(hits.sparkSession, query_id, []))


def search_map(table: DataFrame, hits: DataFrame, vector_col: str = "v") -> DataFrame:
    """The map of a table once, with the hits of any number of queries on it.

    A point that queries have found has a row for each of them, as ``neighbour`` with its
    rank, filename and score as shown to a reader; any other point is one row of the
    background without a query.
    """
    points = pca_2d(table.select("row_id", vector_col), vector_col).drop(vector_col)
    listed = hit_list(hits).join(hits.select("query_id", "rank", "row_id"), ["query_id", "rank"])
    role = F.when(F.col("query_id").isNull(), F.lit(BACKGROUND)).otherwise(F.lit(NEIGHBOUR))
    shown = points.join(listed, "row_id", "left").withColumn("role", role)
    return shown.select("query_id", "row_id", "role", "pc1", "pc2", "rank", "filename", "score")
