"""Corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.functions import text as X
from nearkin.operators.numbering import RANGE_ROWS, sums_before
from nearkin.operators.pooling import embedding_stats
from nearkin.operators.similarity import (
    DIGITS,
    average_similarity,
    rank_universal,
    similarity_stats,
    top_universal,
)
from nearkin.operators.words import text_stats, word_counts
from nearkin.sources.storage import MAX_BROADCAST_KEYS, durable, settled

PREVIEW_CHARS = 200


def universal_documents(documents: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """All documents, those most similar to everything else first."""
    scored = average_similarity(documents, vector_col)
    return rank_universal(scored.select("avg_sim", "filename", "text"))


def universal_ranks(
    documents: DataFrame, vector_col: str = "embedding", id_col: str = "row_id", range_rows: int = RANGE_ROWS
) -> DataFrame:
    """``<id>, rank, avg_sim, filename``: the place of every document, from 1.

    The order is that of ``universal_documents``, and by id where texts are equal too.
    Only ids, scores and names are sorted, in ranges whose sizes are summed up; texts are
    looked at where score and name tie, and nowhere else.
    """
    keys = average_similarity(documents, vector_col).select(id_col, "avg_sim", "filename")
    keys = keys.withColumn("_s", F.round("avg_sim", DIGITS))
    keys = durable(keys, "scores")
    tied = keys.groupBy("_s", "filename").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    tied, few = settled(durable(tied, "ties"), MAX_BROADCAST_KEYS)
    if not tied.isEmpty():
        same = keys["_s"].eqNullSafe(tied["_s"]) & keys["filename"].eqNullSafe(tied["filename"])
        ids = keys.join(F.broadcast(tied) if few else tied, same, "left_semi").select(id_col)
        ids, few = settled(durable(ids, "ties"), MAX_BROADCAST_KEYS)
        texts = documents.select(id_col, F.col("text").alias("_t"))
        texts = texts.join(F.broadcast(ids) if few else ids, id_col, "left_semi")
        keys = durable(keys.join(texts, id_col, "left"), "keys")
    else:
        keys = keys.withColumn("_t", F.lit(None).cast("string"))
    order = [F.desc("_s"), F.desc("filename"), F.desc("_t"), F.asc(id_col)]
    placed = sums_before(keys.withColumn("_one", F.lit(1)), order, "_one", "_before", keys.count(), range_rows)
    rank = (F.col("_before") + 1).cast("long").alias("rank")
    return placed.select(id_col, rank, "avg_sim", "filename")


def universal_report(
    documents: DataFrame, top_n: int = 10, vector_col: str = "embedding"
) -> DataFrame:
    """The first ``top_n`` of them, with the start of each text."""
    text = X.preview(F.col("text"), PREVIEW_CHARS, "...").alias("preview")
    top = universal_documents(documents, vector_col).limit(top_n)
    return top.select("filename", "avg_sim", text)


def common_words(
    documents: DataFrame,
    universal_count: int = 5,
    vector_col: str = "embedding",
    id_col: str = "row_id",
) -> DataFrame:
    """Word counts over the most universal documents."""
    scored = average_similarity(documents, vector_col)
    return word_counts(top_universal(scored, universal_count, id_col))


def diagnostics(documents: DataFrame, vector_col: str = "embedding") -> dict[str, DataFrame]:
    """Vector, similarity and text statistics, one row each."""
    return {
        "embeddings": embedding_stats(documents, vector_col),
        "similarity": similarity_stats(documents, vector_col),
        "texts": text_stats(documents),
    }
