"""Combining parts of a document: page texts and chunk vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.functions import vectors as V

_PARTS_PER_SEGMENT = 256


def assemble_parts(
    parts: DataFrame, key: str, part_no: str, text: str = "text"
) -> DataFrame:
    """Join the texts of each document in part order, with nothing in between.

    Runs of consecutive parts are joined first, so that a document with very
    many parts is spread over tasks until only its segments are left.
    """

    def joined(order: str, value: str):
        items = F.array_sort(F.collect_list(F.struct(order, value)))
        return F.array_join(F.transform(items, lambda s: s[value]), "")

    segment = F.floor(F.col(part_no) / _PARTS_PER_SEGMENT).alias("_segment")
    segments = parts.groupBy(key, segment).agg(joined(part_no, text).alias(text))
    return segments.groupBy(key).agg(joined("_segment", text).alias(text))


def average_pool(vectors: DataFrame, key: str, vector_col: str = "v") -> DataFrame:
    """The plain mean of each key's vectors, not scaled again.

    The aggregate keeps one running mean per key and task, so a key that holds
    most rows costs no more to shuffle than any other. Vectors of different
    length in one group are an error.
    """
    as_vector = array_to_vector(V.as_double(F.col(vector_col)))
    mean = vector_to_array(Summarizer.mean(F.col("_vec")))
    pooled = vectors.select(key, as_vector.alias("_vec")).groupBy(key)
    return pooled.agg(mean.alias("v"))


def embedding_stats(documents: DataFrame, vector_col: str = "v") -> DataFrame:
    """Row count, dimension, and mean and population deviation of the norms."""
    v = V.as_double(F.col(vector_col))
    sized = documents.select(F.size(v).alias("d"), V.l2_norm(v).alias("norm"))
    return sized.agg(
        F.count("*").alias("n"),
        F.max("d").alias("dim"),
        F.avg("norm").alias("mean_norm"),
        F.stddev_pop("norm").alias("std_norm"),
    )
