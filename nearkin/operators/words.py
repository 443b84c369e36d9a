"""Word counts and text statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearkin.functions import text as X
from nearkin.sources.storage import spread


def word_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, count`` over all texts; counted map-side, so hot words are cheap."""
    # outer, because a plain explode would test the token array for emptiness in
    # a filter of its own and so build it more than once
    split = F.explode_outer(X.tokens(F.col(text_col)))
    words = spread(documents.select(text_col)).select(split.alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("count"))


def most_common(counts: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent words; ties in word order."""
    return counts.orderBy(F.desc("count"), F.asc("word")).limit(n)


def text_stats(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """Token-count mean and population deviation, distinct texts and total.

    Texts are told apart by their hash, so what is shuffled does not grow with
    their length.
    """
    n = X.token_count(F.col(text_col))
    hashed = spread(documents.select(text_col)).select(n.alias("n"), X.text_id(F.col(text_col)).alias("h"))
    return hashed.agg(
        F.avg("n").alias("mean_tokens"),
        F.stddev_pop("n").alias("std_tokens"),
        F.count_distinct("h").alias("unique_texts"),
        F.count("*").alias("total_texts"),
    )
