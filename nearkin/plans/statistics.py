"""Corpus statistics that are kept up as documents arrive.

Beside a document table lies a small one of partial states: for the documents of some
ingests their number, the sum of their unit vectors, and number, mean and squared
deviations of norms and token counts. States add up, so a report reads them and not the
vectors; hashes of texts, for counting different ones, are kept in a narrow table. An
ingest is known by its time, and an update takes up those that no state covers yet, in
one read of their rows alone, whoever wrote them and whether or not an update before
was broken off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.functions import text as X
from nearkin.functions import vectors as V
from nearkin.operators.similarity import average_similarity, stats_of_sums, sum_vector
from nearkin.plans.ingest import stored_documents
from nearkin.sources.storage import durable, read_or_empty, spread

STATE = (
    "covers array<timestamp>, n long, dim int, total array<double>, longest double,"
    " norm_mean double, norm_m2 double, tokens_mean double, tokens_m2 double"
)
#: Ingests that one update takes up at a time.
MAX_INGESTS = 1_000


def _states_path(path: str) -> str:
    return f"{path.rstrip('/')}.states"


def _texts_path(path: str) -> str:
    return f"{path.rstrip('/')}.texts"


def partial_state(documents: DataFrame, times: list) -> DataFrame:
    """One row with the state of some documents (``text, embedding``)."""
    v = V.as_double(F.col("embedding"))
    sized = spread(documents).select(
        F.size(v).alias("d"), V.l2_norm(v).alias("norm"), X.token_count(F.col("text")).alias("t")
    )
    moments = sized.agg(
        F.max("d").alias("dim"),
        F.avg("norm").alias("norm_mean"),
        (F.var_pop("norm") * F.count("norm")).alias("norm_m2"),
        F.avg("t").alias("tokens_mean"),
        (F.var_pop("t") * F.count("t")).alias("tokens_m2"),
    ).first()
    covers = F.array(*[F.lit(t) for t in times]).alias("covers")
    # the sums are one row
    return sum_vector(documents, "embedding").select(
        covers,
        "n",
        F.lit(moments.dim).cast("int").alias("dim"),
        "total",
        "longest",
        *(F.lit(moments[c]).cast("double").alias(c) for c in ("norm_mean", "norm_m2", "tokens_mean", "tokens_m2")),
    )


def update_statistics(spark: SparkSession, path: str) -> int:
    """Take up the ingests of a document table that no state covers; how many there were.

    Their rows are found by time, which is the same throughout a file, so others aren't
    read. Two updates at a time could both take up an ingest; let one run at a time.
    """
    documents = stored_documents(spark, path)
    states = read_or_empty(spark, _states_path(path), STATE)
    seen = states.select(F.explode("covers").alias("ingested_at"))
    times = documents.select("ingested_at").distinct().join(seen, "ingested_at", "left_anti")
    taken = 0
    while True:
        some = [r.ingested_at for r in times.orderBy("ingested_at").limit(MAX_INGESTS).collect()]
        if not some:
            return taken
        new = documents.where(F.col("ingested_at").isin(some))
        new.select(X.text_id(F.col("text")).alias("text_sha1"), "ingested_at").distinct().write.mode(
            "append"
        ).parquet(_texts_path(path))
        # the state last, as it says that all is done
        partial_state(new, some).coalesce(1).write.mode("append").parquet(_states_path(path))
        taken += len(some)
        times = times.where(F.col("ingested_at") > some[-1])


def merged_state(spark: SparkSession, path: str) -> DataFrame:
    """One row: the state of all documents covered, and the number of different texts."""
    states = durable(read_or_empty(spark, _states_path(path), STATE), "states")
    texts = read_or_empty(spark, _texts_path(path), "text_sha1 string, ingested_at timestamp")
    n = F.col("n").cast("double")
    means = states.agg(
        *((F.sum(F.col(f"{c}_mean") * n) / F.sum(n)).alias(c) for c in ("norm", "tokens"))
    ).first()
    scalars = states.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.max("dim").alias("dim"),
        F.max("longest").alias("longest"),
        *(
            F.sum(F.col(f"{c}_m2") + n * F.pow(F.col(f"{c}_mean") - F.lit(means[c]), 2)).alias(f"{c}_m2")
            for c in ("norm", "tokens")
        ),
    )
    added = states.select(F.posexplode("total").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    total = added.agg(F.transform(ordered, lambda s: s["x"]).alias("total")).first().total
    different = texts.select(F.count_distinct("text_sha1")).first()[0]
    return scalars.select(
        "n",
        "dim",
        "longest",
        F.lit(means.norm).cast("double").alias("norm_mean"),
        "norm_m2",
        F.lit(means.tokens).cast("double").alias("tokens_mean"),
        "tokens_m2",
        F.lit(total or []).cast("array<double>").alias("total"),
        F.lit(different).alias("unique_texts"),
    )


def kept_diagnostics(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What ``reports.diagnostics`` tells, from the states, as of the last update.

    The smallest similarity does not add up and is NULL.
    """
    state = durable(merged_state(spark, path), "state")

    def deviation(m2: str):
        return F.sqrt(F.try_divide(m2, "n"))

    return {
        "embeddings": state.select(
            "n",
            "dim",
            F.col("norm_mean").alias("mean_norm"),
            deviation("norm_m2").alias("std_norm"),
        ),
        "similarity": stats_of_sums(state.select("total", F.nullif("n", F.lit(0)).alias("n"), "longest"), None),
        "texts": state.select(
            F.col("tokens_mean").alias("mean_tokens"),
            deviation("tokens_m2").alias("std_tokens"),
            "unique_texts",
            F.col("n").alias("total_texts"),
        ),
    }


def kept_average_similarity(spark: SparkSession, path: str, documents: DataFrame, vector_col: str) -> DataFrame:
    """``average_similarity`` to all documents covered, with one read of ``documents``."""
    return average_similarity(documents, vector_col, sums=merged_state(spark, path))
