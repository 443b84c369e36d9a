"""Vector tables: what a search reads."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.functions import vectors as V
from nearkin.operators.numbering import sums_before
from nearkin.sources.storage import durable

#: Files whose places are sent to the rows, 16 bytes each.
MAX_SENT_FILES = 2_000_000
_METRIC = "metric"


def dimension(documents: DataFrame, vector_col: str = "embedding") -> int | None:
    """Length of the vectors, from the first one; each row is held to it later."""
    row = documents.where(F.col(vector_col).isNotNull()).select(F.size(vector_col)).first()
    return row[0] if row else None


def number_rows(stored: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Dense numbers 0..N-1 in the order of a Parquet table's files and rows.

    Each row's place in its file is known to the reader, so only the row counts
    per file are summed up: no sort and no shuffle of the rows themselves. Files
    go by the number of the task that wrote them, and then by name. Two numbers a
    file are sent to the rows, or joined to them if the files are too many.
    """
    path = F.col("_metadata.file_path")
    task = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1)
    files = stored.select(path.alias("_f"), task.alias("_t")).groupBy("_f", "_t").count()
    told = files.select(
        F.xxhash64("_f").alias("_h"),
        F.coalesce(F.expr("try_cast(_t AS bigint)"), F.lit(-1)).alias("_t"),
        "_f",
        "count",
    )
    told = durable(told, "files")
    size = told.agg(F.count("*").alias("n"), F.count_distinct("_h").alias("different")).first()
    if size.different < size.n:
        raise ValueError("two files have the same hash of their path")
    offsets = sums_before(told, ["_t", "_f"], "count", "_o", size.n).select("_h", "_o")
    offsets = durable(offsets, "file-starts")
    if size.n <= MAX_SENT_FILES:
        offsets = F.broadcast(offsets)
    at = stored.select("*", F.xxhash64(path).alias("_h"), F.col("_metadata.row_index").alias("_i"))
    number = (F.col("_o") + F.col("_i")).alias(id_col)
    return at.join(offsets, "_h").select(number, *stored.columns)


def vector_rows(
    documents: DataFrame, metric: str, single_precision: bool = False
) -> DataFrame:
    """``uuid, filename, v, norm, metric`` from ``id, filename, embedding``.

    A record without an embedding, or with another dimension than the first,
    fails the job by name. For cosine the vectors are stored at unit length;
    ``norm`` keeps the original one. ``single_precision`` halves the table at
    the price of scores good to about seven digits.
    """
    V.check_metric(metric)
    dim = dimension(documents)
    v = V.as_double(V.require_vector(F.col("embedding"), F.col("id"), dim))
    given = [c for c in ("row_id",) if c in documents.columns]
    checked = documents.select(*given, F.col("id").alias("uuid"), "filename", v.alias("v"))
    normed = checked.withColumn("norm", V.l2_norm(F.col("v")))
    stored = V.normalize(F.col("v"), F.col("norm")) if metric == V.COSINE else F.col("v")
    if single_precision:
        stored = stored.cast("array<float>")
    return normed.withColumn("v", stored).withColumn("metric", F.lit(metric))


def build_index(
    documents: DataFrame,
    path: str,
    metric: str,
    *,
    dense_ids: bool = True,
    single_precision: bool = False,
) -> None:
    """Write the vector table, replacing whatever is at ``path``.

    Unique row ids the documents bring along are kept. Otherwise dense ids
    follow the order of the input and take one more write and read; without
    ``dense_ids`` they are unique and increasing, but with gaps.
    """
    rows = vector_rows(documents, metric, single_precision)
    if "row_id" in rows.columns:
        numbered = rows
    elif dense_ids:
        numbered = number_rows(durable(rows, "vectors"))
    else:
        numbered = rows.withColumn("row_id", F.monotonically_increasing_id())
    columns = ["row_id", "uuid", "filename", "v", "norm", "metric"]
    # also with the schema, as a table without rows could not tell
    told = numbered.select(*columns).withMetadata("v", {_METRIC: metric})
    told.write.mode("overwrite").parquet(path)


def open_index(
    spark: SparkSession, path: str, *, keep: bool = False
) -> tuple[DataFrame, str]:
    """The vector table and the metric it was built for.

    ``keep`` holds the table on the executors for a series of searches.
    """
    table = spark.read.parquet(path)
    metric = table.schema["v"].metadata.get(_METRIC)
    if metric is None:  # written by other means
        row = table.select("metric").first()
        metric = row.metric if row else V.L2
    if keep:
        table = table.persist(StorageLevel.MEMORY_AND_DISK)
    return table, metric


def id_map(table: DataFrame) -> DataFrame:
    """``row_id, uuid, filename`` of a vector table."""
    return table.select("row_id", "uuid", "filename")


def export_id_map(table: DataFrame, path: str) -> None:
    """The id map as JSON lines, one entry per line, written in parallel."""
    id_map(table).write.mode("overwrite").json(path)
