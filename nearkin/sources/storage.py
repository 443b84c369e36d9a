"""Where intermediate tables live, and which paths a corpus uses."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark's own default limit for broadcasting a side by its estimated size.
BROADCAST_BYTES = 10 << 20
MAX_BROADCAST_KEYS = 200_000
MAX_DRIVER_BYTES = 64 << 20
_SMALL_PER_CORE = 32 << 20
_CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_base: str | None = None


@dataclass(frozen=True)
class TablePaths:
    """Table locations of one corpus, derived from a base folder."""

    base: str

    @property
    def documents(self) -> str:
        return f"{self.base}/documents_vec"

    @property
    def cache(self) -> str:
        return f"{self.base}/embed_cache"

    @property
    def l2_index(self) -> str:
        return f"{self.base}/vectors_l2"

    @property
    def cosine_index(self) -> str:
        return f"{self.base}/vectors_cosine"

    def index(self, metric: str) -> str:
        return self.cosine_index if metric == "cosine" else self.l2_index


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the session.

    Only a session within one process may do without the setting; on a cluster a
    folder of one machine would lose data with that machine.
    """
    global _local_base
    base = spark.conf.get(_CHECKPOINT_DIR, None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="nearkin-")
        atexit.register(shutil.rmtree, _local_base, ignore_errors=True)
    return _local_base


def scratch_root(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_folder(spark)}/nearkin/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application.

    For a caller to use once all results that read them are written.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a result once and go on from the written table.

    Used where a plan is read twice and recomputing it would be costly or could
    differ, and it survives lost executors.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that ``durable`` wrote, once all that reads them is written."""
    for table in tables:
        path = vars(table).pop("_written_to", None) if table is not None else None
        if path is not None:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def read_or_empty(
    spark: SparkSession, path: str, schema: T.StructType | str
) -> DataFrame:
    """A Parquet table, or no rows if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows of a schema, in a form the planner knows to be empty."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return spark.range(0).select(*columns)


def _measured(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    total = F.lit(8 * len(df.columns))
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            total = total + 8 * F.greatest(F.size(f.name), F.lit(0))
    return total


def bounded_rows(
    df: DataFrame, max_rows: int, max_bytes: int = MAX_DRIVER_BYTES
) -> pa.Table | None:
    """All rows if there are at most ``max_rows`` of ``max_bytes`` in all; otherwise nothing.

    The limit only keeps an oversized result off the driver; no result is cut.
    Rows that may be wide are written and measured before any are fetched.
    """
    some = df.limit(max_rows + 1)
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)
    if any(isinstance(f.dataType, wide) for f in df.schema):
        some = durable(some, "measured")
        size = some.agg(F.count("*").alias("n"), F.sum(_measured(some)).alias("bytes")).first()
        if size.n > max_rows or (size.bytes or 0) > max_bytes:
            return None
    rows = some.toArrow()
    return rows if rows.num_rows <= max_rows else None


def settled(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """A small result computed now, so that the planner knows how small it is.

    Estimates after Python code or windows are far too high, and a join with
    such a result would shuffle the large side for nothing. Anything above
    ``max_rows`` stays as it is. The flag tells which.
    """
    rows = bounded_rows(df, max_rows)
    if rows is None:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def few_keys(big: DataFrame, small: DataFrame, on: str) -> DataFrame | None:
    """The distinct keys of ``small``, if it pays to send them to ``big``.

    It does if the planner would not broadcast the big side anyway, if reading
    the small side once more costs less than shuffling the big one, and if the
    keys are few. Otherwise there is no answer.
    """
    if planned_bytes(big) <= max(BROADCAST_BYTES, planned_bytes(small)):
        return None
    keys, few = settled(small.select(on).distinct(), MAX_BROADCAST_KEYS)
    return keys if few else None


def restrict(big: DataFrame, keys: DataFrame | None, on: str) -> DataFrame:
    """Rows of ``big`` with one of a few keys, or all of it without keys.

    Sending a bounded number of keys to a big table leaves only the few rows
    that matter to be shuffled by the join that follows.
    """
    return big if keys is None else big.join(F.broadcast(keys), on, "left_semi")


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of a result's size; an upper guess, never run."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return int(plan.stats().sizeInBytes())


def file_count(df: DataFrame) -> int:
    """How many files a result reads; the names stay in the JVM."""
    return len(df._jdf.inputFiles())


def spread(df: DataFrame, *, after_shuffle: bool = False) -> DataFrame:
    """Share a small input out over all cores before costly per-row work.

    A small file is often a single row group and so a single task. Only inputs
    of fewer files than cores, which the planner estimates at a few megabytes
    per core, are shuffled for it; others come in enough parts as they are.
    After a shuffle the number of files says nothing, as adaptive execution
    merges small parts.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if planned_bytes(df) > cores * _SMALL_PER_CORE:
        return df
    if not after_shuffle and file_count(df) >= cores:
        return df
    return df.repartition(cores)
