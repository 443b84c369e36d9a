"""Document records as JSON lines, for interchange."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearkin.sources.storage import empty

RECORD = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        T.StructField("ingested_at", T.StringType()),
    ]
)

# Fixed value: ISO-8601 with microseconds and a numeric offset.
_ISO_CLOCK = "T%02d:%02d:%02d.%06d+00:00"
_DAY = 86_400_000_000


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Record ids only. Broken lines are skipped; a missing file has no ids."""
    try:
        return (
            spark.read.schema("id string").option("mode", "DROPMALFORMED").json(path)
        )
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, "id string")


def read_records(
    spark: SparkSession,
    path: str,
    required: tuple[str, ...] = ("id", "filename", "text"),
) -> DataFrame:
    """Whole records. A broken line or a missing required key fails the read.

    A key is checked when its column is used, so a reader of two columns is not
    held up by a third.
    """
    raw = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)

    def checked(name: str):
        if name not in required:
            return F.col(name)
        missing = F.raise_error(F.lit(f"a record has no '{name}'"))
        return F.coalesce(F.col(name), missing.cast(RECORD[name].dataType)).alias(name)

    return raw.select(*[checked(f.name) for f in RECORD])


def append_records(documents: DataFrame, path: str) -> None:
    """Append records as UTF-8 JSON lines; timestamps become ISO strings in UTC."""
    out = documents
    if isinstance(out.schema["ingested_at"].dataType, T.TimestampType):
        # from the count of microseconds, as the session's zone may skip an hour
        micros = F.unix_micros("ingested_at")
        day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / _DAY).cast("int"))
        rest = F.pmod(micros, F.lit(_DAY))
        seconds = F.floor(rest / 1_000_000)
        parts = (seconds / 3600, seconds / 60 % 60, seconds % 60, rest % 1_000_000)
        clock = F.format_string(_ISO_CLOCK, *(F.floor(x).cast("long") for x in parts))
        out = out.withColumn("ingested_at", F.concat(day.cast("string"), clock))
    out.select(*RECORD.fieldNames()).write.mode("append").json(path)
