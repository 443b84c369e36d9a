"""Which documents a stream has seen: keyed state that is fed by what was stored.

The state holds one flag for each document id, in the state store (RocksDB), so a
micro-batch asks for its own ids only. It learns ids in two ways: from the files it lets
through, and from the document table itself, which is read as a stream of its own, each
stored id once ever. So documents that others stored are known as well, a lost
checkpoint is made up for, and a file that was rejected may come again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from nearkin.plans.ingest import OK, STORED
from nearkin.sources.storage import empty

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_FRESH = "id string, filename string, text string, error string"


class FirstOfEach(StatefulProcessor):
    """Lets the first file of each id through, by name, unless its id is stored."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, told = None, None
        for part in rows:
            stored = part[part["status"].notna()]
            if len(stored):
                last = stored.sort_values("at").iloc[-1]
                if told is None or last["at"] >= told[0]:
                    told = last["at"], last["status"] == OK
            files = part[part["status"].isna()]
            if len(files):
                own = files.sort_values("filename").iloc[[0]]
                if first is None or own["filename"].iloc[0] < first["filename"].iloc[0]:
                    first = own
        seen = self.seen.exists()
        if told is not None and told[1] != seen:
            self.seen.update((True,)) if told[1] else self.seen.clear()
            seen = told[1]
        if first is not None and not seen:
            self.seen.update((True,))
            yield first[["id", "filename", "text", "error"]]

    def close(self) -> None:
        pass


def stored_ids(spark, path: str) -> DataFrame:
    """A stream of what is stored: ``id, status, at``, good and rejected."""
    # the folder has to be there before it can be read as a stream
    empty(spark, STORED).write.mode("append").partitionBy("status").parquet(path)
    rows = spark.readStream.schema(STORED).parquet(path)
    return rows.select("id", "status", F.col("ingested_at").alias("at"))


def fresh_files(files: DataFrame, path: str) -> DataFrame:
    """The rows ``id, filename, text, error`` of a stream whose ids aren't stored, one for each."""
    spark = files.sparkSession
    spark.conf.set(_PROVIDER, STATE_STORE)
    none = {"status": F.lit(None).cast("string"), "at": F.lit(None).cast("timestamp")}
    arrived = files.select("id", "filename", "text", "error").withColumns(none)
    nothing = {c: F.lit(None).cast("string") for c in ("filename", "text", "error")}
    stored = stored_ids(spark, path).withColumns(nothing)
    both = arrived.unionByName(stored)
    return both.groupBy("id").transformWithStateInPandas(
        FirstOfEach(), outputStructType=_FRESH, outputMode="Append", timeMode="None"
    )
