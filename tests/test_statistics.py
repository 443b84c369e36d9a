import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.operators.similarity import average_similarity
from nearkin.plans import reports, statistics
from nearkin.plans.ingest import OK, REJECTED, stored_documents


def ingest(spark, path, day, texts, dim=3, status=OK):
    rng = np.random.default_rng(day)
    at = datetime.datetime(2024, 1, day)
    rows = [
        (f"{day}-{i}", "f", t, [float(x) for x in 100 + day * rng.normal(size=dim)], at, None, status)
        for i, t in enumerate(texts)
    ]
    schema = (
        "id string, filename string, text string, embedding array<double>,"
        " ingested_at timestamp, error string, status string"
    )
    spark.createDataFrame(rows, schema).write.mode("append").partitionBy("status").parquet(path)


def same(spark, path):
    full = reports.diagnostics(stored_documents(spark, path))
    kept = statistics.kept_diagnostics(spark, path)
    for name, df in full.items():
        a, b = df.first().asDict(), kept[name].first().asDict()
        assert a.keys() == b.keys()
        for c in a:
            if c != "min_sim":
                assert b[c] == pytest.approx(a[c], rel=1e-9, abs=1e-9), (name, c)


def test_statistics_after_each_ingest_equal_a_full_run(spark, tmp_path):
    path = str(tmp_path / "docs")
    ingest(spark, path, 1, ["a b", "a b", "c"])
    assert statistics.update_statistics(spark, path) == 1
    same(spark, path)
    ingest(spark, path, 2, ["c", "d e f g", ""])
    ingest(spark, path, 3, ["rejected"], status=REJECTED)
    ingest(spark, path, 4, ["x y z"] * 40)
    assert statistics.update_statistics(spark, path) == 2
    assert statistics.update_statistics(spark, path) == 0
    same(spark, path)
    docs = stored_documents(spark, path)
    kept = statistics.kept_average_similarity(spark, path, docs, "embedding")
    full = {r.id: r.avg_sim for r in average_similarity(docs, "embedding").collect()}
    assert {r.id: r.avg_sim for r in kept.collect()} == pytest.approx(full)


def test_an_update_that_was_broken_off_is_made_up(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    ingest(spark, path, 1, ["a b", "c"])

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(statistics, "partial_state", fails)
        with pytest.raises(RuntimeError):
            statistics.update_statistics(spark, path)
    assert statistics.update_statistics(spark, path) == 1
    same(spark, path)


def test_many_ingests_go_in_parts(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "docs")
    for day in (1, 2, 3, 4, 5):
        ingest(spark, path, day, [f"text {day}", "same"])
    monkeypatch.setattr(statistics, "MAX_INGESTS", 2)
    assert statistics.update_statistics(spark, path) == 5
    same(spark, path)


def test_only_new_rows_are_read(spark, tmp_path):
    path = str(tmp_path / "docs")
    for day in (1, 2):
        ingest(spark, path, day, ["a"])
    new = stored_documents(spark, path).where(F.col("ingested_at").isin([datetime.datetime(2024, 1, 2)]))
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "ingested_at" in plan.split("PushedFilters")[1].split("]")[0]


def test_nothing_ingested(spark, tmp_path):
    path = str(tmp_path / "docs")
    assert statistics.update_statistics(spark, path) == 0
    told = statistics.kept_diagnostics(spark, path)
    assert told["embeddings"].first().n == 0 and told["similarity"].first().mean_sim is None
