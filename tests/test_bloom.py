import pytest
from pyspark.sql import functions as F

from nearkin.operators import bloom, incremental

ON = ["id", "filename"]


def written(spark, tmp_path, n):
    path = str(tmp_path / "rows")
    rows = spark.range(n).select(
        F.sha1(F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("f"), F.col("id") % 7).alias("filename"),
        F.col("id").alias("number"),
        F.encode(F.repeat(F.lit("x"), 50), "utf-8").alias("content"),
    )
    rows.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def split(rows, share):
    wanted = rows.where(F.col("number") % 100 < share).select(*ON)
    return wanted, rows.where(F.col("number") % 100 >= share).select(*ON)


def scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("content" in line for line in plan.splitlines() if "FileScan" in line)


def test_a_filter_loses_no_key_and_keeps_most_others_out(spark):
    keys = spark.range(0, 40_000, 2).select(F.col("id").alias("k"))
    held = bloom.KeyFilter(keys, ["k"], 20_000)
    asked = spark.range(40_000).select(F.col("id").alias("k"))
    passed = {r.k for r in asked.where(held.may_hold()).collect()}
    assert passed >= set(range(0, 40_000, 2))
    assert len(passed) - 20_000 < 0.03 * 20_000


def test_sizes_are_bounded():
    assert bloom._shape(1) == (16, bloom._MOST_HASHES)
    assert bloom._shape(10**12) == (bloom.MOST_LOG2, 1)
    bits, hashes = bloom._shape(10**6)
    assert 10 * 10**6 <= 1 << bits < 40 * 10**6 and hashes == bloom._MOST_HASHES


@pytest.mark.parametrize("share", [3, 40, 60, 98])
@pytest.mark.parametrize("most", [3, 100])
def test_rows_are_read_once_at_any_number_of_keys(spark, tmp_path, share, most):
    rows = written(spark, tmp_path, 4_000)
    wanted, others = split(rows, share)
    found = incremental.select_in_place(rows, wanted, others, ON, most)
    assert scans(found) == 1
    assert found.columns == rows.columns
    assert sorted(r.number for r in found.collect()) == [i for i in range(4_000) if i % 100 < share]


def test_mistakes_of_crowded_filters_are_told_apart(spark, tmp_path, monkeypatch):
    # 512 bits for 1,600 keys, so several filters follow each other
    monkeypatch.setattr(bloom, "LEAST_LOG2", 9)
    monkeypatch.setattr(bloom, "MOST_LOG2", 11)
    built = []
    made = bloom.KeyFilter.__init__

    def count(self, keys, on, n, seed=0):
        built.append(n)
        made(self, keys, on, n, seed)

    monkeypatch.setattr(bloom.KeyFilter, "__init__", count)
    rows = written(spark, tmp_path, 4_000)
    for share in (40, 70):
        wanted, others = split(rows, share)
        found = bloom.select_by_cascade(rows, wanted, others, ON, 5)
        assert sorted(r.number for r in found.collect()) == [i for i in range(4_000) if i % 100 < share]
    assert len(built) > 4


def test_filters_that_keep_nothing_out_are_given_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bloom, "LEAST_LOG2", 6)
    monkeypatch.setattr(bloom, "MOST_LOG2", 6)
    rows = written(spark, tmp_path, 2_000)
    wanted, others = split(rows, 50)
    found = bloom.select_by_cascade(rows, wanted, others, ON, 5)
    assert sorted(r.number for r in found.collect()) == [i for i in range(2_000) if i % 100 < 50]


def test_no_wanted_or_no_other_rows(spark, tmp_path):
    rows = written(spark, tmp_path, 50)
    every, none = split(rows, 100)
    assert incremental.select_in_place(rows, every, none, ON, 3).count() == 50
    assert incremental.select_in_place(rows, none, every, ON, 3).count() == 0
