import pytest

from nearkin.functions import vectors as V
from nearkin.operators.numbering import sums_before
from nearkin.plans import index


@pytest.mark.parametrize("range_rows", [1_000, 50, 7])
def test_sums_of_all_rows_before(spark, range_rows):
    rows = [(i * 7 % 301, f"n{i}", i % 5) for i in range(301)]
    df = spark.createDataFrame(rows, "t long, name string, n long").repartition(4)
    got = sums_before(df, ["t", "name"], "n", "start", 301, range_rows)
    assert got.columns == ["t", "name", "n", "start"]
    total = 0
    for r in sorted(got.collect(), key=lambda r: r.t):
        assert r.start == total
        total += r.n


def test_no_rows(spark):
    df = spark.createDataFrame([], "t long, n long")
    assert sums_before(df, ["t"], "n", "start", 0).collect() == []


@pytest.mark.parametrize("sent", [0, 100])
def test_numbers_follow_files_without_the_driver(spark, tmp_path, sent, monkeypatch):
    path = str(tmp_path / "rows")
    spark.range(500).repartition(9).write.parquet(path)
    spark.range(500, 700).repartition(3).write.mode("append").parquet(path)
    stored = spark.read.parquet(path)
    monkeypatch.setattr(index, "MAX_SENT_FILES", sent)
    monkeypatch.setattr(index, "sums_before", lambda *a: sums_before(*a, range_rows=4))
    fetched, most = type(stored).collect, []

    def collect(df):
        rows = fetched(df)
        most.append(len(rows))
        return rows

    monkeypatch.setattr(type(stored), "collect", collect)
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(stored), name, lambda _: pytest.fail("rows went to the driver"))
    numbered = index.number_rows(stored)
    monkeypatch.undo()
    assert max(most) == 1
    assert sorted(r.row_id for r in numbered.collect()) == list(range(700))


def test_the_metric_is_part_of_the_table(spark, tmp_path):
    none = spark.createDataFrame([], "id string, filename string, embedding array<double>")
    for metric in V.METRICS:
        path = str(tmp_path / metric)
        index.build_index(none, path, metric)
        table, found = index.open_index(spark, path)
        assert (table.count(), found) == (0, metric)
