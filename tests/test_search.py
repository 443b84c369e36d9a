import json
import os
import warnings

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearkin.operators import embedding as E
from nearkin.operators import reduce
from nearkin.plans import index, reports, search

EMBEDDER = E.HashedWords(32)
RECORD = "id string, filename string, embedding array<double>"


def records(spark, vectors):
    rows = [(f"id{i}", f"f{i}.pdf", v) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, RECORD)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_index_roundtrip(spark, tmp_path, metric):
    path = str(tmp_path / "index")
    vectors = [[3.0, 4.0], [0.0, 0.0], [1.0, 0.0], [0.0, -2.0]]
    index.build_index(records(spark, [[9.0, 9.0, 9.0]]), path, "l2")
    index.build_index(records(spark, vectors).repartition(3), path, metric)
    table, found = index.open_index(spark, path)
    assert found == metric
    rows = {r.uuid: r for r in table.collect()}
    assert sorted(r.row_id for r in rows.values()) == [0, 1, 2, 3]
    assert rows["id0"].norm == 5.0
    assert list(rows["id0"].v) == ([0.6, 0.8] if metric == "cosine" else [3.0, 4.0])
    assert list(rows["id1"].v) == [0.0, 0.0]


def test_dense_numbers_follow_file_order(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 7).write.parquet(path)
    numbered = index.number_rows(spark.read.parquet(path))
    assert numbered.where("row_id <> id").count() == 0
    assert numbered.count() == 1000


def test_other_row_ids(spark, tmp_path):
    path = str(tmp_path / "index")
    vectors = [[1.0, 0.0]] * 10
    index.build_index(records(spark, vectors).repartition(3), path, "l2", dense_ids=False)
    assert index.open_index(spark, path)[0].select("row_id").distinct().count() == 10
    given = records(spark, vectors).withColumn("row_id", F.expr("cast(substr(id, 3) as bigint) + 40"))
    index.build_index(given, path, "cosine", single_precision=True)
    table, _ = index.open_index(spark, path)
    assert table.agg(F.min("row_id"), F.max("row_id")).first()[:] == (40, 49)
    assert dict(table.dtypes)["v"] == "array<float>"


def test_bad_records_stop_the_build(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(PySparkException, match="no vector given for id id1"):
        index.build_index(records(spark, [[1.0, 2.0], None]), path, "l2")
    with pytest.raises(PySparkException, match="vector of id id1 does not have 2 dim"):
        index.build_index(records(spark, [[1.0, 2.0], [1.0, 2.0, 3.0]]).coalesce(1), path, "l2")


def test_id_map_export(spark, tmp_path):
    index.build_index(records(spark, [[1.0], [2.0]]), str(tmp_path / "i"), "l2")
    table, _ = index.open_index(spark, str(tmp_path / "i"))
    out = str(tmp_path / "map")
    index.export_id_map(table, out)
    lines = [
        json.loads(line)
        for n in os.listdir(out)
        if n.endswith(".json")
        for line in open(os.path.join(out, n))
    ]
    assert {x["row_id"]: (x["uuid"], x["filename"]) for x in lines} == {
        0: ("id0", "f0.pdf"),
        1: ("id1", "f1.pdf"),
    }


TEXTS = ["red green blue", "red green", "black white", "one two three four", "red"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs = spark.createDataFrame(
        [(f"id{i}", f"f{i}.pdf", t) for i, t in enumerate(TEXTS)],
        "id string, filename string, text string",
    )
    embedded = E.embed_documents(docs, EMBEDDER)
    out = {}
    for metric in ("l2", "cosine"):
        path = str(tmp_path_factory.mktemp("index") / metric)
        index.build_index(embedded, path, metric)
        out[metric] = index.open_index(spark, path)[0]
    return out


def test_search_texts(spark, tables):
    asked = spark.createDataFrame([(1, " red　green "), (2, "white black")], "query_id int, text string")
    hits = search.search_texts(tables["l2"], asked, EMBEDDER, 2)
    first = {r.query_id: r for r in hits.where("rank = 1").collect()}
    assert first[1].filename == "f1.pdf" and abs(first[1].score - 1.0) < 1e-9
    assert first[2].filename == "f2.pdf"
    few = index.id_map(tables["l2"]).where("filename = 'f1.pdf'")
    with pytest.raises(PySparkException, match="no metadata"):
        search.search_texts(tables["l2"], asked, EMBEDDER, 2, id_map=few).collect()
    named = search.search_texts(tables["l2"], asked, EMBEDDER, 2, id_map=index.id_map(tables["l2"]))
    assert sorted(r.filename for r in named.collect()) == sorted(r.filename for r in hits.collect())


def test_blank_query_text_is_an_error(spark, tables):
    asked = spark.createDataFrame([(1, "  ")], "query_id int, text string")
    with pytest.raises(PySparkException, match="query 1: nothing to embed"):
        search.search_texts(tables["l2"], asked, EMBEDDER, 2).collect()


def test_search_files(spark, tables):
    rows = [("q.pdf", b"red\n\ngreen"), ("blank.pdf", b" "), ("bad.pdf", b"\xff")]
    asked = spark.createDataFrame(
        [(n, bytearray(c)) for n, c in rows], "query_id string, content binary"
    )
    read = {r.query_id: r for r in search.read_query_files(asked).collect()}
    assert read["q.pdf"].preview == "red green" and read["q.pdf"].error is None
    assert read["blank.pdf"].error == "no text after cleaning"
    assert "UnicodeDecodeError" in read["bad.pdf"].error
    for metric in ("l2", "cosine"):
        for overfetch in (False, True):
            hits = search.search_files(
                tables[metric], asked, EMBEDDER, 2, metric, overfetch=overfetch
            ).collect()
            assert {r.query_id for r in hits} == {"q.pdf"}
            assert {r.rank: r.filename for r in hits}[1] == "f1.pdf"
            assert len(hits) == 2


def test_search_to_map(spark, tables):
    asked = spark.createDataFrame([("f9.pdf", bytearray(b"red green"))], "query_id string, content binary")
    hits = search.search_files(tables["cosine"], asked, EMBEDDER, 2, "cosine")
    points = reduce.similarity_map(tables["cosine"], search.hit_roles(hits, "f9.pdf"))
    near = {r.filename for r in points.where("role = 'neighbour'").collect()}
    assert near == {r.filename for r in hits.collect()}
    assert points.where("role = 'query'").count() == 0  # not part of the corpus


def test_kept_index(spark, tmp_path):
    index.build_index(records(spark, [[1.0], [2.0]]), str(tmp_path / "i"), "l2")
    table, _ = index.open_index(spark, str(tmp_path / "i"), keep=True)
    assert table.is_cached and table.count() == 2
    table.unpersist()


def test_reports(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"f{i}", f"w{i} all " * 200, rng.normal(size=4).tolist()) for i in range(12)]
    docs = spark.createDataFrame(rows, "row_id long, filename string, text string, embedding array<double>")
    x = np.array([r[3] for r in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    avg = (s.sum(1) - 1) / 11
    order = np.argsort(-avg)
    full = reports.universal_documents(docs).collect()
    assert [r.filename for r in full] == [f"f{i}" for i in order]
    top = reports.universal_report(docs, 3).collect()
    assert [r.filename for r in top] == [f"f{i}" for i in order[:3]]
    assert all(len(r.preview) == 203 and r.preview.endswith("...") for r in top)
    counts = {r.word: r["count"] for r in reports.common_words(docs, 2).collect()}
    assert counts == {"all": 400, f"w{order[0]}": 200, f"w{order[1]}": 200}
    out = {k: v.first() for k, v in reports.diagnostics(docs).items()}
    assert out["embeddings"].n == 12 and out["texts"].unique_texts == 12
    assert abs(out["similarity"].min_sim - s.min()) < 1e-9


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 5)) * [5, 3, 1, 0.5, 0.1] + 30
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id long, v array<double>")
    got = np.array([(r.pc1, r.pc2) for r in reduce.pca_2d(docs).orderBy("row_id").collect()])
    centred = x - x.mean(0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2].T
    axes *= np.sign(axes[np.abs(axes).argmax(0), [0, 1]])
    assert np.allclose(got, centred @ axes, atol=1e-6)
    assert np.allclose(got.mean(0), 0, atol=1e-8)


@pytest.fixture
def points(spark):
    rng = np.random.default_rng(6)
    names = ["q", "n1", "n1", "x"]
    rows = [(i, n, rng.normal(size=3).tolist()) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "row_id long, filename string, v array<double>")


def test_roles(spark, points):
    roles = reduce.role_table(spark, "q", ["n1", "q", "missing"])
    got = {r.row_id: r.role for r in reduce.label_roles(points, roles).collect()}
    assert got == {0: "query", 1: "neighbour", 2: "neighbour", 3: "background"}
    assert [r.filename for r in reduce.missing_roles(points, roles).collect()] == ["missing"]


def test_similarity_map_flags(spark, points):
    roles = reduce.role_table(spark, "q", ["n1", "missing"])
    with pytest.warns(UserWarning, match="missing"):
        out = reduce.similarity_map(points, roles, require_query=True, warn_missing=True)
    assert out.count() == 4 and {"pc1", "pc2", "role"} <= set(out.columns)
    absent = reduce.role_table(spark, "gone", ["n1"])
    with pytest.raises(ValueError, match="gone"):
        reduce.similarity_map(points, absent, require_query=True)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert reduce.similarity_map(points, absent).count() == 4
    none = reduce.role_table(spark, None, ["n1"])
    assert reduce.similarity_map(points, none).where("role = 'query'").count() == 0


def test_numbers_follow_the_tasks_beyond_five_digits(spark, tmp_path):
    for n, rows in ((99_998, [1, 2]), (99_999, [3]), (100_000, [4, 5]), (100_001, [6])):
        pq.write_table(pa.table({"x": rows}), tmp_path / f"part-{n:05d}-abc.parquet")
    got = index.number_rows(spark.read.parquet(str(tmp_path)))
    assert sorted((r.row_id, r.x) for r in got.collect()) == [(i, i + 1) for i in range(6)]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_an_empty_table_keeps_its_metric(spark, tmp_path):
    none = spark.createDataFrame([], "id string, filename string, embedding array<double>")
    for metric in ("cosine", "l2"):
        path = str(tmp_path / metric)
        index.build_index(none, path, metric)
        table, found = index.open_index(spark, path)
        assert found == metric and table.count() == 0


@pytest.mark.parametrize("few", [0, 1_000])
def test_ranks_of_all_documents_with_ties(spark, monkeypatch, few):
    rows = [(i, f"f{i % 4}", f"text {i % 3}", [1.0, float(i // 12)]) for i in range(60)]
    rows += [(60, "f1", None, [1.0, 0.0]), (61, None, "text", [1.0, 0.0])]
    docs = spark.createDataFrame(rows, "row_id long, filename string, text string, embedding array<double>")
    monkeypatch.setattr(reports, "MAX_BROADCAST_KEYS", few)
    got = reports.universal_ranks(docs.repartition(3), range_rows=9).collect()
    sims = {r.row_id: round(r.avg_sim, 12) for r in got}

    def down(text):
        # descending, nulls last
        return (text is None, [-ord(c) for c in text or ""] + [1])

    order = sorted(rows, key=lambda r: (-sims[r[0]], down(r[1]), down(r[2]), r[0]))
    assert [r.row_id for r in sorted(got, key=lambda r: r.rank)] == [r[0] for r in order]
    assert sorted(r.rank for r in got) == list(range(1, 63))


def test_one_map_for_many_queries(spark):
    rows = [(i, f"f{i}", [float(i), float(i * i % 7)]) for i in range(12)]
    table = spark.createDataFrame(rows, "row_id long, filename string, v array<double>")
    hits = spark.createDataFrame(
        [("a", 1, 3, "f3", 0.12345), ("a", 2, 4, "f4", 0.1), ("b", 1, 3, "f3", 0.9)],
        "query_id string, rank int, row_id long, filename string, score double",
    )
    shown = search.search_map(table, hits).collect()
    assert len(shown) == 13
    near = sorted((r.query_id, r.rank, r.row_id, r.score) for r in shown if r.role == "neighbour")
    assert near == [("a", 1, 3, 0.123), ("a", 2, 4, 0.1), ("b", 1, 3, 0.9)]
    assert sorted(r.row_id for r in shown if r.query_id is None) == [0, 1, 2, *range(5, 12)]
    assert all(r.role == "background" for r in shown if r.query_id is None)
