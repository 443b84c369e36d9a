import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from nearkin.operators import embedding as E
from nearkin.operators import incremental
from nearkin.plans import ingest
from nearkin.sources import files, jsonl, storage
from nearkin.streaming.ingest import start_folder_ingest

EMBEDDER = E.HashedWords(16)


def write(folder, name, content):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(content)


@pytest.fixture
def folder(tmp_path):
    base = str(tmp_path / "in")
    write(base, "a_report.pdf", b"alpha  beta\ngamma")
    write(base, "B_report.PDF", "日本 語　です".encode())
    write(base, "c_other.pdf", b"other")
    write(base, "d_report.txt", b"text")
    write(base, "e_report.pdf", b"alpha  beta\ngamma")
    write(base, "f_report.pdf", b" \n ")
    write(base, "g_report.pdf", b"\xff\xfe\xff")
    write(base, "sub/h_report.pdf", b"below")
    return base


def names(df):
    return sorted(r.filename for r in df.collect())


def test_folder_scan_and_name_rules(spark, folder):
    found = files.read_folder(spark, folder, ".pdf", "report")
    assert names(found) == [
        "B_report.PDF",
        "a_report.pdf",
        "e_report.pdf",
        "f_report.pdf",
        "g_report.pdf",
    ]
    assert "c_other.pdf" in names(files.read_folder(spark, folder))
    row = found.where("filename = 'a_report.pdf'").first()
    assert bytes(row.content) == b"alpha  beta\ngamma"


def test_other_files_are_not_read(spark, folder):
    plan = files.read_folder(spark, folder, ".pdf", "report")
    listed = {os.path.basename(p) for p in plan.inputFiles()}
    assert "d_report.txt" not in listed


def test_no_name_is_passed_over(spark, tmp_path):
    base = str(tmp_path / "in")
    names_in = ["_a 資料.pdf", ".b資料%20.pdf", "_c=資料.pdf", "d資料[1].PDF", "_metadata資料.pdf"]
    for i, name in enumerate(names_in):
        write(base, name, f"text {i}".encode())
    write(base, "_other.pdf", b"other")
    write(base, "_e資料.txt", b"other")
    write(base, "_sub資料.pdf/f資料.pdf", b"below")
    found = files.read_folder(spark, base, ".pdf", "資料")
    got = {r.filename: bytes(r.content).decode() for r in found.collect()}
    assert got == {name: f"text {i}" for i, name in enumerate(names_in)}
    # a literal that may overlap with the suffix
    write(base, "report.pdf", b"x")
    assert names(files.read_folder(spark, base, ".pdf", "port.p")) == ["report.pdf"]
    path = str(tmp_path / "docs")
    for _ in range(2):
        start_folder_ingest(
            spark, base, path, str(tmp_path / "progress"), EMBEDDER, literal="資料"
        ).awaitTermination()
    assert names(ingest.stored_documents(spark, path)) == sorted(names_in)


def test_ingest_twice_adds_only_the_new(spark, folder, tmp_path):
    path = str(tmp_path / "docs")
    options = {"literal": "report"}
    ingest.ingest_folder(spark, folder, path, EMBEDDER, **options)
    docs = ingest.stored_documents(spark, path)
    # equal files of one run are both kept
    assert names(docs) == ["B_report.PDF", "a_report.pdf", "e_report.pdf"]
    row = docs.where("filename = 'a_report.pdf'").first()
    assert row.id == hashlib.sha1(b"alpha  beta\ngamma").hexdigest()
    assert row.text == "alpha beta gamma"
    assert np.allclose(row.embedding, EMBEDDER(["alpha beta gamma"])[0])
    assert row.ingested_at is not None
    bad = {r.filename: r.error for r in ingest.rejected_files(spark, path).collect()}
    assert bad["f_report.pdf"] == ingest.EMPTY_TEXT
    assert bad["g_report.pdf"].startswith("extraction failed: UnicodeDecodeError")

    write(folder, "i_report.pdf", b"new one")
    write(folder, "copy_report.pdf", b"alpha  beta\ngamma")
    ingest.ingest_folder(spark, folder, path, EMBEDDER, **options)
    assert names(ingest.stored_documents(spark, path)) == [
        "B_report.PDF",
        "a_report.pdf",
        "e_report.pdf",
        "i_report.pdf",
    ]


def test_stored_files_are_not_extracted_again(spark, folder, tmp_path):
    path = str(tmp_path / "docs")
    ingest.ingest_folder(spark, folder, path, EMBEDDER)

    def never(content):
        if content.strip() and content != b"\xff\xfe\xff":
            raise AssertionError("a stored file was read again")
        return ""

    ingest.ingest_folder(spark, folder, path, EMBEDDER, extractor=never)
    errors = [r.error for r in ingest.rejected_files(spark, path).collect()]
    assert not any("read again" in e for e in errors)


def test_first_of_equal_files(spark, folder, tmp_path):
    path = str(tmp_path / "docs")
    ingest.ingest_folder(
        spark, folder, path, EMBEDDER, literal="report", within_batch=incremental.FIRST
    )
    assert names(ingest.stored_documents(spark, path)) == ["B_report.PDF", "a_report.pdf"]


def _exchanged(df):
    """Names of all columns that any exchange of a plan hands on."""
    df._jdf.queryExecution().executedPlan()
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    parts = [p.strip() for p in text.split("\n\n") if p.strip()]
    return [p for p in parts if p[0] == "(" and "Exchange" in p.splitlines()[0]]


@pytest.mark.parametrize("rule", [incremental.KEEP, incremental.FIRST])
@pytest.mark.parametrize("most", [1, 2, 1000])
def test_contents_are_never_shuffled(spark, tmp_path, rule, most, monkeypatch):
    rows = [(f"f{i % 9}", f"text {i % 7}".encode()) for i in range(40)]
    rows += rows[:2]
    path = str(tmp_path / "files")
    spark.createDataFrame(rows, "filename string, content binary").repartition(3).write.parquet(path)
    batch = spark.read.parquet(path).select(F.sha1("content").alias("id"), "filename", "content")
    known = spark.createDataFrame([(hashlib.sha1(b"text 3").hexdigest(),), (None,)], "id string")
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out, twice = incremental.new_files(batch, known, rule, most)
        got = {(r.filename, bytes(r.content)) for r in out.collect()}
        for part in _exchanged(out):
            assert "content" not in part or "Broadcast" in part.splitlines()[0], part
        whole = ingest.prepare_documents(batch.drop("id"), known, EMBEDDER, within_batch=rule)
        for part in _exchanged(whole):
            assert "content" not in part, part
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    new = {r for r in rows if r[1] != b"text 3"}
    if rule == incremental.FIRST:
        new = {(min(n for n, x in new if x == c), c) for _, c in new}
        assert twice
    assert got == new


def test_rejected_files_are_told_once(spark, folder, tmp_path):
    path = str(tmp_path / "docs")
    for _ in range(3):
        ingest.ingest_folder(spark, folder, path, EMBEDDER, literal="report")
    rejected = ingest.rejected_files(spark, path).collect()
    assert len(rejected) == len({(r.id, r.filename) for r in rejected}) > 0


def test_a_hot_text_and_blank_ones(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    rows = [(i, "hot" if i % 3 else ["", None, " \n", "own %d" % i][i % 4]) for i in range(600)]
    docs = spark.createDataFrame(rows, "i int, text string").repartition(6)
    out = E.embed_documents(docs, Counting(str(seen)), cache_path=str(tmp_path / "cache"))
    got = {r.i: r for r in out.collect()}
    assert len(got) == 600
    for i, t in rows:
        blank = not (t or "").strip()
        assert (got[i].embedding is None) == blank and (got[i].error == E.NO_TEXT) == blank
    assert asked(str(seen)).count("hot") == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_only_failing_chunks_are_tried_again():
    calls = []

    def embedder(texts):
        calls.append(list(texts))
        if "bad" in texts:
            raise RuntimeError("no")
        return [[1.0] for _ in texts]

    found = E._pool(embedder, [["a"], ["b", "bad"], ["c"], ["d"]], 10)
    assert [isinstance(v, Exception) for v in found] == [False, True, False, False]
    assert sum("a" in c for c in calls) <= 2 and len(calls) <= 7


def test_stream_ingest_over_a_growing_folder(spark, folder, tmp_path):
    path, progress = str(tmp_path / "docs"), str(tmp_path / "progress")

    def run():
        query = start_folder_ingest(
            spark, folder, path, progress, EMBEDDER, literal="report", max_files=2
        )
        query.awaitTermination()

    run()
    first = ingest.stored_documents(spark, path)
    assert first.count() == 2
    write(folder, "i_report.pdf", b"new one")
    run()
    run()
    got = names(ingest.stored_documents(spark, path))
    assert "i_report.pdf" in got and len(got) == 3
    # a lost checkpoint replays everything, and nothing is stored twice
    again = start_folder_ingest(
        spark, folder, path, str(tmp_path / "fresh"), EMBEDDER, literal="report"
    )
    again.awaitTermination()
    assert names(ingest.stored_documents(spark, path)) == got


def test_new_only_keeps_rows_without_a_stored_id(spark):
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, n int")
    known = spark.createDataFrame([("a",), (None,)], "id string")
    assert sorted(r.n for r in incremental.new_only(batch, known).collect()) == [2, 3]
    first = incremental.first_of_each(batch, "n")
    assert sorted((r.id, r.n) for r in first.collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        incremental.within_batch(batch, "last", "n")


# -- embedding --------------------------------------------------------------


def test_chunks_are_pooled_without_weights(spark):
    docs = spark.createDataFrame([(1, "a a a a b"), (2, " ")], "i int, text string")
    got = {r.i: r for r in E.embed_documents(docs, EMBEDDER, max_tokens=4).collect()}
    want = (EMBEDDER(["a a a a"])[0] + EMBEDDER(["b"])[0]) / 2
    assert np.allclose(got[1].embedding, want)
    assert got[1].error is None
    assert (got[2].embedding, got[2].error) == (None, E.NO_TEXT)
    whole = E.embed_documents(docs.where("i = 1"), EMBEDDER, chunk=False).first()
    assert np.allclose(whole.embedding, EMBEDDER(["a a a a b"])[0])


class Counting:
    """Embeds and notes each text it was asked for in a folder."""

    model = "counting"

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, texts):
        import uuid

        for t in texts:
            if t == "bad":
                raise RuntimeError("no")
            with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
                f.write(t)
        return [[float(len(t)), 1.0] for t in texts]


def asked(folder):
    return sorted(open(os.path.join(folder, n)).read() for n in os.listdir(folder))


def test_each_text_is_embedded_once_ever(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()
    embedder, cache = Counting(str(seen)), str(tmp_path / "cache")
    docs = spark.createDataFrame(
        [(1, "x"), (2, "x"), (3, "yy\n"), (4, "")], "i int, text string"
    ).repartition(3)
    out = E.embed_documents(docs, embedder, cache_path=cache)
    got = {r.i: (r.embedding and list(r.embedding), r.error) for r in out.collect()}
    assert got[1] == got[2] == ([1.0, 1.0], None)
    assert got[3] == ([2.0, 1.0], None)
    assert got[4] == (None, E.NO_TEXT)
    assert asked(str(seen)) == ["x", "yy"]
    more = spark.createDataFrame([(5, "x"), (6, "zzz")], "i int, text string")
    E.embed_documents(more, embedder, cache_path=cache).collect()
    assert asked(str(seen)) == ["x", "yy", "zzz"]
    # another model does not share the entries
    E.embed_documents(more, embedder, cache_path=cache, model="other").collect()
    assert asked(str(seen)) == ["x", "x", "yy", "zzz", "zzz"]


def test_one_bad_document_does_not_spoil_the_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "y")], "i int, text string")
    out = E.embed_documents(docs.coalesce(1), Counting(str(tmp_path)))
    got = {r.i: r for r in out.collect()}
    assert got[2].embedding is None and "RuntimeError: no" in got[2].error
    assert got[1].error is None and got[3].embedding is not None


def test_filters_do_not_run_the_embedder_again(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "i int, text string")
    out = E.embed_documents(docs, Counting(str(tmp_path)))
    kept = out.where(F.col("error").isNull()).select("i", F.explode("embedding"))
    assert kept.count() == 4
    assert asked(str(tmp_path)) == ["x", "y"]


def test_short_texts_keep_their_keys(spark):
    docs = spark.createDataFrame([(1, "x"), (2, " "), (3, "y\n")], "i int, text string")
    got = {r.i: r.embedding for r in E.embed_texts(docs, EMBEDDER).collect()}
    assert sorted(got) == [1, 3]
    assert np.allclose(got[3], EMBEDDER(["y"])[0])


def test_a_cache_needs_a_model_name(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x")], "i int, text string")
    with pytest.raises(ValueError):
        E.embed_documents(docs, lambda ts: [[1.0] for _ in ts], cache_path=str(tmp_path))


# -- records ----------------------------------------------------------------


def write_lines(path, lines):
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


GOOD = {"id": "a", "filename": "f.pdf", "text": "日本", "embedding": [1.0], "ingested_at": "t"}


def test_lenient_ids(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    no_vector = {k: v for k, v in GOOD.items() if k != "embedding"} | {"id": "b"}
    write_lines(path, [json.dumps(GOOD), '{"id": "x", broken', json.dumps(no_vector)])
    assert sorted(r.id for r in jsonl.read_ids(spark, path).collect()) == ["a", "b"]
    assert jsonl.read_ids(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_strict_records(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    write_lines(path, [json.dumps(GOOD), '{"id": "x", broken'])
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        jsonl.read_records(spark, path).collect()
    write_lines(path, [json.dumps(GOOD), json.dumps({"id": "b", "text": "t"})])
    with pytest.raises(PySparkException, match="no 'filename'"):
        jsonl.read_records(spark, path).collect()


def test_records_are_appended_as_utf8(spark, tmp_path):
    path = str(tmp_path / "out")
    row = ("a", "f.pdf", "日本", [1.0, 2.5])
    docs = spark.createDataFrame([row], "id string, filename string, text string, embedding array<double>")
    stamped = docs.withColumn("ingested_at", F.to_timestamp(F.lit("2024-05-06 07:08:09.5")))
    jsonl.append_records(stamped, path)
    jsonl.append_records(stamped, path)
    lines = []
    for name in os.listdir(path):
        if name.endswith(".json"):
            lines += open(os.path.join(path, name), encoding="utf-8").read().splitlines()
    assert len(lines) == 2 and "日本" in lines[0]
    assert json.loads(lines[0])["ingested_at"] == "2024-05-06T07:08:09.500000+00:00"
    assert jsonl.read_records(spark, path).count() == 2


def test_times_are_utc_whatever_the_session_zone(spark, tmp_path):
    path, zone = str(tmp_path / "out"), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        docs = spark.sql(
            "SELECT 'a' AS id, 'f' AS filename, 't' AS text, array(1.0D) AS embedding, explode(array("
            "timestamp'2024-03-10T02:30:00Z', timestamp'2024-11-03T06:30:00.000123Z',"
            "timestamp'1969-12-31T23:59:59.5Z')) AS ingested_at"
        )
        jsonl.append_records(docs, path)
        got = sorted(r.ingested_at for r in jsonl.read_records(spark, path).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [
        "1969-12-31T23:59:59.500000+00:00",
        "2024-03-10T02:30:00.000000+00:00",
        "2024-11-03T06:30:00.000123+00:00",
    ]


# -- storage ----------------------------------------------------------------


def test_shared_folder_is_the_sessions(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = storage.shared_folder(spark)
    assert folder == configured.rstrip("/") if configured else os.path.isdir(folder)
    assert storage.scratch_path(spark, "x") != storage.scratch_path(spark, "x")


def test_settled_results_have_a_known_size(spark):
    df = spark.range(10).withColumn("s", F.lit("x"))
    small, few = storage.settled(df, 10)
    assert few and small.schema == df.schema and small.count() == 10
    same, few = storage.settled(df, 9)
    assert not few and same is df


def test_wide_results_stay_off_the_driver(spark):
    df = spark.range(10).withColumn("s", F.repeat(F.lit("x"), 1000))
    assert storage.bounded_rows(df, 100, 5_000) is None
    assert storage.bounded_rows(df, 100, 50_000).num_rows == 10
    assert storage.bounded_rows(df, 9) is None


def test_scratch_tables_can_be_cleared(spark):
    storage.durable(spark.range(3), "mine")
    root = storage.scratch_root(spark)
    assert os.path.isdir(root.removeprefix("file://"))
    storage.clear_scratch(spark)
    assert not os.path.isdir(root.removeprefix("file://"))


def test_table_paths():
    paths = storage.TablePaths("/base")
    assert paths.index("cosine") != paths.index("l2")
    assert paths.documents.startswith("/base/")


def test_a_large_id_list_is_cut_down_to_the_batch(spark, tmp_path, monkeypatch):
    rows = [("5", "x"), ("new", "y"), ("new", "z")]
    path = str(tmp_path / "batch")
    spark.createDataFrame(rows, "id string, content string").write.parquet(path)
    batch = spark.read.parquet(path)
    stored = spark.range(100_000).select(F.col("id").cast("string").alias("id"))
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 1)
    out = incremental.new_only(batch, stored)
    assert sorted(r.content for r in out.collect()) == ["y", "z"]
    assert "LocalTableScan" in out._jdf.queryExecution().toString()


def test_a_large_cache_is_cut_down_to_the_batch(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"
    seen.mkdir()
    cache = str(tmp_path / "cache")
    entries = spark.range(20_000).select(
        F.sha1(F.col("id").cast("string")).alias("text_sha1"),
        F.lit("counting").alias("model"),
        F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"),
    )
    E.put_cache(entries, cache)
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 1)
    docs = spark.createDataFrame([(1, "77"), (2, "new"), (3, "77")], "i int, text string")
    out = E.embed_documents(docs, Counting(str(seen)), cache_path=cache)
    got = {r.i: list(r.embedding) for r in out.collect()}
    assert got == {1: [77.0, 1.0], 2: [3.0, 1.0], 3: [77.0, 1.0]}
    assert asked(str(seen)) == ["new"]


def test_small_inputs_are_spread_and_others_left(spark, tmp_path):
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    spark.range(100).coalesce(1).write.parquet(one)
    spark.range(100).repartition(8).write.parquet(many)
    cores = spark.sparkContext.defaultParallelism
    assert storage.file_count(spark.read.parquet(many)) == 8
    assert storage.spread(spark.read.parquet(one)).rdd.getNumPartitions() == cores
    left = spark.read.parquet(many)
    assert storage.spread(left) is left


def test_empty_and_settled_sizes_are_known(spark):
    empty = storage.empty(spark, "id string, v array<double>")
    assert empty.count() == 0 and storage.planned_bytes(empty) < 100
    small, _ = storage.settled(spark.range(10), 10)
    assert storage.planned_bytes(small) < 10_000
