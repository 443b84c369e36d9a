import hashlib
import os

import pytest
from pyspark.sql import functions as F

from nearkin.operators import embedding as E
from nearkin.operators.embedding import CACHE_SCHEMA


class Length:
    """Vectors of text lengths; texts with ``bad`` in them fail."""

    model = "length"

    def __call__(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t))] for t in texts]


def sha(text):
    return hashlib.sha1(text.encode()).hexdigest()


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string")


def vectors(df):
    return {r.i: r.embedding and list(r.embedding) for r in df.collect()}


def files(cache):
    return [n for _, _, names in os.walk(cache) for n in names if n.endswith(".parquet")]


def test_only_parts_with_wanted_hashes_are_read(spark, tmp_path):
    cache = str(tmp_path / "cache")
    texts = [f"text {i}" for i in range(400)]
    E.embed_documents(docs(spark, texts), Length(), cache_path=cache).collect()
    assert len(files(cache)) == 16
    few = [t for t in texts if sha(t)[0] in "3b"][:5]
    out = E.embed_documents(docs(spark, few), Length(), cache_path=cache)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "prefix" in plan and "model" in plan
    read = {p.split("prefix=")[1][0] for p in out.inputFiles() if "prefix=" in p}
    scanned = E.Keys(E.read_cache(spark, cache).where(F.col("text_sha1").isin([sha(t) for t in few])))
    assert set(scanned.prefixes) <= {"3", "b"} <= read
    part = scanned.part_of(E.read_cache(spark, cache), "length")
    names = part.select(F.input_file_name()).distinct().collect()
    assert {n[0].split("prefix=")[1][0] for n in names} == set(scanned.prefixes)
    assert vectors(out) == {i: [float(len(t))] for i, t in enumerate(few)}


def test_entries_written_twice_count_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = [(sha(t), "length", [float(len(t))]) for t in ("a", "bb", "a", "ccc")]
    entries = spark.createDataFrame(rows, "text_sha1 string, model string, embedding array<double>")
    for _ in range(2):
        E.put_cache(entries, cache)
    out = E.embed_documents(docs(spark, ["a", "bb", "a"]), Length(), cache_path=cache)
    assert vectors(out) == {0: [1.0], 1: [2.0], 2: [1.0]} and out.count() == 3
    keyed = spark.createDataFrame([(0, sha("a")), (1, sha("zz"))], "i int, text_sha1 string")
    found = E.cache_lookup(keyed, E.read_cache(spark, cache), "length")
    assert vectors(found) == {0: [1.0], 1: None} and found.count() == 2
    E.compact_cache(spark, cache)
    assert E.read_cache(spark, cache).groupBy("text_sha1").count().where("count > 1").isEmpty()
    again = E.embed_documents(docs(spark, ["a", "bb", "new"]), Length(), cache_path=cache)
    assert vectors(again) == {0: [1.0], 1: [2.0], 2: [3.0]}


def test_failures_are_told_and_tried_again(spark, tmp_path):
    cache = str(tmp_path / "cache")
    out = E.embed_documents(docs(spark, ["ok", "bad"]), Length(), cache_path=cache)
    got = {r.i: r for r in out.collect()}
    assert got[0].error is None and got[1].embedding is None and "no" in got[1].error
    # an earlier failure is neither a hit nor told a second time beside a new result
    class Mended(Length):
        def __call__(self, texts):
            return [[float(len(t))] for t in texts]

    again = E.embed_documents(docs(spark, ["ok", "bad"]), Mended(), cache_path=cache)
    assert vectors(again) == {0: [2.0], 1: [3.0]} and again.count() == 2
    E.compact_cache(spark, cache)
    left = E.read_cache(spark, cache)
    assert left.count() == 2 and left.where("error IS NOT NULL").isEmpty()


def test_an_empty_batch_or_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    assert E.embed_documents(docs(spark, ["x"]).limit(0), Length(), cache_path=cache).collect() == []
    E.compact_cache(spark, cache)
    empty = E.read_cache(spark, cache)
    assert empty.count() == 0 and set(empty.columns) == {c.split()[0] for c in CACHE_SCHEMA.split(", ")}


@pytest.mark.parametrize("few", [0, 100])
def test_many_keys_are_joined(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(E, "MAX_BROADCAST_KEYS", few)
    cache = str(tmp_path / "cache")
    texts = ["x", "yy", "x", "", "bad"]
    for _ in range(2):
        out = E.embed_documents(docs(spark, texts), Length(), cache_path=cache)
        assert vectors(out) == {0: [1.0], 1: [2.0], 2: [1.0], 3: None, 4: None}
        assert out.count() == 5
