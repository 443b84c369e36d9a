"""Workers hold a bounded part of a batch as Python objects."""

import pyarrow as pa
from pyspark.sql import functions as F

from nearkin.operators import embedding as E


def test_parts_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(E, "PART_BYTES", 100)
    rows = [["x" * 40], None, [], ["y" * 30, None, "z" * 30], ["w" * 500], ["v"] * 3, ["u" * 100]]
    batch = pa.array([["cut off"], *rows], pa.list_(pa.string())).slice(1)
    parts = [p.to_pylist() for p in E._parts(batch)]
    assert [r for p in parts for r in p] == rows
    assert len(parts) > 3
    held = [[sum(len(c or "") for c in d or []) for d in p] for p in parts]
    assert all(sum(p) <= 100 or sum(1 for n in p if n) == 1 for p in held)
    assert list(E._parts(batch.slice(0, 0))) == []


def test_few_texts_are_python_strings_at_a_time(spark):
    """A batch of eight megabytes; the embedder finds no more than a part of it in memory."""

    def embedder(texts):
        import gc

        held = [x for x in gc.get_objects() if type(x) is list and x and type(x[0]) is str]
        size = sum({id(s): len(s) for x in held for s in x if type(s) is str and len(s) > 9_000}.values())
        return [[float(size), 1.0]] * len(texts)

    docs = spark.range(0, 800, 1, 1).select("id", F.array(F.rpad(F.col("id").cast("string"), 10_000, "x")).alias("c"))
    rows = docs.select("id", E.pooled_embedding(F.col("c"), embedder, 8).alias("e")).collect()
    assert sorted(r.id for r in rows) == list(range(800))
    assert all(r.e.error is None for r in rows)
    assert 0 < max(r.e.embedding[0] for r in rows) <= 2 * (1 << 20)
