import pytest
from pyspark.errors import StreamingQueryException

from nearkin.operators.embedding import HashedWords
from nearkin.plans import ingest
from nearkin.streaming import ingest as streaming

EMBEDDER = HashedWords(8)


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.pdf").write_text(text)


def run(spark, folder, path, progress, **options):
    query = streaming.start_folder_ingest(spark, str(folder), path, progress, EMBEDDER, **options)
    query.awaitTermination()
    return query


def names(spark, path):
    return sorted(r.filename for r in ingest.stored_documents(spark, path).collect())


def test_ids_are_remembered_over_batches_runs_and_other_writers(spark, tmp_path):
    folder, path, progress = tmp_path / "in", str(tmp_path / "docs"), str(tmp_path / "progress")
    write(folder, a="one", b="one", c="two", e=" \n")
    run(spark, folder, path, progress, max_files=1)
    assert len(names(spark, path)) == 2
    # stored by others meanwhile, and again as files under other names
    other = tmp_path / "other"
    write(other, x="three")
    ingest.ingest_folder(spark, str(other), path, EMBEDDER)
    write(folder, f="three", g="two", h="four", i=" \n")
    run(spark, folder, path, progress, max_files=2)
    got = names(spark, path)
    assert len(got) == 4 and {"x.pdf", "h.pdf"} <= set(got)
    # one rejected file of the earlier run, told once by its last try
    assert len({r.id for r in ingest.rejected_files(spark, path).collect()}) == 1


def test_a_batch_that_was_stored_but_not_committed(spark, tmp_path, monkeypatch):
    folder, path, progress = tmp_path / "in", str(tmp_path / "docs"), str(tmp_path / "progress")
    write(folder, a="one", b="two", c="three")
    stored = streaming.store_documents

    def breaks(rows, where):
        stored(rows, where)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(streaming, "store_documents", breaks)
        with pytest.raises(StreamingQueryException):
            run(spark, folder, path, progress)
    assert names(spark, path) == ["a.pdf", "b.pdf", "c.pdf"]
    run(spark, folder, path, progress)
    assert names(spark, path) == ["a.pdf", "b.pdf", "c.pdf"]
    write(folder, d="four")
    run(spark, folder, path, progress)
    assert names(spark, path) == ["a.pdf", "b.pdf", "c.pdf", "d.pdf"]


def test_later_batches_do_not_read_what_is_stored(spark, tmp_path, monkeypatch):
    folder, path, progress = tmp_path / "in", str(tmp_path / "docs"), str(tmp_path / "progress")
    write(folder, a="one", b="two", c="three", d="four")
    asked = []
    table = streaming.stored_documents

    def counted(*args):
        asked.append(args)
        return table(*args)

    monkeypatch.setattr(streaming, "stored_documents", counted)
    query = run(spark, folder, path, progress, max_files=1)
    assert len(names(spark, path)) == 4 and len(asked) == 1
    assert any("RocksDB" in str(p) or "state" in str(p) for p in query.recentProgress)
