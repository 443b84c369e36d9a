import corpus_pipeline
from nearkin.llm.common import read
from nearkin.llm.decontaminate import words_of
from tests.llm.test_near_copies import grams, similar

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_is_kept(spark):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, None
    texts = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        ids = {r.doc_id for r in rows}
        assert len(ids) == len(rows)
        assert before is None or ids <= before
        before = ids
        if name != "sentencepiece":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in rows)
            texts[name] = {r.doc_id: r.text for r in rows}
        docs = spark.createDataFrame(rows, docs.schema)
    assert len(texts["toxicity"]) > 0.8 * 200
    assert texts["line_dedup"].keys() == texts["toxicity"].keys()
    kept, given = texts["simhash_near_dedup"], texts["line_dedup"]
    # those that go are similar to another one, and reach one that stays
    sets, low = {i: grams(t) for i, t in given.items()}, {i: i for i in given}
    links = [(a, b) for a in given for b in given if b < a and similar(sets[a], sets[b])]
    for _ in given:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert kept.keys() == {i for i in given if low[i] == i}
    assert len(kept) < len(given)
    items = [f" {' '.join(words_of(r.text))} " for r in read(spark, SF, "benchmark").collect()]
    for text in texts["benchmark_decontamination"].values():
        assert not any(item in f" {' '.join(words_of(text))} " for item in items)
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r.round_trip for r in rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"
    ]
