import math
import random

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from nearkin.llm.common import fold_of, read
from nearkin.llm.toxicity import (
    FEATURES,
    Lexicon,
    drop_toxic,
    fit_toxicity,
    op6_toxicity,
    score_toxicity,
)
from tests.llm.cases import TEXTS, clashing, documents

NEAR = 4


def labelled(spark, n=400):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in "bdfgklm" for b in ("ata", "oro", "ine", "usk")]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            text[3:3] = ["you", rng.choice(["vrokka", "vrokken", "zumpf"])]
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_learns_words_beginnings_and_disguises(spark):
    rows, labels = labelled(spark)
    frame = spark.createDataFrame(labels + [(None, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    docs = documents(spark, rows)
    model = fit_toxicity(docs, frame)
    new = [(1, "data you zumpf data oro"), (2, "kata vrokkanate oro"), (3, "kata Zumpf!!! ine"),
           (4, "kata zu*pf ine oro"), (5, "kata oro ine usk"), (6, None), (7, "")]
    scored = score_toxicity(clashing(documents(spark, new)).withColumnRenamed("score", "s"), model)
    got = {r.doc_id: (r.score, r.predicted) for r in scored.collect()}
    assert [got[i][1] for i in (1, 2, 3, 4)] == [1, 1, 1, 1]
    assert [got[i][1] for i in (5, 6, 7)] == [0, 0, 0]
    assert all(0 <= s <= 1 and (s >= 0.5) == (p == 1) for s, p in got.values())
    docs = clashing(documents(spark, new))
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [5, 6, 7]


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = clashing(documents(spark))
    model = fit_toxicity(docs, none)
    assert [r.predicted for r in score_toxicity(docs, model).collect()] == [0] * len(TEXTS)
    assert drop_toxic(docs, model).count() == len(TEXTS)
    assert score_toxicity(docs.limit(0), model).count() == 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert score_toxicity(docs, fit_toxicity(docs, one)).where("predicted = 1").count() == len(TEXTS)


def test_features_of_odd_texts():
    lexicon = Lexicon({"stupid": 2.0})
    for _, t in TEXTS:
        assert len(lexicon.features(t or "")) == 17
    assert lexicon.token("st*pid")[:2] == (2.0, True) and lexicon.token("s7upid!")[0] == 2.0
    assert lexicon.token("STUPIDDD")[0] == 2.0 and lexicon.token("stupor")[0] == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = op6_toxicity(spark, sf).where("held_out").join(labels, "doc_id")
    right = scored.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int"))).first()[0]
    assert right >= 0.95
    assert scored.where(fold_of(F.col("doc_id")) != 0).count() == 0


def by_hand(lexicon, text):
    """The features once more, token by token and character by character."""
    tokens = text.split()
    marks = [lexicon.token(t) for t in tokens]
    n, hits = max(1, len(tokens)), [m[0] for m in marks if m[0] > 0]
    near = sum(
        any(marks[j][2] for j in range(max(0, i - NEAR), min(len(marks), i + NEAR + 1)))
        for i, m in enumerate(marks) if m[0] > 0
    )
    data = text.encode()
    chars = max(1, len(data))
    digits = sum(48 <= c <= 57 for c in data)
    capitals = sum(65 <= c <= 90 for c in data)
    signs = sum(33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in data)
    blanks = sum(c in b" \t\n\r\x0b\x0c" for c in data)
    return {
        "log_words": math.log1p(len(tokens)),
        "hits_per_word": len(hits) / n,
        "log_hits": math.log1p(len(hits)),
        "weight_per_word": sum(hits) / n,
        "top_weight": max(hits, default=0.0),
        "disguised_hits": sum(m[1] for m in marks if m[0] > 0),
        "hits_near_you": near / n,
        "you_per_word": sum(m[2] for m in marks) / n,
        "shouted_per_word": sum(m[3] for m in marks) / n,
        "disguised_per_word": sum(m[4] for m in marks) / n,
        "stretched_per_word": sum(m[5] for m in marks) / n,
        "capitals_per_letter": capitals / max(1, chars - blanks - digits - signs),
        "digits_per_char": digits / chars,
        "marks_per_char": signs / chars,
        "exclamations_per_word": data.count(b"!") / n,
        "questions_per_word": data.count(b"?") / n,
        "symbols_per_word": sum(data.count(c) for c in (b"#", b"$", b"%", b"&", b"*", b"@")) / n,
    }


def test_scores_follow_from_the_model_by_hand(spark):
    """Features, trees and calibration recomputed in plain Python for every document."""
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    labels = read(spark, "/root/testdata/sf0.001", "labels")
    model = fit_toxicity(docs, labels)
    scored = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert scored.keys() == texts.keys()
    trees, weights = model.trees.trees, model.trees.treeWeights
    for doc_id, text in sorted(texts.items())[::4]:
        wanted = by_hand(model.lexicon, text)
        got = dict(zip(FEATURES, model.lexicon.features(text), strict=True))
        assert got == pytest.approx(wanted, abs=1e-9), doc_id
        x = Vectors.dense([wanted[f] for f in FEATURES])
        margin = sum(w * t.predict(x) for w, t in zip(weights, trees, strict=True))
        p = 1 / (1 + math.exp(-2 * margin))
        if model.calibration is not None:
            steps = model.calibration
            at = np.interp(p, steps.boundaries.toArray(), steps.predictions.toArray())
            p = 0.999 * at + 0.001 * p
        assert scored[doc_id].score == pytest.approx(p, abs=1e-9), doc_id
        assert scored[doc_id].predicted == (scored[doc_id].score >= 0.5)


def test_own_columns_named_like_ours(spark):
    docs = clashing(read(spark, "/root/testdata/sf0.001", "documents"))
    labels = read(spark, "/root/testdata/sf0.001", "labels")
    model = fit_toxicity(docs, labels)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert {r.y for r in kept.collect()} == {7}
