import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from nearkin.llm.common import IdStore
from nearkin.llm.pieces import PieceModel, decode_pieces, encode_pieces, model_path
from tests.llm.cases import TEXTS, clashing, documents


@pytest.fixture(scope="module")
def model():
    return PieceModel.load(model_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def texts(model):
    rng = random.Random(11)
    odd = [t or "" for _, t in TEXTS]
    odd += [" ", "▁▁a", "<s></s>", "----====" * 9, "a  b   c ", "\t\tdef f(x):\n", "　", "́a"]
    odd += ["".join(rng.choice("abcdeirtnos  ing.▁日\n") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    pieces = model.pieces
    odd += ["".join(pieces[rng.randrange(259, 32000)] for _ in range(6)).replace("▁", " ") for _ in range(1500)]
    return odd


@pytest.mark.parametrize("limit", [100, 10**6])
def test_equals_the_library(model, library, limit):
    store, some = IdStore(limit), texts(model)
    for i in range(0, len(some), 700):
        part = some[i : i + 700]
        ids, sizes = model.encode([t.encode() for t in part], store)
        decoded = model.decode(ids, sizes)
        at = 0
        for t, n, want, text in zip(part, sizes.tolist(), library.encode(part), decoded, strict=True):
            assert ids[at : at + n].tolist() == want, t
            assert text == library.decode(want)
            at += n


def test_frames(spark, library):
    docs = clashing(documents(spark))
    encoded = encode_pieces(docs, model_path())
    assert encoded.columns == [*(c for c in docs.columns if c != "ids"), "ids"]
    rows = encoded.collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == sorted(
        (i, library.encode(t or "")) for i, t in TEXTS
    )
    back = decode_pieces(encoded.withColumn("was", F.coalesce("text", F.lit(""))), model_path())
    assert back.where("was = text").count() == len(TEXTS)
    assert encode_pieces(docs.limit(0), model_path()).count() == 0
