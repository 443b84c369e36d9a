import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from nearkin.llm.token_shards import (
    PerfectHash,
    WordEncoder,
    key_hash,
    lookup,
    public_encoder,
    read_documents,
    write_shards,
)
from nearkin.sources.storage import scratch_path
from tests.llm.cases import TEXTS, clashing, documents

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path(NAME))


def test_encoder_equals_the_library(library):
    rng = random.Random(2)
    parts = ["A", "b", ".", ",", "'s", "'T", " ", "\n", "é", "É", "É", "́", "ß", "İ", "Σ", "1", "22",
             "<|endoftext|>", "日本", " ", "　", "!?", "...", "don't", "x.y,z", "\x1c", "\x85", "👍🏽", "ñandú", "ÿ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += [t or "" for _, t in TEXTS]
    encoder = WordEncoder(public_tokenizers.path(NAME))
    encoder._store.limit = 500
    for i in range(0, len(texts), 600):
        part = texts[i : i + 600]
        ids, sizes = encoder.encode(pa.array(part))
        at = 0
        for t, n, e in zip(part, sizes.tolist(), library.encode_batch(part, add_special_tokens=False), strict=True):
            assert ids[at : at + n].tolist() == e.ids, t
            at += n


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 20_000)
    hashes = key_hash(keys, np.zeros(len(keys), np.int32))
    index = PerfectHash.build(hashes)
    assert sorted(index.slots(hashes).tolist()) == list(range(len(keys)))
    forced = PerfectHash.build(np.array([5, 5], np.uint64))  # never told apart: listed
    assert len(forced.rest) == 2
    assert PerfectHash.build(np.empty(0, np.uint64)).slots(hashes[:3]).tolist() == [-1, -1, -1]


@pytest.mark.parametrize("shard_ids", [20, 1 << 20])
def test_round_trip(spark, library, shard_ids):
    path = scratch_path(spark, "shards")
    texts = TEXTS + [(1000 - i, f"document {i} of many") for i in range(300)]
    write_shards(clashing(documents(spark, texts)), path, public_encoder(NAME), shard_ids=shard_ids)
    rows = sorted(read_documents(spark, path, with_ids=True).collect(), key=lambda r: (r.key, r.turn))
    want = {}
    for i, t in texts:
        want.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    assert sorted(r.ids for r in rows) == sorted(x for xs in want.values() for x in xs)
    start = 0
    for r in rows:
        assert r.ids in want[r.key] and r.n_ids == len(r.ids) and r.start == start
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_ids
    asked = spark.createDataFrame([(2,), (2,), (950,), (-5,), (5000,), (None,)], "key long")
    got = sorted((r.key, r.ids) for r in lookup(spark, path, asked).collect())
    assert got == sorted([(2, want[2][0]), (2, want[2][0]), (950, want[950][0])])


def test_no_documents(spark):
    path = scratch_path(spark, "shards")
    write_shards(documents(spark).limit(0), path, public_encoder(NAME))
    assert read_documents(spark, path).count() == 0


@pytest.mark.parametrize("shard_ids", [3, 1 << 20])
def test_null_ids_come_first_and_answer_to_no_key(spark, library, shard_ids):
    path = scratch_path(spark, "shards")
    texts = [(None, "x y"), (0, "zero"), (None, "z"), (-5, "below"), (None, "x y"), (7, None)]
    write_shards(documents(spark, texts), path, public_encoder(NAME), shard_ids=shard_ids)
    rows = sorted(read_documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.key for r in rows] == [None, None, None, -5, 0, 7]
    assert sorted(r.turn for r in rows[:3]) == [0, 1, 2]
    asked = spark.createDataFrame([(0,), (-5,), (7,), (None,), (1,)], "key long")
    got = {r.key: r.ids for r in lookup(spark, path, asked).collect()}
    encode = lambda t: [*library.encode(t, add_special_tokens=False).ids, 2]
    assert got == {0: encode("zero"), -5: encode("below"), 7: [2]}
