import random

import xxhash

from nearkin.llm.simhash import MAX_BITS, fingerprint, fingerprint_links, keep_one, simhash_groups
from tests.llm.cases import TEXTS, clashing, documents


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    n = len(words)
    grams = [b" ".join(words[i : i + 3]) for i in range(n - 2)] or [b" ".join(words)][: n > 0]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_definition():
    for _, t in TEXTS:
        assert fingerprint((t or "").encode()) == plain_fingerprint(t)
    assert fingerprint(b"") == 0
    assert fingerprint("É x".encode()) != fingerprint("é x".encode())
    assert fingerprint(b"A\x0bB C") == fingerprint(b"a b  c")


def test_links_are_all_pairs_within_two_bits(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for n in (1, 2, 3):
            q = p
            for b in rng.sample(range(64), n):
                q ^= 1 << b
            prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r.a, r.b) for r in fingerprint_links(df).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in signed for b in signed
            if a < b and ((a ^ b) & mask).bit_count() <= MAX_BITS}
    assert got == want and want


def test_groups(spark):
    rng = random.Random(1)
    base = [str(rng.randrange(10**6)) for _ in range(400)]
    texts = list(TEXTS)
    for i in range(12):
        near = list(base)
        near[i * 5] = "changed"
        texts.append((20 + i, " ".join(near)))
    texts.append((None, "one"))
    prints = [(i, plain_fingerprint(t)) for i, t in texts]
    low = [i for i, _ in prints]
    for _ in prints:
        for x, (_, p) in enumerate(prints):
            for y, (_, q) in enumerate(prints):
                if (p ^ q).bit_count() <= 2 and low[y] is not None:
                    low[x] = low[y] if low[x] is None else min(low[x], low[y])
    want = sorted(((i, f"{p:016x}", c) for (i, p), c in zip(prints, low, strict=True)), key=repr)
    got = simhash_groups(clashing(documents(spark, texts))).collect()
    rows = sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got), key=repr)
    assert rows == want


def test_one_of_each_group_stays(spark):
    docs = clashing(documents(spark))
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8, 9]
    assert keep_one(docs.limit(0)).count() == 0
