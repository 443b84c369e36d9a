import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearkin.llm.common import read
from nearkin.llm.word_runs import find_runs, looped_texts, op12_word_runs, word_runs
from tests.llm.cases import TEXTS, clashing, documents

SF = "/root/testdata/sf0.001"


def by_hand(w, min_words=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, q, e) for (s, e), q in found.items() if e - s >= max(min_words, 2 * q))


def check(texts, min_words):
    flat = np.array([w for t in texts for w in t], np.int64)
    got = find_runs(flat, np.array([len(t) for t in texts], np.int64), min_words)
    wanted, at = [], 0
    for t in texts:
        wanted += [(s + at, e + at, q) for s, q, e in by_hand(t, min_words)]
        at += len(t)
    assert [tuple(r) for r in got.tolist()] == wanted


def made_up(rng):
    n, kind = rng.randrange(140), rng.randrange(5)
    if kind == 0:
        letters = rng.randrange(1, 5)
        return [rng.randrange(letters) for _ in range(n)]
    if kind == 1:
        block = [rng.randrange(3) for _ in range(rng.randrange(1, 30))]
        return (block * 140)[:n]
    if kind == 2:  # periodic regions that meet out of step
        block = [rng.randrange(3) for _ in range(rng.randrange(1, 5))]
        return sum(((block * 60)[: rng.randrange(60)] for _ in range(3)), [])
    if kind == 3:
        a, b = [0], [0, 1]
        while len(b) < n + 2:
            a, b = b, b + a
        return b[:n]
    block = [rng.randrange(50) for _ in range(rng.randrange(1, 20))]
    noise = [[rng.randrange(50) for _ in range(rng.randrange(30))] for _ in range(2)]
    return noise[0] + block * rng.randrange(1, 6) + block[: rng.randrange(len(block) + 1)] + noise[1]


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_runs_by_hand(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = [made_up(rng) for _ in range(rng.randrange(1, 6))]
        for min_words in (2, 12):
            check(texts, min_words)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 11, 12, 13, 600])
def test_one_word_alone(n):
    check([[7] * n], 12)


def test_squares_across_a_seam():
    check([[0, 1] * 40 + [0] + [0, 1] * 40], 2)
    check([[0, 1, 2] * 20 + [2, 0, 1] * 25, [0, 1, 1] * 30 + [1, 0, 1] * 30], 2)


def test_a_long_text_among_short_ones():
    rng = random.Random(3)
    long = [rng.randrange(1000) for _ in range(700)]
    check([[1, 2] * 9, long + long + long[:100], [3] * 20], 12)


def told(text, doc_id, loops=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if loops and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = by_hand(w)
    gone = {i for s, q, e in runs for i in range(s + q, e)}
    best = min(runs, key=lambda r: (r[0] - r[2], r[0], r[1]), default=None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, q, e in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    longest = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_query_equals_brute_force(spark):
    docs = read(spark, SF, "documents").collect()
    short = {r.doc_id for r in docs if len(r.text or "") < 8_000}
    got = order(op12_word_runs(spark, SF).where(F.col("doc_id").isin(*short)).collect())
    assert got == order(told(r.text, r.doc_id) for r in docs if r.doc_id in short)
    assert op12_word_runs(spark, SF).count() == len(docs)
    assert any(r[1] for r in got)


def test_unusual_rows(spark):
    texts = [*TEXTS, (10, "a b " * 9 + "\x0b\x1c a"), (11, "no break " * 12), (12, "a a"), (None, "z " * 13)]
    docs = documents(spark, texts).repartition(3)
    rows = word_runs(clashing(docs)).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r for r in rows}
    assert [tuple(x) for x in by_id[6].runs] == [(0, 3000, 1)] and by_id[6].collapsed == "word"
    assert [tuple(x) for x in by_id[10].runs] == [(0, 18, 2)] and by_id[10].collapsed == "a b \x1c a"
    assert [tuple(x) for x in by_id[11].runs] == [(0, 12, 1)]
    assert by_id[None].n_words == 13 and by_id[None].collapsed == "z"
    for i in (3, 4, 5):
        assert (by_id[i].n_words, by_id[i].runs, by_id[i].collapsed) == (0, [], "")
    assert word_runs(docs.where("1 = 0")).collect() == []
    looped = looped_texts(clashing(docs)).collect()
    assert order((r.doc_id, (r.text or "").split()) for r in looped if r.doc_id != 6) == order(
        (i, (t or "").split()) for i, t in texts if i != 6
    ) or any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in texts)
