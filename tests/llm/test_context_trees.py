import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from nearkin.llm.context_trees import DEPTH, log_kt, score_texts
from tests.llm.cases import TEXTS, clashing, documents


def kt(a, b):
    p = 1.0
    for i in range(a):
        p *= (i + 0.5) / (i + 1)
    for i in range(b):
        p *= (i + 0.5) / (a + i + 1)
    return p


def test_estimator():
    for a in range(12):
        for b in range(12):
            got = log_kt(np.array([float(a)]), np.array([float(b)]))[0]
            assert got == pytest.approx(math.log(kt(a, b)), abs=1e-9)


def symbols(text):
    data = b"\xfe" * DEPTH + (text or "").encode().lower() + b"\xff"
    return [(data[i - DEPTH : i][::-1], data[i]) for i in range(DEPTH, len(data))]


class Trees:
    """The weighted trees by their definition, node by node."""

    def __init__(self, texts):
        self.n = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        self.memo = {}
        for text in texts:
            for ctx, byte in symbols(text):
                node = 1
                for j in range(7, -1, -1):
                    bit = byte >> j & 1
                    for d in range(DEPTH + 1):
                        self.n[ctx[:d], node][bit] += 1
                        if d:
                            self.children[ctx[: d - 1], node].add(ctx[:d])
                    node = 2 * node + bit

    def own(self, ctx, node):
        return log_kt(*(np.array([float(x)]) for x in self.n.get((ctx, node), (0, 0))))[0]

    def weighted(self, ctx, node):
        if (ctx, node) not in self.memo:
            value = self.own(ctx, node)
            if len(ctx) < DEPTH:
                below = sum(self.weighted(c, node) for c in self.children.get((ctx, node), ()))
                value = np.logaddexp(math.log(0.5) + value, math.log(0.5) + below)
            self.memo[ctx, node] = value
        return self.memo[ctx, node]

    def one(self, ctx, node, depth=0):
        a, b = self.n.get((ctx[:depth], node), (0, 0))
        p = (b + 0.5) / (a + b + 1)
        if depth == DEPTH:
            return p
        at = ctx[:depth]
        stop = math.exp(math.log(0.5) + self.own(at, node) - self.weighted(at, node))
        return stop * p + (1 - stop) * self.one(ctx, node, depth + 1)

    def score(self, text):
        total = 0.0
        for ctx, byte in symbols(text):
            node = 1
            for j in range(7, -1, -1):
                p = self.one(ctx, node)
                total += math.log10(p if byte >> j & 1 else 1 - p)
                node = 2 * node + (byte >> j & 1)
        return total


def sample():
    small = [(i, t if t is None else t[:120]) for i, t in TEXTS]
    return small + [(20 + i, f"the cat number {i} sat on The mat\n") for i in range(8)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_equals_the_definition(spark, block_bytes):
    texts = sample()
    docs = clashing(documents(spark, texts))
    got = score_texts(docs, "doc_id % 3 != 1", block_bytes=block_bytes).collect()
    learn = [t for i, t in texts if i % 3 != 1]
    trees = Trees(learn)
    words = Counter(w for t in learn for w in (t or "").encode().lower().split())
    words[None] = len(learn)
    n, unit = sum(words.values()), sum(words.values()) + 0.5 * (len(words) + 1)
    rows = defaultdict(list)
    for r in got:
        rows[r.doc_id].append(r)
    assert len(got) == len(texts)
    for i, t in texts:
        r = rows[i].pop()
        mine = [*(t or "").encode().lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(mine), sum(words[w] > 0 for w in mine), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.5) / unit) for w in mine), rel=1e-9)
        assert r.score == pytest.approx(trees.score(t), rel=1e-6)
        assert r.n_bytes == len((t or "").encode())


def test_without_training_or_documents(spark):
    rows = score_texts(documents(spark), "false").collect()
    assert {r.n_known for r in rows} == {0}
    for r in rows:
        assert r.score == pytest.approx(8 * (r.n_bytes + 1) * math.log10(0.5))
    assert score_texts(documents(spark).limit(0), "true").count() == 0


def test_probabilities_of_a_context_sum_to_one(spark):
    train = [(i, "abracadabra alakazam") for i in range(5)]
    # a text of one byte is that byte and the end, both after a known beginning
    probe = [(100 + b, chr(b)) for b in range(128)]
    rows = score_texts(documents(spark, train + probe), "doc_id < 100").collect()
    trees = Trees([t for _, t in train])
    start = b"\xfe" * DEPTH
    first = {}
    for byte in range(256):
        node, p = 1, 1.0
        for j in range(7, -1, -1):
            one = trees.one(start, node)
            p *= one if byte >> j & 1 else 1 - one
            node = 2 * node + (byte >> j & 1)
        first[byte] = p
    assert sum(first.values()) == pytest.approx(1)
    assert all(r.score < 0 for r in rows)
