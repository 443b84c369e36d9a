import random
from collections import Counter

import numpy as np
import pytest

from nearkin.llm import repeats
from nearkin.llm.repeats import Anchors, SuffixFamily, remove_repeats
from tests.llm.cases import clashing, documents


def brute(texts):
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(b[k : k + 200] for b in data for k in range(len(b) - 199))
    rows = []
    for (i, _), b in zip(texts, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        rows.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(rows, key=repr)


def result(spark, texts):
    rows = remove_repeats(clashing(documents(spark, texts)).repartition(5)).collect()
    return sorted(
        ((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept))
         for r in rows), key=repr)


def sample():
    rng = random.Random(8)

    def prose(n):
        return "".join(rng.choice("abcdefgh é\n") for _ in range(n))

    shared = [prose(n) for n in (199, 200, 201, 350, 1200)]
    texts = [(i, prose(rng.randint(0, 700)) + rng.choice(shared) + prose(rng.randint(0, 300))) for i in range(60)]
    texts += [(100 + i, shared[4][: 250 + 13 * i]) for i in range(20)]
    texts += [(200, "a" * 199), (201, "b" * 200), (202, "c" * 201), (203, "ab" * 300), (204, None), (205, "")]
    texts += [(206, texts[0][1]), (206, texts[0][1]), (None, texts[1][1]), (207, "\x00" * 450)]
    near = prose(900)
    texts += [(300 + i, near[: 7 * i] + "#" + near[7 * i :]) for i in range(40)]
    return texts


@pytest.mark.parametrize("hot", [256, 8, 1])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_ENTRIES", hot)
    texts = sample()
    assert result(spark, texts) == brute(texts)


def test_empty(spark):
    assert remove_repeats(documents(spark).limit(0)).count() == 0


def test_family_merges_and_matches():
    rng = random.Random(1)
    family, texts = SuffixFamily(8), []
    for _ in range(37):
        batch = [bytes(rng.choice(b"\x00ab") for _ in range(8)) for _ in range(rng.randint(1, 9))]
        owners = np.arange(len(texts), len(texts) + len(batch))
        texts += batch
        family.add(np.frombuffer(b"".join(batch), "S8"), owners)
    seen = Counter(texts)
    assert family.matched.tolist() == [i for i, s in enumerate(texts) if seen[s] > 1]
    ranks = [rank for rank, _, _ in family.levels]
    assert ranks == sorted(set(ranks), reverse=True)


def test_anchors_do_not_depend_on_pieces():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 199, 200, 260, 5000, 900)]

    def starts(piece):
        found = {}
        for text, first, run, _, k1, _ in Anchors(piece=piece).of(texts):
            for t, f, r, h in zip(text.tolist(), first.tolist(), run.tolist(), k1.tolist(), strict=True):
                found |= {(t, k): h for k in range(f, f + r)}
        return found

    whole = starts(1 << 20)
    assert len(whole) == sum(max(0, len(t) - 199) for t in texts)
    assert starts(300) == whole
