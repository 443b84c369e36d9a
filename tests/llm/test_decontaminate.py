import random

from nearkin.llm.decontaminate import drop_leaks, myers, pieces_of, with_leaks, words_of
from tests.llm.cases import clashing, documents


def distance(pattern, text):
    """Smallest edit distance of the pattern to a stretch of the text, by the table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        before, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            before, row[j] = row[j], min(before + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(300):
        pattern = [rng.choice("abcd") for _ in range(rng.randint(1, 90))]
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 120))]
        masks = {}
        for i, w in enumerate(pattern):
            masks[w] = masks.get(w, 0) | 1 << i
        best, end = myers(masks, len(pattern), text)
        assert best == distance(pattern, text)
        assert distance(pattern, text[:end]) == best


def test_pieces_cover_the_item():
    for n in range(6, 80):
        words = [str(i) for i in range(n)]
        pieces = pieces_of(words, n // 5)
        assert [w for _, p in pieces for w in p] == words
        assert len(pieces) == n // 5 + 1 and all(p for _, p in pieces)


def test_equals_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 40)))) for i in range(25)]
    items += [(99, None), (None, items[3][1]), (98, items[3][1].upper() + "!!"), (97, "")]
    texts = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        if d % 2:
            leak = words_of(items[rng.randrange(25)][1])
            for _ in range(rng.randint(0, 10)):
                at = rng.randrange(len(leak) + 1)
                rng.choice([lambda: leak.insert(at, "new"), lambda: leak.pop(min(at, len(leak) - 1))])()
                leak = leak or ["w"]
            words[len(words) // 2 : len(words) // 2] = leak
        texts.append((d, " , ".join(words).title()))
    texts += [(500, None), (501, ""), (1, texts[1][1])]
    want = []
    for d, t in texts:
        found = []
        for i, item in items:
            pattern = words_of(item or "")
            budget = int(len(pattern) * 0.2) if len(pattern) >= 6 else 0
            if len(pattern) >= 3 and (k := distance(pattern, words_of(t or ""))) <= budget:
                found.append((i, k))
        want.append((d, sorted(found, key=repr)))
    frame = spark.createDataFrame(items, "item_id long, text string")
    for chars in (1 << 20, 300):  # one block of items, or several
        got = with_leaks(clashing(documents(spark, texts)), frame, block_chars=chars).collect()
        rows = [(r.doc_id, sorted(((x.item_id, x.distance) for x in r.leaks), key=repr)) for r in got]
        assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_only_leaks_are_dropped(spark):
    items = spark.createDataFrame([(1, "Quick brown fox jumps over the lazy dog")], "item_id long, text string")
    docs = clashing(documents(spark))
    kept = drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert drop_leaks(docs, items.limit(0)).count() == docs.count()
    assert drop_leaks(docs.limit(0), items).count() == 0


def test_short_items_and_scripts_without_blanks(spark):
    items = spark.createDataFrame(
        [(1, "Name the capital"), (2, "水の沸点は何度ですか"), (3, "two words"), (4, "ok")],
        "item_id long, text string",
    )
    docs = documents(spark, [
        (1, "He said: name the capital, now"), (2, "name a capital"), (3, "問題。水の沸点は何度ですか？答え"),
        (4, "問題。水の沸点は十度ですか？答え"), (5, "two words, ok"), (6, "水が好きです"),
    ])
    found = {r.doc_id: [x.item_id for x in r.leaks] for r in with_leaks(docs, items).collect()}
    # ten characters may differ in two, three words in none
    assert found == {1: [1], 2: [], 3: [2], 4: [2], 5: [], 6: []}
    mine = docs.withColumn("leaks", docs["doc_id"] * 10)
    kept = drop_leaks(mine, items)
    assert kept.columns == mine.columns
    assert sorted((r.doc_id, r.leaks) for r in kept.collect()) == [(2, 20), (5, 50), (6, 60)]
