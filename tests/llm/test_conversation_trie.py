import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from nearkin.llm.conversation_trie import conversation_trie, digest_turns, shared_openings

SCHEMA = "conv_id long, turn long, role string, text string"

ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 2, "user", "bye"),
    (2, 1, "assistant", "hi"), (2, 0, "user", "hello"),
    (3, 0, "user", "hello"), (3, 1, "assistant", "hi"), (3, 2, "user", "bye"),
    (4, None, None, None), (4, 0, "", ""), (4, 0, "", ""),
    (5, 0, "user", "日本"), (6, 0, "userhello", ""), (7, 0, "user", "x" * 50_000),
    (None, 0, "user", "nobody's"),
    *((20 + i, t, "user", f"same {t}") for i in range(12) for t in range(30)),
    *((40 + i, t, "user", f"same {t}") for i in range(30) for t in range(i)),
    *((80 + i, t, "user", f"same {min(t, 3)} {i if t > 5 else 0}") for i in range(5) for t in range(9)),
    (-3, 0, "user", "hello"), (-5, 0, "user", "below"), (-7, 0, "user", "zero"),
]


def by_hand(rows, family=None, most=9):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    if family:
        given, convs = convs, {}
        for c, turns in given.items():
            h = zlib.crc32(str(c).encode()) % most
            base = c - (c % family if c >= 0 else -(-c % family))
            convs[c] = given.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in kids[node])
    return sorted(
        (
            min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]),
            len(kids[n]), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest(),
        )
        for n in members
    )


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("peel_turns, top_nodes", [(50_000, 100), (20, 1_000), (20, 0), (1, 1_000)])
def test_equals_nodes_by_hand(spark, peel_turns, top_nodes):
    turns = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = conversation_trie(digest_turns(turns), peel_turns=peel_turns, top_nodes=top_nodes)
    assert rows_of(got) == by_hand(ROWS)


def test_conversations_without_turns_end_at_the_root(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    got = rows_of(conversation_trie(shared_openings(digest_turns(turns)), peel_turns=30))
    assert got == by_hand(ROWS, family=5)


def test_many_copies_are_one_sequence(spark):
    rows = spark.range(3_000).select(
        F.col("id").alias("conv_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("turn"),
        F.lit("user").alias("role"), F.lit("again").alias("text"),
    )
    got = rows_of(conversation_trie(digest_turns(rows)))
    ends = hashlib.sha256(",".join(map(str, range(3_000))).encode()).hexdigest()
    none = hashlib.sha256().hexdigest()
    assert [(r[1], r[3], r[4], r[7]) for r in got] == [
        (0, 3_000, 1, none), (1, 3_000, 1, none), (2, 3_000, 1, none), (3, 3_000, 0, ends)
    ]
    assert [r[6] for r in got] == [3 * 2_999 * 5, 3 * 2_999 * 5, 2 * 2_999 * 5, 2_999 * 5]


def test_empty_table_and_other_columns(spark):
    turns = spark.createDataFrame(ROWS, SCHEMA)
    assert rows_of(conversation_trie(digest_turns(turns.where("1 = 0")))) == []
    assert rows_of(conversation_trie(digest_turns(turns.where("conv_id IS NULL")))) == []
    for name in ("conv", "t", "a", "bytes", "turns", "key", "n", "depth", "ends", "whole"):
        turns = turns.withColumn(name, F.lit(7))
    assert rows_of(conversation_trie(digest_turns(turns))) == by_hand(ROWS)

