"""Benchmark decontamination: pigeonhole pieces and bit-parallel edit distance.

Texts are compared as sequences of words, in lower case and without punctuation.
A test item of m words may differ by k = m // 5 edits of words. It is cut into
k + 1 pieces; a document that holds the item within k edits holds at least one of
these pieces unchanged, so a search for all pieces at once (Aho-Corasick) misses
none. Around each hit, Myers' algorithm computes the smallest distance of the
whole item to any stretch of the document there, 64 and more words at a time in
the bits of an integer.

Test items are the query set: they go to the tasks in blocks of bounded size, and
the documents stay where they lie. Items beyond one block mean another pass, with
the result of each pass written in between.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm.common import batches_of, read, unused
from nearkin.sources.storage import durable

#: Share of an item's words that may be edited.
ERROR_RATE = 0.2
#: Items of fewer words say too little to tell a leak with edits from chance.
MIN_ITEM_WORDS = 6
#: Items of fewer words say too little to tell any leak from chance.
MIN_EXACT_WORDS = 3
#: Characters of test items that go to the tasks at a time.
BLOCK_CHARS = 8 << 20

# Ranges of scripts without spaces, as for chunks, whose characters are words.
_UNSPACED = (
    "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9d"
    "\U00020000-\U0003ffff"
)
_WORD = re.compile(rf"(?=\w)[{_UNSPACED}]|[^\W{_UNSPACED}]+")
_LEAK = "item_id:bigint,distance:int,first_word:int,last_word:int"
_LEAKS = pa.list_(
    pa.struct(
        [
            ("item_id", pa.int64()),
            ("distance", pa.int32()),
            ("first_word", pa.int32()),
            ("last_word", pa.int32()),
        ]
    )
)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def myers(masks: dict[str, int], m: int, text: list[str]) -> tuple[int, int]:
    """Smallest edit distance of a pattern to a stretch of ``text``, and its end.

    ``masks`` has for each word the bits of its places in the pattern of ``m``
    words. The stretch may start anywhere; of equal distances the first end
    counts. ``end`` is one past the last word.
    """
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for i, word in enumerate(text):
        eq = masks.get(word, 0)
        x = eq | minus
        d0 = ((((x & plus) + plus) ^ plus) | x) & full
        hp = (minus | ~(d0 | plus)) & full
        hn = plus & d0
        if hp & high:
            score += 1
        elif hn & high:
            score -= 1
        hp, hn = (hp << 1) & full, (hn << 1) & full
        plus = (hn | ~(d0 | hp)) & full
        minus = hp & d0
        if score < best:
            best, end = score, i + 1
    return best, end


def pieces_of(words: list[str], budget: int) -> list[tuple[int, list[str]]]:
    """``budget + 1`` neighbouring pieces of nearly equal length, with their starts."""
    n = budget + 1
    cuts = [len(words) * i // n for i in range(n + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class LeakFinder:
    """Finds test items in texts."""

    def __init__(
        self,
        items: list[tuple[int | None, str]],
        rate: float,
        min_words: int,
        min_exact: int = MIN_EXACT_WORDS,
    ):
        self.items = []
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if len(words) < min_exact:
                continue
            budget = int(len(words) * rate) if len(words) >= min_words else 0
            masks: dict[str, int] = defaultdict(int)
            for i, word in enumerate(words):
                masks[word] |= 1 << i
            for start, piece in pieces_of(words, budget):
                found[f" {' '.join(piece)} "].append((len(self.items), start))
            self.items.append((item_id, dict(masks), len(words), budget))
        self.automaton = None
        if found:
            self.automaton = ahocorasick.Automaton()
            for piece, places in found.items():
                self.automaton.add_word(piece, (len(piece), places))
            self.automaton.make_automaton()

    def leaks(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """``(item, distance, first word, last word)``, an item once, at its best."""
        if self.automaton is None:
            return []
        words = words_of(text)
        joined = f" {' '.join(words)} "
        windows: dict[int, set[int]] = defaultdict(set)
        starts: list[int] = []
        for last, (length, places) in self.automaton.iter(joined):
            if not starts:
                at = 1
                for word in words:
                    starts.append(at)
                    at += len(word) + 1
            first = bisect_left(starts, last - length + 2)
            for item, offset in places:
                windows[item].add(first - offset)
        found = []
        for item, diagonals in windows.items():
            item_id, masks, m, budget = self.items[item]
            best: tuple[int, int, int] | None = None
            for lo, hi in _merged(sorted(diagonals), m, budget, len(words)):
                distance, end = myers(masks, m, words[lo:hi])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, max(lo, lo + end - m), lo + end - 1)
            if best is not None:
                found.append((item_id, *best))
        return sorted(found, key=lambda x: (x[0] is None, x[0] or 0))


def _merged(diagonals: list[int], m: int, k: int, n: int) -> list[tuple[int, int]]:
    """Stretches of words around the places where the item may start."""
    spans: list[list[int]] = []
    for d in diagonals:
        lo, hi = max(0, d - k), min(n, d + m + k)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    return [(lo, hi) for lo, hi in spans if hi > lo]


def _blocks(items: DataFrame, id_col: str, text_col: str, chars: int) -> Iterator[list]:
    block, size = [], 0
    rows = items.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    for item_id, text in rows.toLocalIterator():
        if block and size + len(text) > chars:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    yield block


def with_leaks(
    docs: DataFrame,
    items: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    error_rate: float = ERROR_RATE,
    min_item_words: int = MIN_ITEM_WORDS,
    min_exact_words: int = MIN_EXACT_WORDS,
    block_chars: int = BLOCK_CHARS,
    leaks_col: str = "leaks",
) -> DataFrame:
    """All columns of ``docs`` and ``leaks``, the test items found in each text.

    ``leaks`` (or ``leaks_col``) is an array of ``item_id, distance, first_word, last_word``, empty
    where there is none; words are counted from 0, and where a distance allows
    several stretches the one of the item's own length at the first end is told.
    Null texts, of documents or items, match nothing; of items that are the same
    text under several ids each is reported; rows may repeat. Items under
    ``min_item_words`` words are looked for without edits, those under
    ``min_exact_words`` not at all. A column ``leaks`` of ``docs`` itself is replaced.
    """
    none = F.array().cast(f"array<struct<{_LEAK}>>")
    result = docs.drop(leaks_col).withColumn(leaks_col, none)
    schema, names = result.schema, result.columns
    for n, block in enumerate(_blocks(items, item_id_col, item_text_col, block_chars)):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = LeakFinder(shared.value, error_rate, min_item_words, min_exact_words)
            for batch in batches_of(batches):
                before = batch[leaks_col].to_pylist()
                texts = batch[text_col].to_pylist()
                leaks = [
                    old + [dict(zip(_LEAKS.value_type.names, x, strict=True)) for x in new]
                    for old, new in zip(
                        before, (finder.leaks(t or "") for t in texts), strict=True
                    )
                ]
                columns = [batch[c] for c in names[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(leaks, _LEAKS)], names=names
                )

        result = (durable(result, "leaks") if n else result).mapInArrow(run, schema)
    return result


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with their own columns."""
    name = unused(docs, "leaks")
    found = with_leaks(docs, items, leaks_col=name, **options)
    return found.where(F.size(name) == 0).select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_leaks(docs, read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").alias("n_items"),
        F.array_sort(F.transform("leaks", lambda x: x["item_id"])).alias("item_ids"),
        F.array_min(F.transform("leaks", lambda x: x["distance"])).alias("least_distance"),
    )
