"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

The 64 bits of a fingerprint fall into four blocks. Two fingerprints that differ
in at most two bits have at least two blocks alike, so each fingerprint is listed
under its six pairs of blocks, lists are joined on them, and the Hamming distance
of each pair that meets is checked. Only different fingerprints take part: copies
are one row there, however many they are. A fingerprint has at most 2,080 others
within two bits, so what the join hands on grows with the fingerprints and not
with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm.common import as_bytes, batches_of, read, unused
from nearkin.llm.components import connected_components
from nearkin.sources.storage import durable

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
BLOCKS = 4

# Shingles whose bits are added up at a time.
_STEP = 32_768


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """Majority of each bit over the hashes of all word shingles of a text.

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer
    words than a shingle is one shingle, one without words has fingerprint zero.
    """
    words = text.lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0
    w = min(words_per_shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words])
    starts = np.concatenate([[0], ends[:-w]]).tolist()
    stops = (ends[w - 1 :] - 1).tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _STEP):
        spans = zip(starts[i : i + _STEP], stops[i : i + _STEP], strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    over_half = np.packbits(2 * ones > n, bitorder="little")
    return int(over_half.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` for each row; a null text counts as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            fp = np.array([fingerprint(t) for t in as_bytes(batch["t"])], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(fp.view(np.int64))], names=["id", "fp"]
            )

    kept = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    return kept.mapInArrow(run, "id long, fp long")


def _block_keys(fp: Column) -> Column:
    """The six pairs of blocks of a fingerprint, each with its place."""
    width = 64 // BLOCKS
    block = [
        F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1))
        for i in range(BLOCKS)
    ]
    pairs = combinations(range(BLOCKS), BLOCKS - MAX_BITS)
    keys = [
        F.lit(n << (2 * width)).bitwiseOR(F.shiftleft(block[i], width)).bitwiseOR(block[j])
        for n, (i, j) in enumerate(pairs)
    ]
    return F.explode(F.array(*keys))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Pairs of different fingerprints ``(a, b)`` within ``MAX_BITS`` bits, ``a < b``.

    ``distinct`` has each fingerprint once, as ``fp``. A pair comes once for each
    pair of blocks that it shares.
    """
    left = distinct.select(F.col("fp").alias("a"), _block_keys(F.col("fp")).alias("key"))
    right = left.select(F.col("a").alias("b"), "key")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return left.join(right, "key").where((F.col("a") < F.col("b")) & close).select("a", "b")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, fp, component_id)``, one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable over links of fingerprints.
    Null texts count as empty ones, which share fingerprint zero. Rows with equal
    ids each keep a row; a null id stays null and never names a component unless
    all its ids are null. Other columns are not read.
    """
    prints = durable(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = durable(prints.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    nodes = connected_components(fingerprint_links(distinct))
    nodes = durable(nodes.join(distinct, F.col("node") == F.col("fp")), "nodes")
    lowest = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    linked = nodes.join(lowest, "root").select("fp", "component_id")
    alone = distinct.join(nodes, "fp", "left_anti").select("fp", F.col("first"))
    component = durable(linked.union(alone), "components")
    found = prints.join(component, "fp")
    return found.select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group.

    Of rows that share that id one stays for each, so ids should be unique; rows
    without an id stay only where no row of the group has one.
    """
    groups = simhash_groups(docs, id_col, text_col)
    kept = groups.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    name = unused(docs, "kept")
    kept = kept.select(F.col(id_col).alias(name)).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col(name)), "left_semi")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(read(spark, sf_dir, "documents"))
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return groups.select("doc_id", hexadecimal.alias("fingerprint"), "component_id")

