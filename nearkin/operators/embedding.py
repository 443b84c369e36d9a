"""Turning text into vectors through a caller-supplied embedding function.

An embedder is any picklable callable ``(list[str]) -> list of vectors``. It is
run in batches inside the tasks, on the chunk column alone; chunks are pooled
in the same place, so embedding adds no shuffle.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearkin.functions import text as X
from nearkin.sources.storage import (
    MAX_BROADCAST_KEYS,
    durable,
    read_or_empty,
    spread,
)

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]

MAX_TOKENS = 2048
BATCH_SIZE = 256
#: Bytes of text that are held as Python strings at a time, or one document.
PART_BYTES = 1 << 20
NO_TEXT = "nothing to embed: the text is blank"

CACHE_SCHEMA = (
    "text_sha1 string, embedding array<double>, error string, run string,"
    " model string, prefix string"
)
#: Characters of a text's hash that the cache is laid out by, sixteen parts for each.
PREFIX_CHARS = 1
EMBEDDED = "embedding array<double>, error string"

_LIST = pa.list_(pa.float64())


class HashedWords:
    """The built-in embedder: hashed word counts, scaled to unit length.

    Deterministic and free of any service, for tests and offline use.
    """

    MEMO = 1 << 16

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._bucket: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"dim": self.dim, "_bucket": {}}

    @property
    def model(self) -> str:
        return f"hashed-words-{self.dim}"

    def _buckets(self, words: list[str]) -> np.ndarray:
        """Bucket of each distinct word; a bounded number of them is remembered."""
        if len(self._bucket) > self.MEMO:
            self._bucket.clear()
        for word in words:
            if word not in self._bucket:
                digest = hashlib.md5(word.encode()).digest()
                self._bucket[word] = int.from_bytes(digest[:4], "big") % self.dim
        return np.array([self._bucket[w] for w in words], np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        split = [t.split() for t in texts]
        row = np.repeat(np.arange(len(texts)), [len(words) for words in split])
        flat = pa.array(list(chain.from_iterable(split)), pa.string()).dictionary_encode()
        bucket = self._buckets(flat.dictionary.to_pylist())
        cell = row * self.dim + bucket[flat.indices.to_numpy()]
        out = np.bincount(cell, minlength=len(texts) * self.dim).astype(float)
        out = out.reshape(len(texts), self.dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norms > 0, norms, 1.0)


def chunks_of(
    text: Column, max_tokens: int = MAX_TOKENS, unit: str = "word"
) -> Column:
    """Non-blank chunks of at most ``max_tokens`` words or characters.

    Characters suit scripts written without spaces. Chunks differ from those of
    a byte-pair tokenizer with the same limit, and never split a character.
    """
    if unit == "word":
        return X.chunk_words(X.clean_text(text), max_tokens)
    if unit == "char":
        return X.drop_blank(X.chunk_chars(text, max_tokens))
    raise ValueError(f"unit must be 'word' or 'char', not {unit!r}")


def _vectors(embedder: Embedder, texts: list[str]) -> list:
    """A vector for each text, or the exception that kept it from one.

    Where a batch fails its halves are tried, down to the texts that fail alone.
    """
    try:
        found = embedder(texts)
        if len(found) != len(texts):
            raise ValueError("the embedder returned another number of vectors")
        return list(found)
    except Exception as e:
        if len(texts) == 1:
            return [e]
        half = len(texts) // 2
        return _vectors(embedder, texts[:half]) + _vectors(embedder, texts[half:])


def _pool(
    embedder: Embedder, documents: list[list[str]], size: int
) -> list[np.ndarray | Exception]:
    """The mean chunk vector of each document, or what went wrong with a chunk."""
    flat = [c for chunks in documents for c in chunks]
    vectors: list = []
    for i in range(0, len(flat), size):
        vectors.extend(_vectors(embedder, flat[i : i + size]))
    out, at = [], 0
    for chunks in documents:
        mine = vectors[at : at + len(chunks)]
        failed = next((v for v in mine if isinstance(v, Exception)), None)
        out.append(failed or np.mean(np.asarray(mine, float), axis=0))
        at += len(chunks)
    return out


def _parts(chunks: pa.Array) -> Iterator[pa.Array]:
    """A batch of documents' chunks in parts of at most ``PART_BYTES``, or one document."""
    sizes = pc.fill_null(pc.binary_length(chunks.values), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])[chunks.offsets.to_numpy()]
    lo = 0
    while lo < len(chunks):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PART_BYTES, "right")) - 1)
        yield chunks.slice(lo, hi - lo)
        lo = hi


def pooled_embedding(
    chunks: Column, embedder: Embedder, batch_size: int = BATCH_SIZE
) -> Column:
    """``struct<embedding, error>``: mean vector of each row's chunks.

    A chunk that fails takes its own document with it and no other; what was
    embedded beside it is kept.
    """

    def embedded(part: pa.Array) -> pa.Array:
        documents = part.to_pylist()
        full = [i for i, d in enumerate(documents) if d]
        vectors: list = [None] * len(documents)
        errors: list = [None if d else NO_TEXT for d in documents]
        pooled = _pool(embedder, [documents[i] for i in full], batch_size)
        for i, v in zip(full, pooled, strict=True):
            if isinstance(v, Exception):
                errors[i] = f"embedding failed: {type(v).__name__}: {v}"
            else:
                vectors[i] = v
        return pa.StructArray.from_arrays(
            [pa.array(vectors, _LIST), pa.array(errors, pa.string())],
            names=["embedding", "error"],
        )

    @F.arrow_udf(EMBEDDED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in _parts(batch):
                yield embedded(part)

    # never evaluated twice, whatever filter is put on its result
    return run.asNondeterministic()(chunks)


def embed_texts(
    texts: DataFrame,
    embedder: Embedder,
    text_col: str = "text",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Short texts, one vector each. Blank texts drop out; rows keep their keys."""
    kept = texts.where(X.embed_input(F.col(text_col)) != "")
    whole = F.array(X.embed_input(F.col(text_col)))
    return _with_embedding(spread(kept), whole, embedder, batch_size)


def _with_embedding(df, chunks: Column, embedder, batch_size) -> DataFrame:
    out = df.withColumn("_e", pooled_embedding(chunks, embedder, batch_size))
    return out.select(*df.columns, "_e.embedding", "_e.error")


def embed_documents(
    documents: DataFrame,
    embedder: Embedder,
    *,
    text_col: str = "text",
    chunk: bool = True,
    max_tokens: int = MAX_TOKENS,
    unit: str = "word",
    batch_size: int = BATCH_SIZE,
    cache_path: str | None = None,
    model: str | None = None,
    spread_out: bool = True,
) -> DataFrame:
    """Add ``embedding`` and ``error`` to each document.

    ``chunk=False`` embeds the text whole, as for a query. With ``cache_path``
    each distinct text is embedded once ever: texts not in the cache are
    embedded and appended to it, then all documents join their entries; blank texts
    go around that. ``documents`` is read several times then, so write it first if
    it is costly. Without a cache every row is embedded where it is read, or after
    a small input was shared out over the cores; ``spread_out=False`` says that it
    already was.
    """
    text = X.embed_input(F.col(text_col))

    def chunks(t: Column) -> Column:
        if chunk:
            return chunks_of(t, max_tokens, unit)
        return F.when(t != "", F.array(t)).otherwise(F.array().cast("array<string>"))

    if cache_path is None:
        rows = spread(documents) if spread_out else documents
        return _with_embedding(rows, chunks(text), embedder, batch_size)

    model = model or getattr(embedder, "model", None)
    if not model:
        raise ValueError("a cache needs the model's name")
    with_text = F.coalesce(text, F.lit("")) != ""
    keyed = documents.where(with_text).withColumn("text_sha1", X.text_id(text))
    entries = _cached_entries(keyed, embedder, chunks(text), text_col, cache_path, model, batch_size)
    found = keyed.join(entries, "text_sha1", "left")
    blank = documents.where(~with_text).select(
        *documents.columns, F.lit(None).cast("array<double>"), F.lit(NO_TEXT)
    )
    return found.select(*documents.columns, "embedding", "error").union(blank)


def _cached_entries(
    keyed: DataFrame,
    embedder: Embedder,
    chunks: Column,
    text_col: str,
    cache_path: str,
    model: str,
    batch_size: int,
) -> DataFrame:
    """``text_sha1, embedding, error`` for each text of ``keyed``, once.

    Hashes alone tell what the cache lacks. Only texts that it lacks are carried
    along, each once, to be embedded and written to the cache, from where the result
    is read; there is no aggregate in it, so a join to it can split a hot text.
    """
    spark = keyed.sparkSession
    keys = Keys(keyed.select("text_sha1"))
    cache = keys.part_of(read_cache(spark, cache_path), model)
    found = keys.found_in(cache)
    good = _once(cache.where(F.col("error").isNull()), found)
    good = keys.join_few(good).select("text_sha1", "embedding", "error")
    if not found.missing:
        return good
    run = uuid.uuid4().hex
    lacking = found.table.where("n IS NULL").select("text_sha1")
    few = F.broadcast(lacking) if found.missing <= MAX_BROADCAST_KEYS else lacking
    wanted = keyed.select("text_sha1", text_col).join(few, "text_sha1", "left_semi")
    once = wanted.groupBy("text_sha1").agg(F.min(text_col).alias(text_col))
    new = _with_embedding(spread(once, after_shuffle=True), chunks, embedder, batch_size)
    put_cache(new.withColumns({"model": F.lit(model), "run": F.lit(run)}), cache_path)
    # what failed is kept as well until the cache is compacted, and only told to this run
    mine = keys.part_of(read_cache(spark, cache_path), model).where(F.col("run") == run)
    return good.union(mine.select("text_sha1", "embedding", "error"))


class Found:
    """Which keys a cache has: ``table`` has ``text_sha1, n``, n null where it has none."""

    def __init__(self, table: DataFrame):
        self.table = table
        size = table.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.max("n").alias("most"))
        row = size.first()
        self.missing: int = row.missing
        self.twice: bool = (row.most or 0) > 1


class Keys:
    """The different hashes of some texts, written, and what can be said of them."""

    def __init__(self, hashes: DataFrame):
        self.table = durable(hashes.distinct(), "keys")
        prefix = F.substring("text_sha1", 1, PREFIX_CHARS)
        size = self.table.agg(F.count("*").alias("n"), F.collect_set(prefix).alias("prefixes")).first()
        self.n: int = size.n
        self.prefixes: list[str] = sorted(size.prefixes)
        self.few = self.n <= MAX_BROADCAST_KEYS

    def part_of(self, cache: DataFrame, model: str) -> DataFrame:
        """The partitions of a cache that may have these keys."""
        mine = cache.where(F.col("model") == model)
        every = len(self.prefixes) == 16**PREFIX_CHARS
        return mine if every else mine.where(F.col("prefix").isin(self.prefixes))

    def found_in(self, cache: DataFrame) -> Found:
        """Which keys the cache has, and how often, from its column of hashes alone."""
        has = self.join_few(cache.where(F.col("error").isNull()).select("text_sha1"))
        has = has.groupBy("text_sha1").agg(F.count("*").alias("n"))
        return Found(durable(self.table.join(has, "text_sha1", "left"), "found"))

    def join_few(self, cache: DataFrame) -> DataFrame:
        """The entries of these keys, if they are few; otherwise a join will tell."""
        return cache.join(F.broadcast(self.table), "text_sha1", "left_semi") if self.few else cache


def _once(entries: DataFrame, found: Found) -> DataFrame:
    """One entry for each text; writers that raced may have stored one twice."""
    if not found.twice:
        return entries
    first = F.first("embedding").alias("embedding")
    error = F.lit(None).cast("string").alias("error")
    return durable(entries.groupBy("text_sha1").agg(first, error), "once")


def read_cache(spark, path: str) -> DataFrame:
    """The embedding cache; empty if nothing was written yet."""
    return read_or_empty(spark, path, CACHE_SCHEMA)


def put_cache(rows: DataFrame, path: str) -> None:
    """Append embeddings to the cache, which is laid out by model and start of the hash.

    Rows have ``text_sha1, model, embedding``, and may have an ``error`` instead of an
    embedding and the ``run`` they are of. Each task writes its own starts of hashes,
    so there is about one file for each.
    """
    missing = [c for c in ("error", "run") if c not in rows.columns]
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in missing})
    rows = rows.withColumn("prefix", F.substring("text_sha1", 1, PREFIX_CHARS))
    columns = rows.select("text_sha1", "embedding", "error", "run", "model", "prefix")
    columns = columns.repartition(16**PREFIX_CHARS, "model", "prefix")
    columns.write.mode("append").partitionBy("model", "prefix").parquet(path)


def compact_cache(spark, path: str) -> None:
    """Rewrite a cache with one entry for each text, in order, without failed ones.

    For a time when nobody writes or reads it. Each partition is replaced as a whole
    from a copy written before, which stays until ``storage.clear_scratch``.
    """
    cache = read_cache(spark, path).where(F.col("error").isNull())
    first = F.first("embedding").alias("embedding")
    once = durable(cache.groupBy("model", "prefix", "text_sha1").agg(first), "compacted")
    none = F.lit(None).cast("string")
    rows = once.select(
        "text_sha1", "embedding", none.alias("error"), none.alias("run"), "model", "prefix"
    )
    laid_out = rows.repartition(16**PREFIX_CHARS, "model", "prefix")
    sorted_rows = laid_out.sortWithinPartitions("model", "prefix", "text_sha1")
    writer = sorted_rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("model", "prefix").parquet(path)


def cache_lookup(keyed: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Left join on the text's hash: ``embedding`` is NULL on a miss."""
    keys = Keys(keyed.select("text_sha1"))
    mine = keys.part_of(cache, model)
    entries = _once(mine.where(F.col("error").isNull()), keys.found_in(mine))
    entries = keys.join_few(entries).select("text_sha1", "embedding")
    return keyed.join(entries, "text_sha1", "left")
