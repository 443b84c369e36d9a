"""A trie of conversations by truncation peeling.

Conversations are sequences of turns; every sequence of their first turns is a node.
Peeling starts at the greatest depth: the conversations that end there are the first
nodes, each then loses its last turn and meets, one level up, those that end there
and all others with the same turns left. Nodes are found and summed up on the way.

Texts never move: a turn travels as two hashes and a size, and a node is named by
128 bits, the running exclusive-or of its turns' hashes, each mixed with its place.
Equal conversations become one sequence with a count before anything is peeled.
Subtrees of at most ``PEEL_TURNS`` turns are peeled within a task, many at a time. A
node with more turns below it is *heavy*: its light children are peeled first, summed
up by Spark, and the heavy nodes alone, few as they are, are peeled last. So a first
turn that a third of all conversations share is no group of its own anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearkin.llm.common import batches_of, read
from nearkin.sources.storage import bounded_rows, durable

#: Turns of different sequences that a light subtree has at most.
PEEL_TURNS = 50_000
#: Heavy nodes that one task peels; more are peeled level by level.
TOP_NODES = 200_000
_ROOT = bytes(16)
_NO_ENDS = hashlib.sha256().hexdigest()

# Bytes of ids that a part of a sequence has.
_HELD_IDS = 1 << 20
_PARTS = "key binary, conv long, n long, depth int, keys binary, sizes binary, ends string, ids binary"
_PART_NAMES = [c.split()[0] for c in _PARTS.split(", ")]
_PART_TYPES = [
    pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.binary()
]
_STEPS = "key binary, node binary, parent binary, depth int, bytes long, below long, conv long, n long"
_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long,"
    " n_leaves long, saved_tokens long, ends_sha256 string, above binary"
)
_COLUMNS = [c.split()[0] for c in _NODES.split(",")][:-1]


def digest_turns(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """``(conv, turns)``: each conversation's turns in order, as ``(a, b, bytes)``.

    ``a`` and ``b`` are hashes of role and text, ``bytes`` the UTF-8 size of the text.
    Turns without a number come first; turns with the same number are in the order of
    their hashes, so repeated rows count. A missing role or text is an empty one. Rows
    without a conversation belong to none. The digests of one conversation are held
    together; its texts are not.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.struct(
            F.col(turn_col).isNotNull().alias("numbered"),
            F.col(turn_col).alias("turn"),
            F.xxhash64(F.lit(1), role, text).alias("a"),
            F.xxhash64(F.lit(2), role, text).alias("b"),
            F.octet_length(text).cast("long").alias("bytes"),
        ).alias("t"),
    ).where("conv IS NOT NULL")
    ordered = F.array_sort(F.collect_list("t"))
    digests = F.transform(ordered, lambda t: F.struct(t["a"], t["b"], t["bytes"]))
    digests = digests.cast("array<struct<a:long,b:long,bytes:long>>")
    return rows.groupBy("conv").agg(digests.alias("turns"))


def shared_openings(digests: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation with the first turns of the one its family is named after.

    Conversation c takes the first h turns of c - c % family, h being crc32 of its id
    modulo ``most``, and goes on with its own turns after its first h.
    """
    base = F.col("conv") - F.col("conv") % family
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    own = digests.select("conv", base.alias("base"), taken.cast("int").alias("h"), "turns")
    opening = digests.where(F.col("conv") % family == 0).select(
        F.col("conv").alias("base"), F.slice("turns", 1, most - 1).alias("opening")
    )
    none = F.array().cast(digests.schema["turns"].dataType)
    first = F.slice(F.coalesce("opening", none), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return own.join(opening, "base", "left").select("conv", F.concat(first, rest).alias("turns"))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For every turn a number for the sequence up to it; ``sizes`` turns a conversation."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(hashes)) - np.repeat(starts, sizes)
    running = np.bitwise_xor.accumulate(_mix(hashes ^ _mix(place.astype(np.uint64) + np.uint64(1))))
    before = np.where(starts > 0, running[np.minimum(starts, len(running)) - 1], np.uint64(0))
    return running ^ np.repeat(before, sizes)


def _pieces(flat: np.ndarray, sizes: np.ndarray, width: int, keep: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values; null where not kept."""
    data, ends = flat.tobytes(), np.cumsum(sizes) * width
    spans = zip((ends - sizes * width).tolist(), ends.tolist(), keep.tolist(), strict=True)
    return pa.array([data[s:e] if k else None for s, e, k in spans], pa.binary())


def _keys16(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 2)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, conv, depth, keys, sizes)``; of equal ones in a batch one has the path."""
    for batch in batches_of(batches):
        turns = batch["turns"]
        n = pc.list_value_length(turns).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = turns.flatten()
        a, b, size = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        keys = np.stack([prefix_keys(h.view(np.uint64), n) for h in (a, b)], axis=1)
        own, ends = np.zeros((len(n), 2), np.uint64), np.cumsum(n)
        own[n > 0] = keys[ends[n > 0] - 1]
        first = np.zeros(len(n), bool)
        first[np.unique(own, axis=0, return_index=True)[1]] = True
        yield pa.RecordBatch.from_arrays(
            [
                _pieces(own, np.ones(len(n), np.int64), 16, np.ones(len(n), bool)),
                batch["conv"],
                pa.array(n.astype(np.int32)),
                _pieces(keys, n, 16, first),
                _pieces(size.astype(np.int64), n, 8, first),
            ],
            names=["key", "conv", "depth", "keys", "sizes"],
        )


class _Sequence:
    """Conversations of one sequence, gathered in the order of their ids."""

    def __init__(self, key: bytes, conv: int, depth: int, known: bool):
        self.key, self.conv, self.depth, self.n = key, conv, depth, 0
        self.keys = self.sizes = None
        self.known = known  # whether all its conversations are here
        self.ids: list[bytes] = []
        self.held = 0

    def row(self, whole: bool) -> tuple:
        ids = b",".join(self.ids)
        ends, ids = (hashlib.sha256(ids).hexdigest(), None) if whole else (None, ids)
        return self.key, self.conv, self.n, self.depth, self.keys, self.sizes, ends, ids


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, t) for c, t in zip(columns, _PART_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=_PART_NAMES)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence, from rows sorted by key and conversation.

    A sequence that may go on in another task, the first and the last one here, and one
    of very many conversations keeps its ids, in parts, instead of their digest.
    """
    now: _Sequence | None = None
    for batch in batches_of(batches):
        done: list[tuple] = []
        columns = (batch[c].to_pylist() for c in ("key", "conv", "depth", "keys", "sizes"))
        for key, conv, depth, keys, sizes in zip(*columns, strict=True):
            if now is None or now.key != key or now.held > _HELD_IDS:
                if now is not None:
                    done.append(now.row(now.known and now.key != key))
                known = now is not None and now.key != key
                now = _Sequence(key, conv, depth, known)
            now.n += 1
            now.ids.append(b"%d" % conv)
            now.held += len(now.ids[-1]) + 1
            if now.keys is None and keys is not None:
                now.keys, now.sizes = keys, sizes
        if done:
            yield _as_batch(done)
    if now is not None:
        yield _as_batch([now.row(False)])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sequence from its parts, sorted by key and conversation."""
    now: list | None = None
    digest = hashlib.sha256()
    for batch in batches_of(batches):
        done: list[tuple] = []
        for part in batch.to_pylist():
            if now is not None and now[0] == part["key"]:
                now[2] += part["n"]
                digest.update(b",")
            else:
                if now is not None:
                    done.append((*now, digest.hexdigest(), None))
                now = [part["key"], part["conv"], 0, part["depth"], None, None]
                now[2], digest = part["n"], hashlib.sha256()
            digest.update(part["ids"])
            if now[4] is None:
                now[4:] = [part["keys"], part["sizes"]]
        if done:
            yield _as_batch(done)
    if now is not None:
        yield _as_batch([(*now, digest.hexdigest(), None)])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every node on the way of every sequence."""
    for batch in batches_of(batches):
        depth = batch["depth"].to_numpy().astype(np.int64)
        keys = _keys16(batch["keys"])
        place = np.arange(len(keys)) - np.repeat(np.cumsum(depth) - depth, depth)
        parent = np.zeros_like(keys)
        parent[place > 0] = keys[np.flatnonzero(place > 0) - 1]
        every, one = np.ones(len(keys), bool), np.ones(len(keys), np.int64)
        whose = pa.array(np.repeat(np.arange(len(depth)), depth))
        yield pa.RecordBatch.from_arrays(
            [
                batch["key"].take(whose),
                _pieces(keys, one, 16, every),
                _pieces(parent, one, 16, every),
                pa.array((place + 1).astype(np.int32)),
                pa.array(np.frombuffer(b"".join(batch["sizes"].to_pylist()), np.int64)),
                pa.array(np.repeat(depth, depth) - place),
                batch["conv"].take(whose),
                batch["n"].take(whose),
            ],
            names=[c.split()[0] for c in _STEPS.split(", ")],
        )


def _peel(group: pa.Table) -> pa.Table:
    """All nodes of some light subtrees, from the sequences that run through them.

    ``keys`` and ``sizes`` start at the top of the subtree, at depth ``cut``; ``above``
    and ``above_conv`` tell of the heavy node over it.
    """
    col = {c: group[c].combine_chunks() for c in group.column_names}
    end, cut, conv, n, above_conv = (
        col[c].to_numpy().astype(np.int64) for c in ("depth", "cut", "conv", "n", "above_conv")
    )
    keys = _keys16(col["keys"])
    sizes = np.frombuffer(b"".join(col["sizes"].to_pylist()), np.int64)
    length = end - cut + 1
    at = np.cumsum(length) - length - cut
    by_end = np.argsort(-end, kind="stable")
    found: list[list[np.ndarray]] = []
    # survivors: a sequence that runs through the node, and what is summed up so far
    rep = np.empty(0, np.int64)
    sums = np.empty((0, 6), np.int64)  # conv, n, children, leaves, saved, ends
    taken = 0
    for d in range(int(end.max()), int(cut.min()) - 1, -1):
        more = taken
        while more < len(by_end) and end[by_end[more]] == d:
            more += 1
        new = by_end[taken:more]
        taken = more
        if not len(rep) and not len(new):
            continue
        zero = np.zeros(len(new), np.int64)
        started = np.stack([conv[new], n[new], zero, zero, zero, new], axis=1)
        lifted = sums.copy()
        lifted[:, 2], lifted[:, 5] = 1, -1
        who = np.concatenate([rep, new])
        rows = np.concatenate([lifted, started])
        key = keys[at[who] + d]
        order = np.lexsort((key[:, 1], key[:, 0]))
        key = key[order]
        head = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
        lo = np.flatnonzero(head)
        rows, who = rows[order], who[order]
        now = np.empty((len(lo), 6), np.int64)
        now[:, 0] = np.minimum.reduceat(rows[:, 0], lo)
        now[:, 1:5] = np.add.reduceat(rows[:, 1:5], lo, axis=0)
        now[:, 5] = np.maximum.reduceat(rows[:, 5], lo)
        now[now[:, 2] == 0, 3] = 1
        now[:, 4] += (now[:, 1] - 1) * sizes[at[who[lo]] + d]
        if len(rep):
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(head) - 1
            found.append([rep, sums, np.full(len(rep), d + 1), now[place[: len(rep)], 0]])
        rep, sums = who[lo], now
        top = cut[rep] == d
        if top.any():
            found.append([rep[top], sums[top], np.full(int(top.sum()), -d), above_conv[rep[top]]])
            rep, sums = rep[~top], sums[~top]
    rep, depth, parent = (np.concatenate([f[i] for f in found]) for i in (0, 2, 3))
    sums = np.concatenate([f[1] for f in found])
    ends, none = col["ends"], pa.scalar(_NO_ENDS)
    ended = sums[:, 5] >= 0
    told = pc.if_else(pa.array(ended), ends.take(pa.array(np.maximum(sums[:, 5], 0))), none)
    above = col["above"].take(pa.array(rep))
    above = pc.if_else(pa.array(depth < 0), above, pa.scalar(None, pa.binary()))
    numbers = [sums[:, 0], np.abs(depth), parent, sums[:, 1], sums[:, 2], sums[:, 3], sums[:, 4]]
    arrays = [*(pa.array(x) for x in numbers), told, above]
    return pa.table(arrays, names=[*_COLUMNS, "above"])


_TOP = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _peel_top(group: pa.Table) -> pa.Table:
    """All heavy nodes, when one task can hold them."""
    rows = sorted(group.to_pylist(), key=lambda r: -r["depth"])
    below: dict[bytes, list[int]] = {}
    out = []
    for r in rows:
        got = below.pop(r["node"], [0, 0, 0, 0])
        n, children, leaves, saved = (
            got[i] + r[c] for i, c in enumerate(("n", "children", "leaves", "saved"))
        )
        leaves = leaves if children else 1
        saved += (n - 1) * r["bytes"]
        if r["parent"] is not None:
            up = below.setdefault(r["parent"], [0, 0, 0, 0])
            for i, v in enumerate((n, 1, leaves, saved)):
                up[i] += v
        out.append((r["conv"], r["depth"], r["parent_conv"], n, children, leaves, saved, r["ends"]))
    columns = list(zip(*out, strict=True))
    types = [*(pa.int64() for _ in range(7)), pa.string()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_COLUMNS)


def _peel_levels(top: DataFrame) -> DataFrame:
    """All heavy nodes, one level of the trie after the other."""
    deepest = top.agg(F.max("depth")).first()[0]
    levels, up = None, None
    for d in range(deepest, -1, -1):
        level = top.where(F.col("depth") == d)
        if up is not None:
            level = level.join(up, level["node"] == up["of"], "left")
            for c in ("n", "children", "leaves", "saved"):
                level = level.withColumn(c, F.col(c) + F.coalesce(f"up_{c}", F.lit(0)))
        level = level.withColumns(
            {
                "leaves": F.when(F.col("children") > 0, F.col("leaves")).otherwise(1),
                "saved": F.col("saved") + (F.col("n") - 1) * F.col("bytes"),
            }
        )
        level = durable(level.select(top.columns), "trie_level")
        up = level.groupBy(F.col("parent").alias("of")).agg(
            F.sum("n").alias("up_n"),
            F.count("*").alias("up_children"),
            F.sum("leaves").alias("up_leaves"),
            F.sum("saved").alias("up_saved"),
        )
        levels = level if levels is None else levels.union(level)
    return levels.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long"),
        F.col("parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").cast("long").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    )


def conversation_trie(
    digests: DataFrame, *, peel_turns: int = PEEL_TURNS, top_nodes: int = TOP_NODES
) -> DataFrame:
    """One row for each node of the trie of conversations ``(conv, turns)``.

    ``digests`` is as from ``digest_turns``, with one row a conversation. Rows are
    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256)``: the smallest conversation that starts with the node's turns, how
    many turns these are, the parent's ``conv_id`` (null for the root), how many
    conversations start so, children, nodes without children in the subtree, the bytes
    a cache of prefixes saves there (last text times conversations beyond the first),
    and the SHA-256 of the ids that end at the node. A conversation without turns
    ends at the root; without conversations there is no root.
    """
    paths = digests.select("conv", "turns").mapInArrow(
        _paths, "key binary, conv long, depth int, keys binary, sizes binary"
    )
    paths = durable(paths, "trie_paths")
    in_order = paths.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    parts = durable(in_order.mapInArrow(_gather, _PARTS), "trie_parts")
    split = parts.where("ends IS NULL").repartition("key").sortWithinPartitions("key", "conv")
    sequences = parts.where("ends IS NOT NULL").union(split.mapInArrow(_merge, _PARTS))
    sequences = durable(sequences.drop("ids"), "trie_sequences")
    size = sequences.agg(F.sum("depth").alias("turns"), F.min("conv").alias("conv")).first()
    turns, first = size.turns or 0, F.lit(size.conv).cast("long")

    root = sequences.sparkSession.range(1).where(first.isNotNull()).select(
        F.lit(_ROOT).alias("node"),
        F.lit(None).cast("binary").alias("parent"),
        F.lit(0).alias("depth"),
        F.lit(0).cast("long").alias("bytes"),
        first.alias("conv"),
    )
    with_cut = sequences.select("*", F.lit(1).alias("cut"), first.alias("above_conv"))
    heavy = root
    if turns > peel_turns:
        steps = sequences.mapInArrow(_steps, _STEPS)
        counted = steps.groupBy("node").agg(
            F.first("parent").alias("parent"),
            F.first("depth").alias("depth"),
            F.first("bytes").alias("bytes"),
            F.min("conv").alias("conv"),
            F.count("*").alias("sequences"),
            F.sum("below").alias("below"),
        )
        counted = counted.where((F.col("sequences") > 1) & (F.col("below") > peel_turns))
        heavy = durable(counted.select(root.columns).unionByName(root), "trie_heavy")
        named = heavy.select("node", F.col("conv").alias("above_conv"))
        last = F.max(F.struct("depth", "above_conv")).alias("last")
        cuts = steps.select("key", "node", "depth").join(named, "node").groupBy("key").agg(last)
        with_cut = with_cut.join(durable(cuts, "trie_cuts"), "key", "left").select(
            *sequences.columns,
            (F.coalesce("last.depth", F.lit(0)) + 1).alias("cut"),
            F.coalesce("last.above_conv", "above_conv").alias("above_conv"),
        )

    over = F.when(F.col("cut") > 1, F.expr("substring(keys, 16 * cut - 31, 16)"))
    light = with_cut.where("cut <= depth").select(
        "conv",
        "n",
        "depth",
        "cut",
        "ends",
        "above_conv",
        F.coalesce(over, F.lit(_ROOT)).alias("above"),
        F.expr("substring(keys, 16 * cut - 15)").alias("keys"),
        F.expr("substring(sizes, 8 * cut - 7)").alias("sizes"),
    )
    bins = -(-turns // peel_turns) or 1
    which = F.pmod(F.xxhash64(F.substring("keys", 1, 16)), F.lit(bins)).alias("bin")
    peeled = light.select("*", which).groupBy("bin").applyInArrow(_peel, _NODES)
    nodes = durable(peeled, "trie_nodes")

    ended = with_cut.where("cut > depth").select(
        F.col("key").alias("node"),
        "n",
        F.lit(0).alias("children"),
        F.lit(0).alias("leaves"),
        F.lit(0).alias("saved"),
        "ends",
    )
    tops = nodes.where("above IS NOT NULL").select(
        F.col("above").alias("node"),
        F.col("n_convs").alias("n"),
        F.lit(1).alias("children"),
        F.col("n_leaves").alias("leaves"),
        F.col("saved_tokens").alias("saved"),
        F.lit(None).cast("string").alias("ends"),
    )
    given = tops.union(ended).groupBy("node").agg(
        F.sum("n").alias("n"),
        F.sum("children").alias("children"),
        F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"),
        F.max("ends").alias("ends"),
    )
    parents = heavy.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    none = F.lit(0).cast("long")
    top = heavy.join(given, "node", "left").join(parents, "parent", "left").select(
        "node",
        "parent",
        "depth",
        "bytes",
        "conv",
        "parent_conv",
        *(F.coalesce(c, none).alias(c) for c in ("n", "children", "leaves", "saved")),
        F.coalesce("ends", F.lit(_NO_ENDS)).alias("ends"),
        F.lit(0).alias("whole"),
    )
    top = durable(top, "trie_top")
    if bounded_rows(top, top_nodes) is None:
        upper = _peel_levels(top)
    else:
        upper = top.groupBy("whole").applyInArrow(_peel_top, _TOP)
    return nodes.select(_COLUMNS).unionByName(upper)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = durable(digest_turns(read(spark, sf_dir, "conversations")), "turn_digests")
    return conversation_trie(shared_openings(digests))


# crc32 of the id's digits, bit by bit; 3988292384 is its reversed polynomial.
OP13_SQL = """
WITH turns AS (
    SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT c, c - c % 5 AS base, xor(list_reduce(
        list_prepend(4294967295::BIGINT,
            list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
        lambda z, s: list_reduce(
            [xor(z, s), 0, 0, 0, 0, 0, 0, 0, 0],
            lambda y, _: xor(y >> 1, 3988292384::BIGINT * (y & 1)))
    ), 4294967295::BIGINT) % 9 AS h
    FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
    SELECT ids.c, i, r, x FROM ids JOIN turns ON turns.c = base WHERE i < h
    UNION ALL
    SELECT ids.c, i, r, x FROM ids JOIN turns USING (c) WHERE i >= h
), paths AS (
    SELECT c, coalesce(list({'r': r, 'x': x} ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS p
    FROM ids LEFT JOIN rebuilt USING (c) GROUP BY c
), nodes AS (
    SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, any_value(strlen(k[d].x)) AS bytes
    FROM (SELECT c, d, p[:d] AS k FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM paths))
    GROUP BY k, d
), kids AS (
    SELECT k[:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), counted AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)
), below AS (
    SELECT k[:a] AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
        sum((n_convs - 1) * coalesce(bytes, 0)) AS saved
    FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY 1
), ends AS (
    SELECT p AS k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM paths GROUP BY p
)
SELECT counted.conv_id, counted.d::BIGINT AS depth, up.conv_id AS parent_conv_id,
    counted.n_convs::BIGINT AS n_convs, counted.n_children::BIGINT AS n_children,
    n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
    coalesce(ends, sha256('')) AS ends_sha256
FROM counted JOIN below USING (k) LEFT JOIN ends USING (k)
LEFT JOIN nodes AS up ON counted.d > 0 AND up.k = counted.k[:counted.d - 1]
"""
