"""SentencePiece encoding and decoding by suffix-array matching.

The different stretches of a batch's texts are laid end to end and indexed by a
suffix array. Every piece of the vocabulary is looked up by binary search, which
gives the range of its occurrences; each occurrence is an edge from one position
to a later one. Edges are sorted by position and relaxed from left to right. The
model merges pairs by rank, and for such a model each position has exactly one
last piece that belongs to the encoding of what lies before it: an edge is taken
if its piece and the one before it stay apart when merged together. That test
needs only the ranks and the last merges inside both pieces.

A piece may begin with blanks, never hold one after another character, so texts
are cut in front of blanks and a stretch is encoded once for all its copies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from nearkin.llm.common import (
    IdStore,
    as_bytes,
    batches_of,
    read,
    release_memory,
    task_cache,
    text_slices,
)

BLANK = "▁"
_NONE = np.int64(1 << 40)
#: Characters of new stretches that are indexed at a time.
_INDEX_CHARS = 400_000
#: Bytes of text that are encoded at a time.
_SLICE_BYTES = 4 << 20
#: Texts that are decoded at a time.
_DECODED = 1_000
#: Stretches whose ids a worker remembers.
_MEMO = 300_000


@dataclass
class PieceModel:
    """A byte-fallback merge model as arrays; symbols are pieces and odd characters.

    ``rank`` orders merges, -1 for single characters. ``left`` and ``right`` are the
    parts of a symbol's last merge, itself where there is none. ``merges`` lists the
    mergeable pairs as ``left * size + right``, sorted, with what they become.
    """

    pieces: list[str]
    byte_ids: list[int]
    text_of: list[bytes]
    size: int
    char_ids: dict[str, int]
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merges: np.ndarray
    merged: np.ndarray
    searched: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray
    cuts: np.ndarray

    @classmethod
    def load(cls, path: str) -> PieceModel:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        byte_ids, plain, text_of = [0] * 256, {}, []
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                text_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i):
                text_of.append(b"")
            elif model.is_unknown(i):
                text_of.append(" ⁇ ".encode())
            else:
                text_of.append(piece.replace(BLANK, " ").encode())
                if not model.is_unused(i):
                    plain[piece] = i
        by_score = sorted(
            (p for p in plain if len(p) > 1), key=lambda p: (-model.get_score(plain[p]), plain[p])
        )
        # pieces hold characters that may have no piece of their own
        symbols = dict(plain)
        for char in sorted({c for p in plain for c in p}):
            symbols.setdefault(char, n + 1 + len(symbols) - len(plain))
        size = max(symbols.values(), default=n) + 1
        size = max(size, n + 1)
        rank = np.full(size, -1, np.int64)
        for r, piece in enumerate(by_score):
            rank[plain[piece]] = r
        left, right = np.arange(size), np.arange(size)
        pairs = {}
        for piece in by_score:
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = plain[piece]
        reached = {c: i for c, i in symbols.items() if len(c) == 1 and c in plain}
        for piece in by_score:
            parts = _merge(piece, symbols, pairs, rank, size)
            if parts is not None:
                left[plain[piece]], right[plain[piece]] = parts
                reached[piece] = plain[piece]
        grown = np.array([i for p, i in reached.items() if len(p) > 1], np.int64)
        if (rank[left[grown]] >= rank[grown]).any() or (rank[right[grown]] >= rank[grown]).any():
            raise ValueError("a piece is made from parts that are merged after it")
        codes = sorted(pairs)
        names = sorted(reached)
        width = max((len(p) for p in names), default=1)
        table = np.zeros((len(names), width), np.int64)
        for i, piece in enumerate(names):
            table[i, : len(piece)] = [ord(c) + 1 for c in piece]
        return cls(
            pieces,
            byte_ids,
            text_of,
            size,
            {c: i for c, i in symbols.items() if len(c) == 1},
            rank,
            left,
            right,
            np.array(codes, np.int64),
            np.array([pairs[c] for c in codes], np.int64),
            np.array([reached[p] for p in names], np.int64),
            table,
            np.array([len(p) for p in names], np.int64),
            _cuts(by_score),
        )

    # -- matching ------------------------------------------------------------

    def edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and symbol of all occurrences of pieces in ``text``.

        ``text`` holds code points plus one; zero parts stretches.
        """
        n, width = len(text), self.codes.shape[1]
        padded = np.concatenate([text, np.zeros(width, np.int64)])
        # pieces are short, so the order of the suffixes' first characters is enough
        rank = np.unique(padded, return_inverse=True)[1].astype(np.int64)
        bits = max(1, int(rank.max(initial=0)).bit_length())
        packed, keys = 63 // bits, []
        for first in range(0, width, packed):
            key = np.zeros(n, np.int64)
            for i in range(first, min(first + packed, width)):
                key = (key << bits) | rank[i : i + n]
            keys.append(key)
        suffixes = np.lexsort(keys[::-1])
        low = self._bound(padded, suffixes, before=True)
        high = self._bound(padded, suffixes, before=False)
        times = high - low
        which = np.repeat(np.arange(len(times)), times)
        at = np.repeat(low - (np.cumsum(times) - times), times) + np.arange(times.sum())
        which = which.astype(np.int32)
        return suffixes.astype(np.int32)[at], self.lengths.astype(np.int32)[which], self.searched.astype(np.int32)[which]

    def _bound(self, padded: np.ndarray, suffixes: np.ndarray, *, before: bool) -> np.ndarray:
        """For each piece, how many suffixes are below all (or all but) its occurrences."""
        low = np.zeros(len(self.codes), np.int64)
        high = np.full(len(self.codes), len(suffixes), np.int64)
        places = np.arange(self.codes.shape[1])
        inside = places[None, :] < self.lengths[:, None]
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            window = padded[suffixes[mid][:, None] + places[None, :]]
            apart = (window - self.codes[open_]) * inside[open_]
            first = (apart != 0).argmax(axis=1)
            sign = np.sign(apart[np.arange(len(open_)), first])
            below = sign < 0 if before else sign <= 0
            low[open_[below]] = mid[below] + 1
            high[open_[~below]] = mid[~below]
        return low

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether symbols a and b, side by side, stay as they are.

        Goes back in time: what was merged last on either side of the border is
        undone first. Two symbols that meet at the border while both exist would
        have been merged if that merge ranks before the next on either side, or
        equal to the one to its right.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        a, b = a.copy(), b.copy()
        until_a, until_b = np.full(len(a), _NONE), np.full(len(a), _NONE)
        while len(at):
            code = a * self.size + b
            k = np.minimum(np.searchsorted(self.merges, code), len(self.merges) - 1)
            hit = self.merges[k] == code
            r = np.where(hit, self.rank[self.merged[k]], _NONE)
            broken = hit & (r < until_a) & (r <= until_b)
            ok[at[broken]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~broken & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            until_a, until_b = until_a[go], until_b[go]
            undo_a = ra > rb
            until_a = np.where(undo_a, ra, until_a)
            until_b = np.where(undo_a, until_b, rb)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return ok

    def encode_stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches in a row, and how many each has."""
        sizes = np.array([len(s) for s in stretches], np.int64)
        joined = "\x00".join(stretches) + "\x00"
        text = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        text[starts + sizes] = 0
        offset = np.arange(len(text)) - np.repeat(starts, sizes + 1)
        edge_at, edge_len, edge_symbol = self.edges(text)
        odd = self._odd_characters(text)
        edge_at = np.concatenate([edge_at, odd.astype(np.int32)])
        edge_len = np.concatenate([edge_len, np.ones(len(odd), np.int32)])
        edge_symbol = np.concatenate([edge_symbol, self._odd_symbols(text[odd])])
        place = offset[edge_at]
        short = sizes.max(initial=0) < 1 << 16
        order = np.argsort(place.astype(np.uint16) if short else place, kind="stable")
        edge_at, edge_len, edge_symbol = edge_at[order], edge_len[order], edge_symbol[order]
        steps = np.searchsorted(place[order], np.arange(sizes.max(initial=0) + 1))
        last = np.full(len(text), -1, np.int64)
        length = np.zeros(len(text), np.int64)
        for step, (i, j) in enumerate(zip(steps, steps[1:], strict=False)):
            at, symbol, long = edge_at[i:j], edge_symbol[i:j], edge_len[i:j]
            if step:
                before = last[at]
                known = before >= 0
                at, symbol, long, before = at[known], symbol[known], long[known], before[known]
                codes, inverse = np.unique(before * self.size + symbol, return_inverse=True)
                taken = self.apart(codes // self.size, codes % self.size)[inverse]
                at, symbol, long = at[taken], symbol[taken], long[taken]
            last[at + long], length[at + long] = symbol, long
        return self._read_back(text, starts, sizes, last, length)

    def _odd_characters(self, text: np.ndarray) -> np.ndarray:
        """Places of characters that are no piece by themselves."""
        found, inverse = np.unique(text, return_inverse=True)
        n = len(self.pieces)
        odd = [c != 0 and self.char_ids.get(chr(c - 1), n) >= n for c in found.tolist()]
        return np.flatnonzero(np.array(odd, bool)[inverse])

    def _odd_symbols(self, codes: np.ndarray) -> np.ndarray:
        n = len(self.pieces)
        return np.array([self.char_ids.get(chr(c - 1), n) for c in codes.tolist()], np.int32)

    def _read_back(self, text, starts, sizes, last, length) -> tuple[np.ndarray, np.ndarray]:
        """Follows the edges taken from the end of each stretch to its start."""
        at = starts + sizes
        active = np.flatnonzero(sizes)
        columns, owners, places = [], [], []
        while len(active):
            columns.append(last[at[active]])
            owners.append(active)
            at[active] -= length[at[active]]
            places.append(at[active])
            active = active[at[active] > starts[active]]
        counts = np.bincount(np.concatenate(owners), minlength=len(starts)) if owners else sizes * 0
        ends = np.cumsum(counts)
        symbols = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
        where = np.empty_like(symbols)
        for back, (column, owner, place) in enumerate(zip(columns, owners, places, strict=True)):
            symbols[ends[owner] - 1 - back] = column
            where[ends[owner] - 1 - back] = place
        odd = np.flatnonzero(symbols >= len(self.pieces))
        if not len(odd):
            return symbols, counts
        spelled = [chr(c - 1).encode("utf-8", "surrogatepass") for c in text[where[odd]].tolist()]
        times = np.ones(len(symbols), np.int64)
        times[odd] = [len(b) for b in spelled]
        first = np.cumsum(times) - times
        ids = np.repeat(symbols, times)
        for i, b in zip(first[odd].tolist(), spelled, strict=True):
            ids[i : i + len(b)] = [self.byte_ids[x] for x in b]
        owner = np.repeat(np.arange(len(counts)), counts)
        return ids, np.bincount(owner, weights=times, minlength=len(counts)).astype(np.int64)

    # -- texts -----------------------------------------------------------------

    def encode(self, texts: list[bytes], store: IdStore) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; ``store`` is kept up."""
        blank = BLANK.encode()
        spaced = [b" " + t.replace(blank, b" ") if t else t for t in texts]
        x = np.frombuffer(b"".join(spaced), np.uint8)
        begin = self.cuts[(x[:-1].astype(np.int64) << 8) | x[1:]]
        begin = np.concatenate([np.ones(min(1, len(x)), bool), begin])
        sizes = np.array([len(t) for t in spaced], np.int64)
        first = np.cumsum(sizes) - sizes
        begin[first[sizes > 0]] = True
        starts = np.flatnonzero(begin)
        offsets = np.concatenate([starts, [len(x)]]).astype(np.int32)
        stretches = pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(x)]
        ).dictionary_encode()
        known = stretches.dictionary.to_pylist()
        block, size = [], 0
        for s in [*store.unknown(set(known)), None]:
            if s is None or (block and size + len(s) > _INDEX_CHARS):
                if block:
                    plain = [b.decode().replace(" ", BLANK) for b in block]
                    store.add(block, *self.encode_stretches(plain))
                block, size = [], 0
            if s is not None:
                block.append(s)
                size += len(s) + 1
        code = np.array([store.code[s] for s in known], np.int64)
        per_text = np.diff(np.searchsorted(starts, np.concatenate([first, [len(x)]])))
        found = store.gather(code[stretches.indices.to_numpy()], per_text)
        store.trim()
        return found

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of ids in a row: the blank in front goes, broken bytes are replaced."""
        length = np.array([len(t) for t in self.text_of], np.int64)
        table = np.frombuffer(b"".join(self.text_of), np.uint8)
        each = length[ids]
        ends = np.cumsum(each)
        at = np.repeat((np.cumsum(length) - length)[ids] - (ends - each), each)
        at += np.arange(len(at))
        data = table[at].tobytes()
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [
            data[a:b].decode("utf-8", "replace").removeprefix(" ")
            for a, b in zip(bounds, bounds[1:], strict=False)
        ]


def _cuts(pieces: list[str]) -> np.ndarray:
    """For two neighbouring bytes, whether a text can be cut between them.

    Bytes of characters beyond ASCII are not told apart, which leaves some of
    their places uncut.
    """
    together = np.zeros((256, 256), bool)
    together[128:, 128:] = True
    for piece in pieces:
        spelled = piece.replace(BLANK, " ")
        for a, b in zip(spelled, spelled[1:], strict=False):
            rows = slice(128, 256) if a > "\x7f" else ord(a)
            columns = slice(128, 256) if b > "\x7f" else ord(b)
            together[rows, columns] = True
    return ~together.ravel()


def _merge(piece, symbols, pairs, rank, size) -> tuple[int, int] | None:
    """Parts of the last merge that makes ``piece``, or nothing if none makes it."""
    parts, cut = [symbols[c] for c in piece], None
    while len(parts) > 1:
        best = None
        for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)):
            became = pairs.get(a * size + b)
            if became is not None and (best is None or rank[became] < best[0]):
                best = (rank[became], i, became)
        if best is None:
            return None
        i = best[1]
        cut = (parts[i], parts[i + 1])
        parts[i : i + 2] = [best[2]]
    return cut


_OUTPUTS = {
    "ids": pa.list_(pa.int32()),
    "n_tokens": pa.int64(),
    "ids_crc32": pa.int64(),
    "decoded": pa.string(),
    "round_trip": pa.bool_(),
}


def _output(name: str, texts: list[bytes], ids: np.ndarray, ends: np.ndarray, model) -> pa.Array:
    if name == "ids":
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
    if name == "n_tokens":
        return pa.array(np.diff(ends))
    if name == "ids_crc32":
        flat = ids.astype("<u4")
        parts = zip(ends.tolist(), ends[1:].tolist(), strict=False)
        return pa.array([zlib.crc32(flat[a:b].tobytes()) for a, b in parts], pa.int64())
    decoded = model.decode(ids, np.diff(ends))
    if name == "decoded":
        return pa.array(decoded, pa.string())
    return pa.array([d.encode() == t for d, t in zip(decoded, texts, strict=True)], pa.bool_())


def encode_pieces(
    docs: DataFrame,
    path: str,
    *,
    text_col: str = "text",
    keep: list[str] | None = None,
    outputs: tuple[str, ...] = ("ids",),
) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all) and ``outputs`` of the text by the model at ``path``.

    ``ids`` are the token ids, ``n_tokens`` their number, ``ids_crc32`` the crc of them
    as little-endian 32-bit integers, ``decoded`` their text and ``round_trip`` whether
    that is the text given, all worked out in one pass. No marks of beginning or end
    are added. Null and empty texts have no ids; characters the model doesn't know
    become the ids of their bytes. Columns of ``docs`` with such names are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(PieceModel.load(path))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in outputs]
    kinds = [_OUTPUTS[name] for name in outputs]
    schema = T.StructType([docs.schema[c] for c in kept])
    for name, kind in zip(outputs, kinds, strict=True):
        schema.add(name, from_arrow_type(kind))
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text_col).alias("text"))
    if text_col in kept:  # sent once
        rows = docs.select(F.struct(*kept).alias("row"))
    at = kept.index(text_col) if text_col in kept else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()  # what tasks of other kinds left in this worker
        model, store = sent.value, task_cache().setdefault(path, IdStore(_MEMO))
        for whole in batches_of(batches):
            row = whole["row"]
            texts = whole["text"] if at is None else row.field(at)
            columns = dict(zip([str(i) for i in range(len(kept))], row.flatten(), strict=True))
            table = pa.RecordBatch.from_pydict({**columns, "text": texts})
            for batch in text_slices(table, "text", _SLICE_BYTES):
                data = as_bytes(batch["text"])
                ids, sizes = model.encode(data, store)
                ids, ends = ids.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])
                found = [_output(name, data, ids, ends, model) for name in outputs]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], *found], names=[*kept, *outputs]
                )

    return rows.mapInArrow(run, schema)


def decode_pieces(
    encoded: DataFrame, path: str, *, ids_col: str = "ids", text_col: str = "text"
) -> DataFrame:
    """All columns and ``text_col``, the text of the ids; null ids have a null text."""
    sent = encoded.sparkSession.sparkContext.broadcast(PieceModel.load(path))
    encoded = encoded.drop(text_col)
    schema = encoded.withColumn(text_col, F.lit("").cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches_of(batches):
            for lo in range(0, whole.num_rows, _DECODED):
                batch = whole.slice(lo, _DECODED)
                column = batch[ids_col]
                sizes = pc.fill_null(pc.list_value_length(column), 0)
                sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64)
                texts = model.decode(column.flatten().to_numpy(zero_copy_only=False), sizes)
                texts = pa.array(texts, pa.string(), mask=column.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return encoded.mapInArrow(run, schema)


def model_path() -> str:
    """The installed public merge model with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_piece_suffix_arrays(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodes every text, decodes the ids, and tells both by count, crc and equality."""
    path = path or model_path()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    outputs = ("n_tokens", "ids_crc32", "round_trip")
    return encode_pieces(docs, path or model_path(), keep=["doc_id"], outputs=outputs)
