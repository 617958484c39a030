"""SentencePiece encoding and decoding by matching all pieces against a suffix array of the batch.

A batch's texts are cut into units that no merge can cross (a run of spaces with what follows up
to the next space; line breaks and tabs alone, as long as no piece holds them), and each distinct
unit is kept once.  Then

1. all suffixes of the concatenated units are sorted (by their first eight bytes, so this is a suffix
   array to that depth; the rest of longer pieces is compared after the search),
2. each piece's occurrences are a range of the suffix array, found by binary search for all pieces
   at once,
3. the occurrences become edges (position, length, piece), sorted by position,
4. the edges are relaxed.  The public model in use is a BPE model, for which the best sum of scores
   is not the right result; so relaxing joins, in every unit at once, the two neighbouring symbols
   whose edge has the best score (the leftmost of equals) until no edge spans two neighbours.

Characters without a piece become byte pieces.  Encoding is narrow: no shuffle.  The model
(a bounded vocabulary) is read on the driver and broadcast.

Defined cases: a null text has null ids and null counts, an empty one no ids; ``decode`` of null is
null; repeated rows are encoded each for itself, of equal scores the leftmost pair is joined, an empty
table gives an empty result, a column of a new one's name is replaced; U+2581 in a text is a space, as in the public library, so it comes back as one; texts of any
length are encoded whole.  Only models without normalisation, with a dummy prefix and byte
fallback, are taken; others raise.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wearline.llm import textblocks as tb

#: Bytes of text that one suffix array covers: all of its arrays together take about 60 times as much.
BLOCK = 1 << 20
LONG_UNIT = 64
BARRIERS = (0x0A, 0x0D, 0x09)


@dataclass
class Pieces:
    """What encoding and decoding need of a model; spaces stand for U+2581."""

    texts: list[bytes]
    ids: np.ndarray
    rank: np.ndarray
    byte_ids: np.ndarray
    surface: list[bytes]
    barriers: tuple[int, ...] = field(default=())

    @cached_property
    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """The pieces' lengths in bytes, and their bytes as rows of one width (8 at least)."""
        lengths = np.array([len(t) for t in self.texts], np.int64)
        table = np.zeros((len(lengths), max(8, int(lengths.max(initial=1)))), np.uint8)
        for i, t in enumerate(self.texts):
            table[i, : len(t)] = np.frombuffer(t, np.uint8)
        return lengths, table

    @cached_property
    def single(self) -> np.ndarray:
        """For each byte the index of the piece that is this byte alone, or -1."""
        lengths, table = self.matrix
        out = np.full(256, -1, np.int64)
        out[table[lengths == 1, 0]] = np.flatnonzero(lengths == 1)
        return out


def load(path: str) -> Pieces:
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    norm = model.normalizer_spec
    if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not model.trainer_spec.byte_fallback:
        raise ValueError("only BPE models without normalisation, with dummy prefix and byte fallback, are supported")
    texts, ids, scores, surface = [], [], [], []
    byte_ids = np.zeros(256, np.int32)
    for i, p in enumerate(model.pieces):
        own = p.piece.replace("▁", " ").encode()
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
            surface.append(bytes([int(p.piece[3:5], 16)]))
        elif p.type in (1, 4, 5):
            texts.append(own)
            ids.append(i)
            scores.append(p.score)
            surface.append(own)
        else:
            surface.append(b" \xe2\x81\x87 " if p.type == 2 else b"")
    _, rank = np.unique(-np.array(scores), return_inverse=True)
    used = set(b"".join(texts))
    inner = [t for t in texts if b" " in t.lstrip(b" ")]
    if inner:
        raise ValueError("a piece holds a space behind other characters, so units can't be cut at spaces")
    return Pieces(texts, np.array(ids, np.int32), rank.astype(np.int64), byte_ids, surface, tuple(b for b in BARRIERS if b not in used))


def edges(text: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of pieces of two or more bytes in ``text``: position * 2^16 + length in ascending order, and the piece's index."""
    lengths, table = pieces.matrix
    width = table.shape[1]
    low = table[:, :8].copy()
    high = np.where(np.arange(8) < lengths[:, None], low, 255).astype(np.uint8)
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    suffix = np.zeros(len(text), np.uint64)
    for j in range(8):
        suffix <<= np.uint64(8)
        suffix |= padded[j : j + len(text)]
    order = np.argsort(suffix)
    suffix = suffix[order]
    order = order.astype(np.int32) if len(text) < 1 << 31 else order
    first = np.searchsorted(suffix, low.view(">u8")[:, 0].astype(np.uint64), side="left")
    count = np.searchsorted(suffix, high.view(">u8")[:, 0].astype(np.uint64), side="right") - first
    del suffix
    # A piece of one byte spans no two neighbours, so it is no edge to relax; ``Pieces.single`` has it.
    some = np.flatnonzero((count > 0) & (lengths > 1))
    first, count = first[some], count[some]
    piece = np.repeat(some.astype(np.int32), count)
    where = order[np.arange(len(piece)) + np.repeat(first - (np.cumsum(count) - count), count)]
    del order
    more = np.flatnonzero(lengths[piece] > 8)
    if len(more):
        good = np.ones(len(more), bool)
        for j in range(8, width):
            good &= (lengths[piece[more]] <= j) | (padded[where[more] + j] == table[piece[more], j])
        keep = np.ones(len(piece), bool)
        keep[more] = good
        piece, where = piece[keep], where[keep]
    key = where.astype(np.int64)
    del where
    key *= 65536
    key += lengths[piece]
    by = np.argsort(key)
    return key[by], piece[by]


def _find(keys: np.ndarray, value: np.ndarray, start: np.ndarray, length: np.ndarray, none: int) -> np.ndarray:
    if not len(keys):
        return np.full(len(start), none)
    want = start * 65536 + np.minimum(length, 65535)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, value[at], none)


def _relax_long(start: list[int], end: int, keys: np.ndarray, piece: np.ndarray, rank: np.ndarray) -> list[int]:
    """The symbols' starts of one long unit after all joins, by a heap."""
    n = len(start)
    ends, after, before, alive = [*start[1:], end], list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    known: dict[int, int] = {}
    low, high = np.searchsorted(keys, [start[0] * 65536, end * 65536])
    for k, p in zip(keys[low:high].tolist(), piece[low:high].tolist(), strict=True):
        known[k] = int(rank[p])
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (r := known.get(start[i] * 65536 + ends[j] - start[i])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or ends[j] != stop:
            continue
        alive[j], ends[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s, a in zip(start, alive, strict=True) if a]


def relax(text: np.ndarray, bounds: np.ndarray, keys: np.ndarray, piece: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Starts of the symbols that remain in ``text``, whose units start at ``bounds[:-1]`` (0 bytes between units)."""
    none = np.int64(1) << 40
    ranks = rank[piece]
    start = np.flatnonzero(tb.code_points(text) & (text != 0))
    unit = np.searchsorted(bounds, start, side="right") - 1
    size = np.bincount(unit, minlength=len(bounds) - 1)
    done = []
    for u in np.flatnonzero(size > LONG_UNIT):
        own = start[unit == u] if len(size) < 1000 else start[np.searchsorted(unit, u) : np.searchsorted(unit, u + 1)]
        done.append(np.array(_relax_long(own.tolist(), int(bounds[u + 1]) - 1, keys, piece, rank), np.int64))
    short = size[unit] <= LONG_UNIT
    start, unit = start[short], unit[short]
    end_of = bounds[1:] - 1
    # best[i]: the rank at which symbol i joins its right neighbour
    def ends(s: np.ndarray, u: np.ndarray) -> np.ndarray:
        e = np.append(s[1:], 0)
        last = np.append(u[1:] != u[:-1], True) if len(u) else np.zeros(0, bool)
        return np.where(last, end_of[u], e)

    end = ends(start, unit)
    if len(start):
        last = np.append(unit[1:] != unit[:-1], True)
        best = np.full(len(start), none)
        i = np.flatnonzero(~last)
        best[i] = _find(keys, ranks, start[i], end[i + 1] - start[i], none)
    while len(start):
        head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        least = np.minimum.reduceat(best, head)
        length = np.diff(np.append(head, len(start)))
        live = np.repeat(least < none, length)
        if not live.all():
            done.append(start[~live])
            start, unit, end, best = start[live], unit[live], end[live], best[live]
            if not len(start):
                break
            least = least[least < none]
            head = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            length = np.diff(np.append(head, len(start)))
        hit = np.flatnonzero(best == np.repeat(least, length))
        hit = hit[np.append(True, unit[hit[1:]] != unit[hit[:-1]])]
        end[hit] = end[hit + 1]
        keep = np.ones(len(start), bool)
        keep[hit + 1] = False
        moved = hit - np.searchsorted(hit, hit, side="left")
        start, unit, end, best = start[keep], unit[keep], end[keep], best[keep]
        best[moved] = none
        last = np.append(unit[1:] != unit[:-1], True)
        i = moved[~last[moved]]
        best[i] = _find(keys, ranks, start[i], end[i + 1] - start[i], none)
        i = moved[moved > 0] - 1
        i = i[unit[i] == unit[i + 1]]
        best[i] = _find(keys, ranks, start[i], end[i + 1] - start[i], none)
    return np.sort(np.concatenate([np.zeros(0, np.int64), *done]))


def _encode_block(data: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents in a row, and each document's first one (one more entry than documents)."""
    n = len(offsets) - 1
    full = np.diff(offsets) > 0
    data = np.insert(data, offsets[:-1][full], 0x20)
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    space = data == 0x20
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    for b in pieces.barriers:
        own = data == b
        begins |= own
        begins[1:] |= own[:-1]
    begins[offsets[:-1][full]] = True
    us = np.flatnonzero(begins)
    ue = np.append(us[1:], len(data))
    ub = np.searchsorted(us, offsets)
    h = tb.hashes(data, us, ue)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    s, length = us[first], (ue - us)[first]
    bounds = np.concatenate([[0], np.cumsum(length + 1)])
    text = np.zeros(bounds[-1], np.uint8)
    place = np.repeat(bounds[:-1] - (np.cumsum(length) - length), length) + np.arange(length.sum())
    text[place] = data[np.repeat(s - (np.cumsum(length) - length), length) + np.arange(length.sum())]
    del place, h, us, ue, space, begins, data
    keys, piece = edges(text, pieces)
    start = relax(text, bounds, keys, piece, pieces.rank)
    unit = np.searchsorted(bounds, start, side="right") - 1
    end = np.append(start[1:], 0)
    last = np.append(unit[1:] != unit[:-1], True)
    end = np.where(last, bounds[unit + 1] - 1, end)
    found = np.where(end - start == 1, pieces.single[text[start]], _find(keys, piece, start, end - start, -1))
    lost = found < 0
    many = np.where(lost, end - start, 1)
    symbol = np.repeat(np.arange(len(start)), many)
    inner = np.arange(len(symbol)) - np.repeat(np.cumsum(many) - many, many)
    flat = np.where(lost[symbol], pieces.byte_ids[text[start[symbol] + np.where(lost[symbol], inner, 0)]], pieces.ids[np.maximum(found, 0)[symbol]])
    per_unit = np.bincount(unit[symbol], minlength=len(s))
    head = np.cumsum(per_unit) - per_unit
    take = per_unit[inverse]
    stop = np.cumsum(take)
    ids = flat[np.repeat(head[inverse] - (stop - take), take) + np.arange(int(stop[-1]))]
    return ids.astype(np.int32), np.concatenate([[0], stop])[ub]


def encode_column(column: pa.Array, pieces: Pieces) -> pa.Array:
    import pyarrow.compute as pc

    if pc.any(pc.match_substring(column, "▁")).as_py():
        column = pc.replace_substring(column, "▁", " ")
    data, offsets = tb.text_bytes(column)
    ids, ends, total = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
    for low, high in tb.blocks(offsets, BLOCK):
        own, bounds = _encode_block(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], pieces)
        ids.append(own)
        ends.append(bounds[1:] + total)
        total += len(own)
    bounds = pa.array(np.concatenate(ends).astype(np.int32), mask=None)
    made = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(ids)))
    return pc.if_else(pc.is_null(column), pa.nulls(len(column), made.type), made) if column.null_count else made


def decode_column(column: pa.Array, pieces: Pieces) -> pa.Array:
    import pyarrow.compute as pc

    lengths = np.array([len(s) for s in pieces.surface], np.int64)
    starts = np.cumsum(lengths) - lengths
    pool = np.frombuffer(b"".join(pieces.surface), np.uint8)
    column = pc.fill_null(column, pa.scalar([], column.type)) if (nulls := column.is_null()) and column.null_count else column
    ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    counts = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    take = lengths[ids]
    stop = np.cumsum(take)
    out = pool[np.repeat(starts[ids] - (stop - take), take) + np.arange(int(stop[-1]) if len(stop) else 0)]
    ends = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
    raw = out.tobytes()
    texts = [raw[a + (raw[a : a + 1] == b" ") : b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    made = pa.array(texts, pa.string())
    return pc.if_else(nulls, pa.scalar(None, pa.string()), made)


def encode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", count: str = "n_tokens", verify: str | None = None) -> DataFrame:
    """All columns of ``df`` (one of the new names is replaced) with the piece ids of ``text`` and their number.

    ``verify`` names a further column: whether the ids decode to the text again.
    """
    new = [ids, count, *([verify] if verify else [])]
    names = [c for c in df.columns if c not in new]
    kept = df.select(*(df[c] for c in names))
    sent = df.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                column = part.column(names.index(text)).cast(pa.string())
                made = encode_column(column, sent.value)
                columns = [*part.columns, made, pc.list_value_length(made).cast(pa.int64())]
                if verify:
                    columns.append(pc.equal(decode_column(made, sent.value), column))
                yield pa.RecordBatch.from_arrays(columns, [*names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{ids}` array<int>, `{count}` long" + (f", `{verify}` boolean" if verify else ""))


def decode(df: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of ``df`` with the text of ``ids`` in ``text``."""
    names = [c for c in df.columns if c != text]
    kept = df.select(*(df[c] for c in names))
    sent = df.sparkSession.sparkContext.broadcast(load(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_column(batch.column(names.index(ids)), sent.value)], [*names, text])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, `{text}` string")
