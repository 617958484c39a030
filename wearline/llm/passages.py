"""Repeated passages across documents by collinear chaining of shared k-mer seeds.

1. Seeds are hashes of ``k`` consecutive words (A-Z lowered) that are the smallest of ``window``
   consecutive ones, so any shared run of ``k + window - 1`` words shares a seed.
2. A seed's places are put in order (document id, position).  Each is matched with the first place,
   with the one before it, and with the one before it that goes on with the same next seed, if those
   are in other documents: three matches a place at most, not n squared.  The first place alone
   would not do: where the seeds of one passage begin in different documents, no document holds it
   whole but the one before; and where single seeds of it lie in short pieces in between, only a
   place that goes on alike belongs to the passage.  A hot seed's places are dealt among tasks by
   document, matched within each, and the places of the tasks' first documents are matched among themselves.
3. Per document and anchor document the matches are gathered into segments of one diagonal and
   chained: in order of position, the best predecessor that ends before a segment in both texts
   comes from a Fenwick tree of prefix maxima, with ``gap_cost`` for each word of gap.
4. Chains are aligned on the texts: segments grow word by word, equal runs between them are added,
   ends grow while matches outweigh mismatches, and chains break at gaps of over ``max_gap`` words.
   Parts with ``identity`` or more equal words stay.  Lone seeds, by far the most, grow all at once.
5. Places whose seed has further earlier places than the three, and which no passage found so far holds,
   open their seed again: all places of an open seed are compared with all earlier ones by the 64 words
   on either side, equal surroundings once.  Of the parts that hold together, those that go furthest back
   and furthest on are kept, and all others lie within them.  This is quadratic in the different
   surroundings of an open seed; they are dealt into blocks, and tasks compare two blocks at a time.
6. A document's parts, whichever anchor they meet, are united; unions of ``min_words`` or more are
   its repeated passages.

Defined cases: null, empty and short texts have no seed; rows with a null id are left out, rows
with equal ids are one document read in any order and not matched with each other; a passage that
repeats within one document only is none; an empty table gives an empty result; texts are read
whole; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.llm import textblocks as tb
from wearline.llm.session import cut

#: Words by which an end of a chain may grow; passages that go on longer have further seeds there.
MARGIN = 64
#: The share of all seeds, and the places, from which a seed's places are dealt among ``SALTS`` tasks.
HOT, LEAST_HOT, SALTS = 5e-5, 500, 64
BROADCAST_IDS = 1_000_000
#: Places of an open seed that make up a block, and pairs that are compared at once.
BLOCK, PAIRS = 32_768, 400_000


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, next row, word hashes and each row's first word (one more entry than rows)."""
    data, offsets = tb.text_bytes(column)
    for low, high in tb.blocks(offsets):
        piece, own = tb.LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        ws, we, wb = tb.words(piece, own)
        yield low, high, tb.hashes(piece, ws, we), wb


def minimizers(grams: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest of each ``window`` consecutive values of a document (of all, if it has fewer)."""
    n = len(grams)
    found = []
    if n >= window:
        least, at, span = grams, np.arange(n), 1
        while span < window:
            step = min(span, window - span)
            take = least[step:] < least[:-step]
            at = np.where(take, at[step:], at[:-step])
            least = np.where(take, least[step:], least[:-step])
            span += step
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found.append(at[doc[: n - window + 1] == doc[window - 1 :]])
    for i in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < window)):
        found.append(np.array([bounds[i] + int(np.argmin(grams[bounds[i] : bounds[i + 1]]))]))
    return np.unique(np.concatenate([np.zeros(0, np.int64), *found]))


def _minimized(column: pa.Array, k: int, window: int) -> Iterator[tuple]:
    """For blocks of rows: the rows' range, all seeds, the places of the chosen ones in them, and each one's row and word."""
    for low, high, h, wb in _word_hashes(column):
        yield low, high, *_chosen(h, wb, high - low, k, window)


def _chosen(h: np.ndarray, wb: np.ndarray, rows: int, k: int, window: int) -> tuple[np.ndarray, ...]:
    """All seeds of rows, the places of the chosen ones in them, and each one's row and word."""
    count = np.maximum(np.diff(wb) - k + 1, 0)
    doc = np.repeat(np.arange(rows), count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    own = tb.windows(h, k)[wb[doc] + place] if len(doc) else np.zeros(0, np.uint64)
    return own, minimizers(own, np.concatenate([[0], np.cumsum(count)]), window), doc, place


def _seeds(df: DataFrame, k: int, window: int) -> DataFrame:
    """(seed, doc, at): ``at`` is the position * 2^15 + some bits of the document's next seed, one number as rows are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, own, at, doc, place in _minimized(batch.column(1), k, window):
                if len(at):
                    # Some bits of the document's next seed: equal ones by chance only add a match.
                    follow = np.append((own[at][1:] >> np.uint64(49)).astype(np.int16), np.int16(0))
                    follow[:-1][doc[at][1:] != doc[at][:-1]] = 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(own[at].view(np.int64)), batch.column(0).take(pa.array(doc[at] + low)), pa.array(place[at].astype(np.int64) << 15 | follow)],
                        ["seed", "doc", "at"],
                    )

    return df.mapInArrow(run, f"seed long, doc {df.schema[0].dataType.simpleString()}, at long")


def _hot(df: DataFrame, k: int, window: int) -> DataFrame:
    """(seed, hot) of seeds that make up ``HOT`` or more of all in some part of the input and of what such parts add up to: at most 1 / HOT of them.

    They only tell which seeds' places are dealt among several tasks; the matches are as good without.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = np.concatenate([np.zeros(0, np.uint64), *(own[at] for _, _, own, at, _, _ in _minimized(batch.column(1), k, window))])
            seed, count = np.unique(seeds, return_counts=True)
            often = count >= max(3, HOT * len(seeds))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(seed[often].view(np.int64), 0)), pa.array(np.append(count[often], len(seeds))), pa.array(np.append(np.zeros(int(often.sum()), bool), True))], ["seed", "n", "all"]
            )

    found = cut(df.mapInArrow(run, "seed long, n long, all boolean").groupBy("seed", "all").agg(F.sum("n").alias("n")))
    total = found.where("all").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return found.where(~F.col("all") & (F.col("n") >= max(LEAST_HOT, HOT * total))).select("seed", F.lit(True).alias("hot"))


def _earlier(places: DataFrame, by: list[str]) -> DataFrame:
    """Adds the first place of the group, the one before each, the one before it that goes on with the same seed, and its number in the group."""
    order, place = Window.partitionBy(*by).orderBy("doc", "pos"), F.struct("doc", "pos")
    alike = Window.partitionBy(*by, "follow").orderBy("doc", "pos")
    return places.withColumns({"first": F.first(place).over(order), "last": F.lag(place).over(order)}).withColumns({"like": F.lag(place).over(alike), "nth": F.row_number().over(order)})


def _matched(places: DataFrame, more: Column) -> DataFrame:
    """(doc, pos, anchor, ref, open) for each place and those of the three that are in other documents.

    With the first one, ``open`` is the seed where ``more`` says that it has further earlier places.
    """
    both = F.posexplode(F.array_distinct(F.array("first", F.coalesce("last", "first"), F.coalesce("like", "first")))).alias("i", "e")
    found = places.select("seed", "doc", "pos", more.alias("more"), both)
    return found.select("doc", "pos", F.col("e.doc").alias("anchor"), F.col("e.pos").alias("ref"), F.when((F.col("i") == 0) & F.col("more"), F.col("seed")).alias("open")).where("doc <> anchor")


class Fenwick:
    """Prefix maxima of (value, item) over ranks."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(0.0, -1)] * (n + 1)

    def put(self, rank: int, value: float, item: int) -> None:
        rank += 1
        while rank < len(self.best):
            if value > self.best[rank][0] or self.best[rank][1] < 0:
                self.best[rank] = (value, item)
            rank += rank & -rank

    def top(self, upto: int) -> tuple[float, int]:
        """The best item of ranks below ``upto``."""
        out = (-np.inf, -1)
        while upto > 0:
            if self.best[upto][1] >= 0 and self.best[upto][0] > out[0]:
                out = self.best[upto]
            upto -= upto & -upto
        return out


def segments(pos: np.ndarray, ref: np.ndarray, k: int, reach: int) -> np.ndarray:
    """Runs of matches on one diagonal with steps of at most ``reach``: rows (pos, ref, length), by position."""
    order = np.lexsort((pos, pos - ref))
    p, d = pos[order], (pos - ref)[order]
    new = np.append(True, (d[1:] != d[:-1]) | (p[1:] - p[:-1] > reach))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    out = np.stack([p[first], p[first] - d[first], p[last] - p[first] + k], axis=1)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def chains(parts: np.ndarray, gap_cost: float) -> list[list[int]]:
    """Lists of segments in order, each segment in one chain at most, best chains first."""
    n = len(parts)
    if n == 1:
        return [[0]]
    p, r, length = (parts[:, j].tolist() for j in range(3))
    ends = sorted(range(n), key=lambda i: p[i] + length[i])
    ranks = np.searchsorted(np.sort(parts[:, 1] + parts[:, 2]), parts[:, 1] + parts[:, 2]).tolist()
    sorted_ends = np.sort(parts[:, 1] + parts[:, 2])
    below = np.searchsorted(sorted_ends, parts[:, 1], side="right").tolist()
    tree, score, before, done = Fenwick(n), [0.0] * n, [-1] * n, 0
    for j in range(n):
        while done < n and p[ends[done]] + length[ends[done]] <= p[j]:
            i = ends[done]
            tree.put(ranks[i], score[i] + gap_cost * (p[i] + length[i] + r[i] + length[i]), i)
            done += 1
        value, i = tree.top(below[j])
        gain = value - gap_cost * (p[j] + r[j]) if i >= 0 else 0.0
        score[j] = length[j] + max(0.0, gain)
        before[j] = i if gain > 0 else -1
    used, out = [False] * n, []
    for j in sorted(range(n), key=lambda j: -score[j]):
        if used[j]:
            continue
        chain = []
        while j >= 0 and not used[j]:
            used[j] = True
            chain.append(j)
            j = before[j]
        out.append(chain[::-1])
    return out


CHAIN = "pos array<int>, ref array<int>, length array<int>, opened array<struct<seed: long, pos: int>>"
OPENED = pa.list_(pa.struct([("seed", pa.int64()), ("pos", pa.int32())]))


def _chained(matches: DataFrame, k: int, window: int, gap_cost: float) -> DataFrame:
    """doc, anchor and the segments of each chain of matches; with the first chain of both, the open seeds and their places.

    Lone matches stay: where words were changed, one seed may be all that a passage has left, and
    only the alignment shows how far it goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            doc, anchor = table.column(0).combine_chunks(), table.column(2).combine_chunks()
            a, b = doc.to_numpy(), anchor.to_numpy()
            pos, ref = table.column(1).to_numpy().astype(np.int64), table.column(3).to_numpy().astype(np.int64)
            first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            again, seed = ~table.column(4).is_null().to_numpy(zero_copy_only=False), table.column(4).fill_null(0).to_numpy()
            rows, lists, opened = [], ([], [], []), []
            for low, high in zip(first.tolist(), [*first[1:].tolist(), len(a)], strict=True):
                parts = segments(pos[low:high], ref[low:high], k, k + window)
                own_open = [{"seed": s, "pos": p} for s, p in zip(seed[low:high][again[low:high]].tolist(), pos[low:high][again[low:high]].tolist(), strict=True)]
                for chain in chains(parts, gap_cost):
                    own = parts[chain]
                    rows.append(low)
                    opened.append(own_open)
                    own_open = []
                    for j in range(3):
                        lists[j].append(own[:, j].tolist())
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([doc.take(take), anchor.take(take), *(pa.array(x, pa.list_(pa.int32())) for x in lists), pa.array(opened, OPENED)], ["doc", "anchor", "pos", "ref", "length", "opened"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            doc = held.column(0).to_numpy()
            cut_at = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0
            if cut_at:
                yield from emit(held.slice(0, cut_at))
                held = held.slice(cut_at)
        if held is not None and len(held):
            yield from emit(held)

    kind = matches.schema["doc"].dataType.simpleString()
    ordered = matches.select("doc", "pos", "anchor", "ref", "open").repartition("doc").sortWithinPartitions("doc", "anchor", "pos", "ref")
    return ordered.mapInArrow(run, f"doc {kind}, anchor {kind}, {CHAIN}")


def _grow(a: np.ndarray, b: np.ndarray) -> int:
    """How far two runs go on from their start while a match (+1) outweighs mismatches (-2)."""
    n = min(len(a), len(b))
    if not n:
        return 0
    total = np.cumsum(np.where(a[:n] == b[:n], 1, -2))
    best = int(np.argmax(total))
    return best + 1 if total[best] > 0 else 0


def grow_lone(
    xs: tuple[np.ndarray, np.ndarray], ys: tuple[np.ndarray, np.ndarray], rows: np.ndarray, pos: np.ndarray, ref: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains of one seed, what ``align`` gives: words before the seed, words in all, equal words.

    ``xs`` and ``ys`` are offsets and words of all rows, ``pos`` and ``ref`` the seed's places in them.
    """
    (at_x, x), (at_y, y) = xs, ys
    first_x, first_y = at_x[rows] + pos, at_y[rows] + ref

    def reach(start_x: np.ndarray, start_y: np.ndarray, room: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        j = np.arange(MARGIN)
        inside = j < room[:, None]
        a, b = np.where(inside, start_x[:, None] + step * j, 0), np.where(inside, start_y[:, None] + step * j, 0)
        equal = inside & (x[a] == y[b]) if len(x) and len(y) else inside
        total = np.cumsum(np.where(equal, 1, np.where(inside, -2, -3 * MARGIN)), axis=1)
        best = np.argmax(total, axis=1)
        at = np.arange(len(rows))
        good = total[at, best] > 0
        return np.where(good, best + 1, 0), np.where(good, np.cumsum(equal, axis=1)[at, best], 0)

    if not len(rows):
        return (np.zeros(0, np.int64),) * 3
    back, back_equal = reach(first_x - 1, first_y - 1, np.minimum(pos, ref), -1)
    on, on_equal = reach(first_x + k, first_y + k, np.minimum(at_x[rows + 1] - first_x - k, at_y[rows + 1] - first_y - k), 1)
    return back, back + k + on, back_equal + k + on_equal


def _same(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _between(x: np.ndarray, y: np.ndarray, left: list[int], right: list[int] | None) -> list[list[int]]:
    """The equal runs between two segments, if as many words lie between them in both texts."""
    if right is None or right[0] - left[1] != right[2] - left[3] or right[0] - left[1] < 4:
        return []
    return [[left[1] + s, left[1] + e, left[3] + s, left[3] + e] for s, e in _runs(x[left[1] : right[0]] == y[left[3] : right[2]])]


def align(x: np.ndarray, y: np.ndarray, parts: np.ndarray, max_gap: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """(start, end, ref start, ref end, equal words) of the good parts of a chain between the words x and y."""
    grown: list[list[int]] = []
    for p, r, n in parts.tolist():
        equal = _runs(x[p : p + n] == y[r : r + n])
        for s, e in equal:
            if grown and (p + s < grown[-1][1] or r + s < grown[-1][3]):
                shift = max(grown[-1][1] - p - s, grown[-1][3] - r - s)
                s += shift
            if e > s:
                grown.append([p + s, p + e, r + s, r + e])
    for left, right in zip(grown, grown[1:], strict=False):
        more = _same(x[left[1] : right[0]], y[left[3] : right[2]])
        left[1] += more
        left[3] += more
        more = _same(x[left[1] : right[0]][::-1], y[left[3] : right[2]][::-1])
        right[0] -= more
        right[2] -= more
    if not grown:
        return []
    grown = [part for left, right in zip(grown, [*grown[1:], None], strict=True) for part in (left, *_between(x, y, left, right))]
    back = _grow(x[max(0, grown[0][0] - MARGIN) : grown[0][0]][::-1], y[max(0, grown[0][2] - MARGIN) : grown[0][2]][::-1])
    on = _grow(x[grown[-1][1] : grown[-1][1] + MARGIN], y[grown[-1][3] : grown[-1][3] + MARGIN])

    def close(run: list[list[int]]) -> tuple[int, int, int, int, int]:
        first = run[0] is grown[0]
        last = run[-1] is grown[-1]
        s, r, e, f = run[0][0] - back * first, run[0][2] - back * first, run[-1][1] + on * last, run[-1][3] + on * last
        equal = sum(g[1] - g[0] for g in run)
        equal += int((x[s : run[0][0]] == y[r : run[0][2]]).sum()) + int((x[run[-1][1] : e] == y[run[-1][3] : f]).sum())
        return s, e, r, f, equal

    def split(run: list[list[int]], gap: int) -> Iterator[tuple[int, int, int, int, int]]:
        start = 0
        for i in range(1, len(run) + 1):
            if i == len(run) or run[i][0] - run[i - 1][1] > gap or run[i][2] - run[i - 1][3] > gap:
                part = close(run[start:i])
                if part[4] >= identity * max(part[1] - part[0], part[3] - part[2]):
                    yield part
                elif gap > 3:
                    yield from split(run[start:i], gap // 2)
                start = i

    return list(split(grown, max_gap))


def _runs(equal: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    return [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2], strict=True) if e - s >= 2]


def repeated_passages(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, k: int = 8, window: int = 16, min_words: int = 50,
    identity: float = 0.8, gap_cost: float = 0.2, max_gap: int = 24, least_part: int = 12,
) -> DataFrame:
    """(key, start_word, end_word, n_words, equal_words, ref_ids, ref_starts) per repeated passage of a document.

    Words count from 0, the end is exclusive; ``ref_ids`` are the documents that hold the passage's
    parts earlier, ``ref_starts`` the words at which the parts begin there.
    """
    source = df.select(df[key].alias("doc"), df[text].alias("text")).where("doc is not null")
    kind = source.schema["doc"].dataType.simpleString()
    seeds = _seeds(source, k, window)
    hot = _hot(source, k, window)
    dealt = seeds.join(F.broadcast(hot), "seed", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("doc"), F.lit(SALTS))).otherwise(-1))
    places = dealt.select("seed", "salt", "doc", "at").repartition("seed", "salt")
    places = places.select("seed", "salt", "doc", F.shiftright("at", 15).cast("int").alias("pos"), F.col("at").bitwiseAND(F.lit(0x7FFF)).cast("short").alias("follow"))
    salted = _earlier(places, ["seed", "salt"])
    heads = salted.where("salt >= 0 and doc = first.doc").select("seed", "doc", "pos", "follow")
    beyond = (F.col("nth") > 3) | ((F.col("nth") > 2) & (F.col("last.doc") == F.col("doc")))
    matches = _matched(salted, beyond | (F.col("salt") >= 0)).union(_matched(_earlier(heads, ["seed"]), F.lit(True)))
    found = cut(_chained(matches, k, window, gap_cost))
    ids = found.select("doc").union(found.select("anchor")).distinct()
    needed = source.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc", "left_semi").dropDuplicates(["doc"])
    texts = cut(_hashed(needed, kind))

    def region(words, at, low):
        """The words of a chain and ``MARGIN`` more on both sides."""
        stop = F.element_at(at, -1) + F.element_at("length", -1) + MARGIN
        return F.slice(words, low + 1, stop - low)

    low, low_ref = F.greatest(F.col("pos")[0] - MARGIN, F.lit(0)), F.greatest(F.col("ref")[0] - MARGIN, F.lit(0))
    left = found.join(texts, "doc").select("doc", "anchor", "pos", "ref", "length", low.alias("low"), region(F.col("h"), F.col("pos"), low).alias("x"))
    both = left.join(texts.select(F.col("doc").alias("anchor"), "h"), "anchor").select(
        "doc", "anchor", "low", low_ref.alias("low_ref"), "x", region(F.col("h"), F.col("ref"), low_ref).alias("y"), "pos", "ref", "length"
    )

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            lows, low_refs = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy().astype(np.int64)
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in batch.columns[4:9]]
            sizes, length_of = np.diff(lists[2][0]), lists[4]
            lone = np.flatnonzero(sizes == 1)
            lone = lone[length_of[1][length_of[0][lone]] == k]
            s, n, equal = grow_lone(lists[0], lists[1], lone, lists[2][1][lists[2][0][lone]] - lows[lone], lists[3][1][lists[3][0][lone]] - low_refs[lone], k)
            keep = np.flatnonzero((equal >= identity * n) & (n >= least_part))
            start = lists[2][1][lists[2][0][lone]] - s
            at_ref = lists[3][1][lists[3][0][lone]] - s
            for i in keep.tolist():
                rows.append(int(lone[i]))
                out.append((start[i], start[i] + n[i], at_ref[i], equal[i]))
            rest = np.ones(len(batch), bool)
            rest[lone] = False
            for i in np.flatnonzero(rest).tolist():
                x, y, pos, ref, length = (values[at[i] : at[i + 1]] for at, values in lists)
                parts = np.empty((len(pos), 3), np.int64)
                parts[:, 0], parts[:, 1], parts[:, 2] = pos - lows[i], ref - low_refs[i], length
                for s, e, r, f, equal in align(x, y, parts, max_gap, identity):
                    if e - s >= least_part:
                        rows.append(i)
                        out.append((s + lows[i], e + lows[i], r + low_refs[i], equal))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), *(pa.array([int(o[j]) for o in out], pa.int32()) for j in range(4))],
                ["doc", "anchor", "start", "end", "ref", "equal"],
            )

    parts = cut(both.mapInArrow(aligned, _part(kind)))
    spans = _united(parts.select("doc", "start", "end", *(F.lit(0).alias(c) for c in ("anchor", "ref", "equal")))).groupBy("doc", "u").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    first = spans.where(F.col("end") - F.col("start") >= min_words).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rest = _rest(source, *_open_places(found, first, k), k, window, identity, least_part)
    return _passages(_beyond(parts, rest, min_words), min_words).select(
        F.col("doc").alias(key), F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"),
        F.col("equal").alias("equal_words"), F.col("held.anchor").alias("ref_ids"), F.col("held.ref").alias("ref_starts"),
    )


def _part(kind: str) -> str:
    return f"doc {kind}, anchor {kind}, start int, end int, ref int, equal int"


def _united(parts: DataFrame) -> DataFrame:
    """Adds ``before``, the furthest end of the document's parts that begin earlier, and ``u``, the number of a part's union.

    Parts of a document are put in order; one that begins more than 3 words after all earlier ones have ended begins a union.
    """
    order = Window.partitionBy("doc").orderBy("start", "end", "anchor", "ref", "equal")
    found = parts.withColumn("before", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return found.withColumn("u", F.count_if(F.col("before").isNull() | (F.col("start") > F.col("before") + 3)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def _passages(parts: DataFrame, min_words: int) -> DataFrame:
    """(doc, start, end, equal, held) of unions of ``min_words`` or more; ``held`` are their parts in order."""
    more = (F.greatest(F.lit(0), F.col("end") - F.greatest("before", "start")) * F.col("equal") / (F.col("end") - F.col("start"))).cast("int")
    new = F.col("before").isNull() | (F.col("start") > F.col("before") + 3)
    held = F.sort_array(F.collect_list(F.struct("start", "end", "anchor", "ref", "equal")))
    unions = _united(parts).withColumn("own", F.when(new, F.col("equal")).otherwise(more)).groupBy("doc", "u").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("own").cast("int").alias("equal"), held.alias("held")
    )
    return unions.where(F.col("end") - F.col("start") >= min_words).drop("u")


def _beyond(parts: DataFrame, rest: DataFrame, min_words: int) -> DataFrame:
    """``parts`` and those of ``rest`` that no passage of ``parts`` holds."""
    both = parts.withColumn("late", F.lit(False)).union(rest.withColumn("late", F.lit(True)))
    order = Window.partitionBy("doc").orderBy("start", "late")
    end = F.when(~F.col("late"), F.col("end"))
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = ~F.col("late") & (F.col("before").isNull() | (F.col("start") > F.col("before") + 3))
    placed = both.withColumn("before", before).withColumn("u", F.count_if(new).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = Window.partitionBy("doc", "u")
    placed = placed.withColumns({"first": F.min(F.when(~F.col("late"), F.col("start"))).over(whole), "last": F.max(end).over(whole)})
    inside = (F.col("last") - F.col("first") >= min_words) & (F.col("end") <= F.col("last"))
    return placed.where(~F.col("late") | ~F.coalesce(inside, F.lit(False))).select(*parts.columns)


# The rest of an open seed's places ------------------------------------------------------------------------------------


def _open_places(found: DataFrame, passages: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(seed, doc, pos) of open places outside of all passages found so far, and their seeds with the number of blocks of all places."""
    opened = found.where(F.size("opened") > 0)
    places = opened.select("doc", "opened").join(passages, "doc", "left").select("doc", "spans", F.inline("opened"))
    inside = F.exists("spans", lambda x: (x["start"] <= F.col("pos")) & (F.col("pos") + k <= x["end"]))
    left = cut(places.where(~F.coalesce(inside, F.lit(False))).select("seed", "doc", "pos"))
    count = opened.select(F.inline("opened")).groupBy("seed").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    return left, cut(count.join(left.select("seed").distinct(), "seed", "left_semi"))


def _surroundings(df: DataFrame, k: int, window: int, among: Broadcast | None) -> DataFrame:
    """(seed, words, docs, at): the words around places, nearest first, back and on, as 16-bit hashes (2 and above; 0: none), and the places that have them in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.arange(MARGIN)
        for batch in batches:
            for low, high, h, wb in _word_hashes(batch.column(1)):
                own, at, doc, place = _chosen(h, wb, high - low, k, window)
                if among is not None:
                    at = at[np.isin(own[at].view(np.int64), among.value)]
                if not len(at):
                    continue
                code = np.maximum(h >> np.uint64(48), np.uint64(2)).astype(np.uint16)
                for s in range(0, len(at), 4096):
                    some = at[s : s + 4096]
                    here = wb[doc[some]] + place[some]
                    back, on = here[:, None] - 1 - step, here[:, None] + k + step
                    around = np.concatenate([np.where(back >= wb[doc[some]][:, None], code[np.maximum(back, 0)], 0), np.where(on < wb[doc[some] + 1][:, None], code[np.minimum(on, len(h) - 1)], 0)], axis=1)
                    rows = np.concatenate([own[some].view(np.uint16).reshape(-1, 4), around.astype(np.uint16)], axis=1)
                    _, first, which = np.unique(_as_bytes(rows), return_index=True, return_inverse=True)
                    order = np.argsort(which, kind="stable")
                    bounds = pa.array(np.searchsorted(which[order], np.arange(len(first) + 1)).astype(np.int32))
                    docs = batch.column(0).take(pa.array(doc[some][order] + low))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own[some][first].view(np.int64)), pa.array([x.tobytes() for x in around[first].astype(np.uint16)], pa.binary()),
                            pa.ListArray.from_arrays(bounds, docs), pa.ListArray.from_arrays(bounds, pa.array(place[some][order].astype(np.int32))),
                        ],
                        ["seed", "words", "docs", "at"],
                    )

    return df.mapInArrow(run, f"seed long, words binary, docs array<{df.schema[0].dataType.simpleString()}>, at array<int>")


def _as_bytes(rows: np.ndarray) -> np.ndarray:
    """Rows as values of one item each."""
    rows = np.ascontiguousarray(rows)
    return rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()


def reach(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For all pairs of rows of words, how far they go on alike by the rule of ``_grow``, and how many words are equal there."""
    shape, width = (len(a), len(b)), a.shape[1]
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(np.where(b == 0, np.uint16(1), b).T)  # no word equals none
    now, best, length = (np.zeros(shape, np.int8) for _ in range(3))
    whole, alive = None, None
    for j in range(width):
        if j >= 16 and j % 4 == 0:  # pairs that can't get beyond their best any more are left
            far = best - now < width - j
            left = np.count_nonzero(far)
            if not left:
                break
            if left * 8 < far.size:
                if alive is not None:
                    whole[0][alive], whole[1][alive] = best, length
                at = np.nonzero(far)
                alive, whole = (at, (best, length)) if alive is None else (tuple(v[at[0]] for v in alive), whole)
                now, best, length = now[at], best[at], length[at]
        if alive is None:
            equal = x[j][:, None] == y[j][None, :]
        else:
            equal = x[j][alive[0]] == y[j][alive[1]]
        now += equal.view(np.int8) * np.int8(3)
        now -= np.int8(2)
        better = now > best
        if better.any():
            np.maximum(best, now, out=best)
            np.maximum(length, better.view(np.int8) * np.int8(j + 1), out=length)
    if alive is not None:
        whole[0][alive], whole[1][alive] = best, length
        best, length = whole
    best, length = best.astype(np.int16), length.astype(np.int16)
    return length, (best + 2 * length) // 3


def _compared(table: pa.Table, wanted: pa.Table, k: int, identity: float, least_part: int) -> list[tuple[np.ndarray, ...]]:
    """For two blocks of an open seed (or one with itself): rows (place, earlier place, words back, words in all, equal words).

    Places number the flattened ``docs`` and ``at``; rows are for the places of ``wanted`` alone.  The first holder of the same surroundings stands for all of them.
    """
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint16).reshape(len(table), 2 * MARGIN)
    size = pc.list_value_length(table.column("at")).to_numpy()
    docs = np.concatenate([pc.list_flatten(x.column("docs")).to_numpy(zero_copy_only=False) for x in (table, wanted)])
    rank, at, want_at = np.unique(docs, return_inverse=True)[1], *(pc.list_flatten(x.column("at")).to_numpy() for x in (table, wanted))
    asked_for = np.isin(rank[: len(at)] << 32 | at, rank[len(at) :] << 32 | want_at)
    rank = rank[: len(at)]
    block = table.column("block").to_numpy()
    _, one, which = np.unique(_as_bytes(words), return_index=True, return_inverse=True)
    which = np.repeat(which, size)
    order = np.lexsort((at, rank, which))
    holder = order[np.searchsorted(which[order], np.arange(len(one)))]
    out = []

    def put(place, earlier, back, on, equal):
        n = back + k + on
        good = (equal >= identity * n) & (n >= least_part)
        out.append(tuple(np.asarray(v)[good] for v in (place, earlier, back, n, equal)))

    whole = table.column("a")[0].as_py() == table.column("b")[0].as_py()
    if whole:
        later = np.flatnonzero(asked_for & (rank != rank[holder][which]))
        back, on = ((words[:, s : s + MARGIN] != 0).sum(axis=1)[one][which[later]] for s in (0, MARGIN))
        put(later, holder[which[later]], back, on, back + k + on)
    lengths = np.arange(2 * MARGIN + k + 1)
    least = np.where(lengths >= least_part, np.ceil(identity * lengths - 1e-9), MARGIN * 4).astype(np.int16)  # equal words that a part needs by its length
    turn = np.argsort(rank[holder], kind="stable")  # surroundings in the order of their first holders
    side = block[one][turn]
    same = [(turn, turn)] if whole else [(turn[side == s], turn[side != s]) for s in np.unique(side)]
    own = np.flatnonzero(asked_for & (rank == rank[holder][which]))  # places of the first holder's document
    own = own[np.argsort(which[own], kind="stable")]
    bounds = np.searchsorted(which[own], np.arange(len(one) + 1))
    for asked, others in same:
        asked = asked[bounds[asked + 1] > bounds[asked]]
        upto = np.searchsorted(rank[holder][others], rank[holder][asked])
        start = 0
        while start < len(asked):
            stop = min(len(asked), start + max(1, PAIRS // max(int(upto[min(len(asked), start + 64) - 1]), 1)), start + 64)
            some, n = asked[start:stop], int(upto[stop - 1])
            if n:
                x, y = words[one[some]], words[one[others[:n]]]
                back, back_equal = reach(x[:, :MARGIN], y[:, :MARGIN])
                on, on_equal = reach(x[:, MARGIN:], y[:, MARGIN:])
                total, equal = back + k + on, back_equal + k + on_equal
                good = (np.arange(n) < upto[start:stop, None]) & (equal >= least[total])
                rows = np.arange(len(some))
                for far in (back, on):
                    j = np.argmax(np.where(good, far, np.int16(-1)), axis=1)
                    i = rows[good[rows, j]]
                    j = j[i]
                    # each place of the document with these surroundings
                    many = bounds[some[i] + 1] - bounds[some[i]]
                    places = own[np.repeat(bounds[some[i]] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                    put(places, *(np.repeat(v, many) for v in (holder[others[j]], back[i, j], on[i, j], equal[i, j])))
            start = stop
    return out


def _rest(source: DataFrame, left: DataFrame, seeds: DataFrame, k: int, window: int, identity: float, least_part: int) -> DataFrame:
    """Parts of the places ``left`` with all earlier places of their seeds: those that go furthest back and furthest on."""
    kind = source.schema["doc"].dataType.simpleString()
    few = seeds.count() <= BROADCAST_IDS
    among = source.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in seeds.select("seed").collect()], np.int64))) if few else None
    around = _surroundings(source, k, window, among).join(F.broadcast(seeds) if few else seeds, "seed").withColumn("block", F.pmod(F.xxhash64("words"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = around.withColumn("other", other).select("seed", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "words", "docs", "at")
    wanted = left.groupBy("seed", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).alias("salt")).agg(F.collect_list("doc").alias("docs"), F.collect_list("pos").alias("at")).drop("salt")
    wanted = wanted.join(F.broadcast(seeds) if few else seeds, "seed").withColumn("a", other).withColumn("b", F.explode(F.sequence("a", F.col("blocks") - 1)))
    dealt = dealt.union(wanted.select("seed", "a", "b", F.lit(-1).alias("block"), F.lit(None).cast("binary").alias("words"), "docs", "at"))

    def compare(table: pa.Table) -> pa.Table:
        asked = pc.equal(table.column("block"), -1)
        wanted, table = table.filter(asked), table.filter(pc.invert(asked))
        found = [np.concatenate(v) for v in zip(*_compared(table, wanted, k, identity, least_part), strict=True)] if len(table) else []
        docs, at = pc.list_flatten(table.column("docs")), pc.list_flatten(table.column("at")).to_numpy()
        place, earlier, back, n, equal = found if found else [np.zeros(0, np.int64)] * 5
        start = at[place] - back
        columns = [docs.take(pa.array(place)), docs.take(pa.array(earlier)), *(pa.array(v.astype(np.int32)) for v in (start, start + n, at[earlier] - back, equal))]
        return pa.Table.from_arrays(columns, ["doc", "anchor", "start", "end", "ref", "equal"]).group_by(["doc", "anchor", "start", "end", "ref", "equal"]).aggregate([])

    return dealt.groupBy("seed", "a", "b").applyInArrow(compare, _part(kind))


def _hashed(df: DataFrame, kind: str) -> DataFrame:
    """doc and its words as 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, h, wb in _word_hashes(batch.column(1)):
                values = pa.ListArray.from_arrays(pa.array(wb.astype(np.int32)), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), values], ["doc", "h"])

    return df.select("doc", "text").mapInArrow(run, f"doc {kind}, h array<int>")
