"""Exact Jaccard join on word shingles by a size-aware heavy-light plan, and its groups.

Every document becomes a set of shingle hashes (64 bits).  Two sets of sizes n <= m link when
``100 * |A & B| >= 80 * |A | B|``; then they share at least ``ceil(0.8 n)`` shingles, so under any
common order of shingles the first ``n - ceil(0.8 n) + c`` of both hold at least c common ones.

1. One pass over all texts: sizes, set digests and parity bitmaps.  Documents with equal sets are
   one class; only the smallest id stands for it.
2. The order puts shingles that are frequent in some part of the input last.  Their number is
   bounded by (mean set size / ``frequent``) whatever the input size, so the table is broadcast.
3. Small sets (up to a size chosen by cost) enumerate the 2-subsets of their prefix (c = 2); large
   sets post each shingle of their prefix (c = 1) to an inverted list, and so do the small sets
   close enough to the boundary to reach a large one.
4. In each list every document is compared with one pivot only.  Verified links form groups;
   documents of one list that are then still in different groups are compared in blocks.  So a
   group of near copies costs its size per list and not its square, and no link that joins
   different groups is missed.
5. Bitmaps bound the symmetric difference from below and drop pairs that cannot link; the rest is
   verified on the whole sets.

Defined cases: lower case means A-Z only; fewer words than a shingle give one shingle of all the
words; null, empty and blank texts have no shingle, size 0 and link with nothing; equal texts
always share a group; rows with equal ids are one node, which links by any of its texts, rows with
a null id are left alone with a null group; other columns may have any names; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.llm import textblocks as tb
from wearline.llm.components import components
from wearline.llm.session import cut

BITS = 512
CHUNK = 128
#: What verifying a pair costs, in postings.
VERIFY_COST = 8
#: Up to so many ids (16 MB) are broadcast to pick their rows out of the texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For blocks of rows: the first row's index and, per row, the sorted distinct shingle hashes."""
    data, offsets = tb.text_bytes(column)
    for low, high in tb.blocks(offsets):
        piece, own = tb.LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
        ws, we, wb = tb.words(piece, own)
        wh = tb.hashes(piece, ws, we)
        grams = tb.windows(wh, k)
        sets = []
        for i in range(high - low):
            a, b = wb[i], wb[i + 1]
            if b - a >= k:
                found = np.sort(grams[a : b - k + 1])
                found = found[np.concatenate([[True], found[1:] != found[:-1]])]
            elif b > a:
                found = tb.windows(wh[a:b], int(b - a)) + np.uint64(b - a)
            else:
                found = np.zeros(0, np.uint64)
            sets.append(found)
        yield low, sets


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit digest of each set, its members' sum."""
    return np.array([int(s.sum(dtype=np.uint64)) for s in sets], np.uint64)


def _facts(df: DataFrame, k: int, frequent: float) -> DataFrame:
    """A row per document (kind 0) and a row per shingle that is frequent within a part of the input (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = []
            for low, sets in shingle_sets(batch.column(1), k):
                n = np.array([len(s) for s in sets], np.int64)
                d1 = digests(sets)
                d2 = np.array([int(tb.mix(s).sum(dtype=np.uint64)) for s in sets], np.uint64)
                maps = []
                for s in sets:
                    parity = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=BITS) & 1
                    maps.append(np.packbits(parity.astype(np.uint8)).tobytes())
                ids = batch.column(0).slice(low, len(sets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(sets), np.int8)), ids, pa.array(n), pa.array(_signed(d1)), pa.array(_signed(d2)), pa.array(maps, pa.binary())],
                    ["kind", "doc_id", "n", "d1", "d2", "bits"],
                )
                every.append(np.concatenate([np.zeros(0, np.uint64), *sets]))
            shingles = np.sort(np.concatenate([np.zeros(0, np.uint64), *every]))
            at = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]])) if len(shingles) else np.zeros(0, np.int64)
            counts = np.diff(np.append(at, len(shingles)))
            often = counts >= max(3, frequent * len(batch))
            m = int(often.sum())
            if m:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(m, np.int8)), pa.nulls(m, batch.schema.field(0).type), pa.array(counts[often]), pa.array(_signed(shingles[at[often]])), pa.array(np.zeros(m, np.int64)), pa.nulls(m, pa.binary())],
                    ["kind", "doc_id", "n", "d1", "d2", "bits"],
                )

    kind = df.schema[0].dataType.simpleString()
    return df.mapInArrow(run, f"kind tinyint, doc_id {kind}, n long, d1 long, d2 long, bits binary")


def needed(n: int, percent: int) -> int:
    """The fewest shingles that a set of ``n`` shares with any set it links with."""
    return -(-n * percent // 100)


def boundary(sizes: list[tuple[int, int]], scan: float, percent: int) -> int:
    """The set size up to which 2-subsets cost least, a posting costing 1 and scanning it in its list ``scan``."""
    best, cost, least = 1, 0.0, 0.0
    for n, count in sorted(sizes):
        p = n - needed(n, percent)
        cost += count * ((p + 2) * (p + 1) / 2 - (p + 1) * (1 + scan))
        if cost < least:
            best, least = n, cost
    return best


def _postings(df: DataFrame, k: int, percent: int, order: tuple[np.ndarray, np.ndarray], light: int) -> DataFrame:
    """(token, doc, digest) of every set; of equal sets that meet in a block only the smallest id's."""
    sent = df.sparkSession.sparkContext.broadcast(order)
    near_light = light * percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = sent.value
        for batch in batches:
            for low, sets in shingle_sets(batch.column(1), k):
                tokens, rows, taken = [], [], set()
                ids, digest = batch.column(0).slice(low, len(sets)), digests(sets)
                for i in sorted(range(len(sets)), key=ids.to_pylist().__getitem__):
                    s = sets[i]
                    n = len(s)
                    if n < 2 or (n, digest[i]) in taken:
                        continue
                    taken.add((n, digest[i]))
                    p = n - needed(n, percent) + 1
                    if len(keys):
                        at = np.searchsorted(keys, s)
                        at[at == len(keys)] = 0
                        late = keys[at] == s
                        early = s[~late]
                        if len(early) < p + 1:
                            tail = s[late]
                            early = np.concatenate([early, tail[np.argsort(ranks[at[late]], kind="stable")]])
                    else:
                        early = s
                    if n <= light:
                        head = early[: p + 1]
                        x, y = np.triu_indices(len(head), 1)
                        low_of, high_of = np.minimum(head[x], head[y]), np.maximum(head[x], head[y])
                        own = tb.mix(low_of * np.uint64(0x9E3779B97F4A7C15) + high_of)
                        if n >= near_light:
                            own = np.concatenate([own, tb.mix(early[:p])])
                    else:
                        own = tb.mix(early[:p])
                    tokens.append(own)
                    rows.append(np.full(len(own), i))
                if tokens:
                    take = np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_signed(np.concatenate(tokens))), ids.take(pa.array(take)), pa.array(_signed(digest[take]))],
                        ["token", "doc", "digest"],
                    )

    return df.mapInArrow(run, f"token long, doc {df.schema[0].dataType.simpleString()}, digest long")


def _by_bitmap(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose bitmaps differ in more places than a link's symmetric difference allows."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("bits").alias("x"), F.col("n").alias("na"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("bits").alias("y"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b")
    words = [
        F.bit_count(F.conv(F.substring(F.hex("x"), 8 * i + 1, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(F.hex("y"), 8 * i + 1, 8), 16, 10).cast("long")))
        for i in range(BITS // 32)
    ]
    differ = sum(words[1:], words[0])
    # |A ^ B| = |A| + |B| - 2 overlap, and overlap >= percent / (100 + percent) * (|A| + |B|)
    return both.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))).select("a", "b")


def _across(percent: int):
    """Pairs of a list's blocks (x with y, or within x) from different groups whose sizes and bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).type.value_type.field("doc").type
            left, right = [], []
            for i in range(len(batch)):
                sides = []
                for block in (c[i].values for c in batch.columns if c[i].is_valid):
                    bits = np.frombuffer(b"".join(block.field("bits").to_pylist()), np.uint64).reshape(len(block), -1)
                    sides.append((*(block.field(name).to_numpy(zero_copy_only=False) for name in ("doc", "component")), block.field("n").to_numpy().astype(np.int64), bits))
                (d1, c1, n1, b1), (d2, c2, n2, b2) = sides[0], sides[-1]
                small, large = np.minimum(n1[:, None], n2[None, :]), np.maximum(n1[:, None], n2[None, :])
                p, q = np.nonzero((c1[:, None] != c2[None, :]) & (100 * small >= percent * large))
                if len(sides) == 1:
                    p, q = p[p < q], q[p < q]
                differ = np.bitwise_count(b1[p] ^ b2[q]).sum(axis=1, dtype=np.int64)
                good = differ * (100 + percent) <= (n1[p] + n2[q]) * (100 - percent)
                left.append(np.minimum(d1[p[good]], d2[q[good]]))
                right.append(np.maximum(d1[p[good]], d2[q[good]]))
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left), kind), pa.array(np.concatenate(right), kind)], ["a", "b"])

    return run


def _parity(s: np.ndarray) -> bytes:
    """A bitmap of one to two bits per member (512 at least), the parity of the members of each place."""
    width = 1 << max(9, int(len(s) - 1).bit_length())
    place = (s >> np.uint64(64 - (width.bit_length() - 1))).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=width) & 1).astype(np.uint8)).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, by their bitmaps; the wider is folded."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) > len(q):
        p, q = q, p
    if len(q) > len(p):
        # Places are leading bits, so the places that meet in one place of the narrower map are neighbours.
        bits = np.unpackbits(q).reshape(len(p) * 8, -1)
        q = np.packbits(np.bitwise_xor.reduce(bits, axis=1))
    return int(np.bitwise_count(p ^ q).sum())


def _verify(pairs: DataFrame, source: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that do link, by wide bitmaps and then the whole sets; ``pairs`` is a written table."""

    def of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        return rows.join(F.broadcast(ids) if pairs.count() * 2 <= BROADCAST_IDS else ids, "doc_id", "left_semi")

    every = cut(_sets(of(source, pairs), k))
    kind = pairs.schema["a"].dataType.simpleString()

    def both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
        left = sets.select(F.col("doc_id").alias("a"), F.col(column).alias("x"), F.size("s").alias("n"))
        right = sets.select(F.col("doc_id").alias("b"), F.col(column).alias("y"), F.size("s").alias("m"))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "n", "m")

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            total = batch.column(4).to_numpy().astype(np.int64) + batch.column(5).to_numpy()
            differ = np.array([_differ(x[i].as_py(), y[i].as_py()) for i in range(len(batch))], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(differ * (100 + percent) <= total * (100 - percent)))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            x, y = batch.column(2), batch.column(3)
            for i in range(len(batch)):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                merged = np.sort(np.concatenate([p, q]))
                common = int((merged[1:] == merged[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    left = cut(both(pairs, every, "parity").mapInArrow(able, f"a {kind}, b {kind}").distinct())
    return both(left, of(every, left), "s").mapInArrow(exact, f"a {kind}, b {kind}").distinct()


def near_groups(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, k: int = 5, percent: int = 80, frequent: float = 5e-5
) -> DataFrame:
    """(key, n_shingles, component_id) for every row: the size of its set and the smallest key it reaches by links."""
    source = df.select(df[key].alias("doc_id"), df[text].alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    facts = cut(_facts(source, k, frequent))
    docs = facts.where("kind = 0").select("doc_id", "n", "d1", "d2", "bits")
    known = docs.where("n > 0 and doc_id is not null")
    # Written first, so that the join below is one of two plain exchanges and a hot class is split.
    classes = cut(known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("times")).where("times > 1").drop("times"))
    member = cut(known.join(classes, ["n", "d1", "d2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n", "bits"))
    same = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    # An id may have several rows and sets: it is one node, which stands for each class that has it as smallest id.
    reps = member.where("doc_id = rep").select("doc_id", "n", "bits").distinct()

    often = facts.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("count"))
    rows, shingles = docs.agg(F.count("*"), F.sum("n")).first()
    found = np.array(
        [tuple(r) for r in often.where(F.col("count") >= max(16, frequent * (rows or 0))).toLocalIterator()], np.int64
    ).reshape(-1, 2)
    keys = found[:, 0].view(np.uint64) if len(found) else np.zeros(0, np.uint64)
    by = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[np.lexsort((keys, found[:, 1]))] = np.arange(len(keys))
    sizes = [(int(n), int(c)) for n, c in reps.groupBy(F.least("n", F.lit(1000))).count().collect()]
    # An entry of a list meets one pivot; a share of them, about that of frequent shingles, is then verified.
    scan = 1 + VERIFY_COST * float(found[:, 1].sum()) / max(1, shingles or 0)
    light = boundary(sizes, scan, percent)

    postings = _postings(source.where("doc_id is not null"), k, percent, (keys[by], rank[by]), light)
    token = Window.partitionBy("token")
    # One exchange by token: lists of one class go, then a class's copies other than its smallest id.
    spread = postings.withColumn("low", F.min("digest").over(token)).withColumn("high", F.max("digest").over(token)).where("low < high")
    head = F.min("doc").over(Window.partitionBy("token", "digest"))
    shared = cut(
        spread.withColumn("head", head).where("doc = head").withColumn("pivot", F.min("doc").over(token)).select("token", "doc", "pivot").distinct()
    )
    best = (
        shared.where("doc <> pivot").groupBy("doc", "pivot").count()
        .groupBy("doc").agg(F.max_by("pivot", F.struct(F.col("count"), -F.col("pivot"))).alias("pivot"))
    )
    first = cut(_by_bitmap(best.select(F.col("doc").alias("a"), F.col("pivot").alias("b")), reps, percent))
    links = cut(_verify(first, source, k, percent))
    groups = components(links)
    nodes = reps.select(F.col("doc_id").alias("doc")).distinct().join(groups.withColumnRenamed("id", "doc"), "doc", "left")
    labelled = shared.join(nodes.withColumn("component", F.coalesce("component", "doc")), "doc")
    mixed = (
        labelled.withColumn("lowest", F.min("component").over(token)).withColumn("highest", F.max("component").over(token)).withColumn("entries", F.count("*").over(token))
        .where("lowest < highest").select("token", "component", "doc", "entries")
    )
    # Documents that share one token share many: equal lists are compared once.  Longer ones go in blocks.
    short = cut(mixed.where(F.col("entries") <= CHUNK).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("component", "doc"))).alias("x")).select("x").distinct())
    bitmaps = reps.select(F.col("doc_id").alias("doc"), "n", "bits")
    entry = F.struct("doc", "component", "n", "bits")
    # Lists are numbered before they are exploded: in one select the number would be each element's own.
    once = (
        short.withColumn("list", F.monotonically_increasing_id()).select("list", F.explode("x").alias("e")).select("list", "e.*").join(bitmaps, "doc")
        .groupBy("list").agg(F.collect_list(entry).alias("x"))
    )
    chunk = F.floor((F.row_number().over(Window.partitionBy("token").orderBy("component", "doc")) - 1) / CHUNK)
    blocks = mixed.where(F.col("entries") > CHUNK).join(bitmaps, "doc").withColumn("chunk", chunk).groupBy("token", "chunk").agg(F.collect_list(entry).alias("x"))
    others = blocks.select("token", F.col("chunk").alias("chunk2"), F.col("x").alias("y"))
    facing = blocks.join(others, "token").where("chunk <= chunk2").select("x", F.when(F.col("chunk") < F.col("chunk2"), F.col("y")).alias("y"))
    across = once.select("x", F.lit(None).cast(facing.schema["y"].dataType).alias("y")).union(facing).mapInArrow(_across(percent), f"a {kind}, b {kind}").distinct()
    second = _verify(cut(across), source, k, percent)
    every = links.union(second).union(same)
    labels = components(every)
    return (
        docs.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
    )


def _sets(df: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, sets in shingle_sets(batch.column(1), k):
                ends = np.cumsum([0, *map(len, sets)])
                values = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_signed(np.concatenate(sets))))
                maps = pa.array([_parity(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(sets)), values, maps], ["doc_id", "s", "parity"])

    return df.mapInArrow(run, f"doc_id {df.schema[0].dataType.simpleString()}, s array<long>, parity binary")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that stand for their group (smallest key); rows with a null key stay."""
    groups = near_groups(df, key, text, **options)
    gone = groups.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("gone")).distinct()
    return df.join(gone, df[key] == gone["gone"], "left_anti")
