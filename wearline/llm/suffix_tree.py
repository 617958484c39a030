"""Language-model scoring by a probabilistic suffix tree over the bytes of normalised texts.

A text is its words, A-Z lowered, with one space between them and an end symbol behind; symbols
are bytes, contexts the up to ``depth`` symbols before.  A context of the training texts becomes a
state if its shorter context is one, if it makes up ``least`` or more of all symbols, and if its
next symbols diverge from its parent's: the log-likelihood ratio ``sum c * ln(p / p_parent)`` must
reach ``divergence`` for each symbol that follows it.  A state's distribution is smoothed by
absolute discounting towards its parent's, the root's towards the uniform one, so probabilities
sum to 1 in every state.  A symbol is scored in the longest suffix of its history that is a state.

Counts cover all training texts: each task counts its distinct runs of depth + 1 symbols, Spark
sums them.  Contexts below ``least`` can't be states, so what is collected and broadcast is at
most ``depth / least`` contexts with up to 256 next symbols each, however large the corpus: the
word counts of the base grow with the corpus, the tree's size stops at that bound.

The base score is a word unigram model with one added to each count.  Words that make up
``head`` or more of the training tokens (at most 1 / head of them) are broadcast; the others'
counts are joined to the texts by a shuffle, and sums per text come back.

Defined cases: null, empty and blank texts have one token, the end; rows with equal or null ids
are scored each for itself, a null id being neither held out nor different otherwise; without any
training text all counts are 0 and the tree is the uniform distribution; other columns may have
any names; an empty table gives an empty result; texts are scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.llm import textblocks as tb
from wearline.llm.session import cut

START, SPACE, END = 0x0A, 0x20, 0x0D
DISCOUNT = 0.7


def stream(data: np.ndarray, offsets: np.ndarray, ws: np.ndarray, we: np.ndarray, wb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all documents and each document's first one (one more entry than documents)."""
    n = np.diff(wb)
    length = we - ws
    ends = np.concatenate([[0], np.cumsum(length + 1)])
    sizes = ends[wb[1:]] - ends[wb[:-1]] + (n == 0)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(bounds[-1], SPACE, np.uint8)
    doc = np.repeat(np.arange(len(n)), n)
    place = ends[:-1] + (bounds[:-1] - ends[wb[:-1]])[doc]
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(place, length) + inner] = data[np.repeat(ws, length) + inner]
    out[bounds[1:] - 1] = END
    return out, bounds


def grams(symbols: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """Each symbol (lowest byte) with the ``depth`` symbols before it."""
    before = np.concatenate([np.full(depth, START, np.uint8), symbols])
    at = np.arange(len(symbols)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = symbols.astype(np.uint64)
    for j in range(1, depth + 1):
        context = before[depth - j : depth - j + len(symbols)]
        out |= np.where(at < j, np.uint8(START), context).astype(np.uint64) << np.uint64(8 * j)
    return out


def held_out(ids: pa.Array, modulus: int, remainder: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i in ids.to_pylist()], bool)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([np.zeros(0, np.uint64), *keys])
    count = np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(key)
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def _counts(df: DataFrame, depth: int, modulus: int, remainder: int) -> DataFrame:
    """(kind, key, count) of the training texts: 0 words, 1 runs of symbols, 2 texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
        texts = waiting = 0
        for batch in batches:
            train = ~held_out(batch.column(0), modulus, remainder)
            data, offsets = tb.text_bytes(batch.column(1).filter(pa.array(train)))
            texts += int(train.sum())
            for low, high in tb.blocks(offsets):
                piece, own = tb.LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
                ws, we, wb = tb.words(piece, own)
                symbols, bounds = stream(piece, own, ws, we, wb)
                for kind, values in ((0, tb.hashes(piece, ws, we)), (1, grams(symbols, bounds, depth))):
                    key, count = np.unique(values, return_counts=True)
                    held[kind][0].append(key)
                    held[kind][1].append(count)
                    waiting += len(key)
                if waiting > 1_500_000:
                    for kind in (0, 1):
                        key, count = _merge(*held[kind])
                        held[kind] = ([key], [count])
                    waiting = 0
        for kind in (0, 1):
            key, count = _merge(*held[kind])
            for a in range(0, len(key), 100_000):
                part = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), kind, np.int8)), pa.array(key[part].view(np.int64)), pa.array(count[part])], ["kind", "key", "count"])
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int8()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "count"])

    return df.mapInArrow(run, "kind tinyint, key long, count long")


def grow(tables: list[tuple[np.ndarray, np.ndarray]], total: int, least: float, divergence: float) -> list[dict[str, np.ndarray]]:
    """The tree's levels from sorted (context, symbol) keys and counts of each depth.

    A level has its states, the weight each gives its parent, and its states' pairs with their probabilities.
    """
    levels: list[dict[str, np.ndarray]] = []
    for k, (pair, c) in enumerate(tables):
        context, owner = np.unique(pair >> np.uint64(8), return_inverse=True)
        sums = np.bincount(owner, weights=c, minlength=len(context))
        kinds = np.bincount(owner, minlength=len(context))
        state = sums >= least * total
        if k:
            state &= _holds(levels[-1]["context"], context & np.uint64((1 << 8 * (k - 1)) - 1))
        parent = probability(pair, levels)
        if k:
            ratio = np.bincount(owner, weights=c * np.log(c / sums[owner] / parent), minlength=len(context))
            state &= ratio >= divergence * kinds
        own = state[owner]
        weight = DISCOUNT * kinds / sums
        p = np.maximum(c - DISCOUNT, 0) / sums[owner] + weight[owner] * parent
        levels.append({"context": context[state], "back": weight[state], "pair": pair[own], "p": p[own]})
    return levels


def _holds(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def probability(gram: np.ndarray, levels: list[dict[str, np.ndarray]]) -> np.ndarray:
    """The probability of each run's last symbol in the longest state that ends its context."""
    p = np.full(len(gram), 1 / 256)
    for k, level in enumerate(levels):
        if not len(level["context"]):
            continue
        context = (gram >> np.uint64(8)) & np.uint64((1 << 8 * k) - 1)
        at = np.minimum(np.searchsorted(level["context"], context), len(level["context"]) - 1)
        state = level["context"][at] == context
        pair = gram & np.uint64((1 << 8 * (k + 1)) - 1)
        to = np.minimum(np.searchsorted(level["pair"], pair), len(level["pair"]) - 1)
        p = np.where(state, np.where(level["pair"][to] == pair, level["p"][to], level["back"][at] * p), p)
    return p


def _scores(df: DataFrame, levels: list, head: tuple[np.ndarray, np.ndarray], facts: dict, depth: int, modulus: int, remainder: int) -> DataFrame:
    """A row per text with what its task knows, and a row per rarer word of a text."""
    sent = df.sparkSession.sparkContext.broadcast((levels, head))
    ids = df.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, (words, counts) = sent.value
        room = facts["tokens"] + facts["kinds"] + 1
        gain = np.log10((counts + 1) / room)
        end = np.log10((facts["texts"] + 1) / room)
        for batch in batches:
            held = held_out(batch.column(1), modulus, remainder)
            data, offsets = tb.text_bytes(batch.column(2))
            for low, high in tb.blocks(offsets):
                piece, own = tb.LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]
                ws, we, wb = tb.words(piece, own)
                symbols, bounds = stream(piece, own, ws, we, wb)
                gram, inverse = np.unique(grams(symbols, bounds, depth), return_inverse=True)
                score = np.add.reduceat(np.log10(probability(gram, tree))[inverse], bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
                h = tb.hashes(piece, ws, we)
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                common = words[at] == h if len(words) else np.zeros(len(h), bool)
                sums = np.concatenate([[0.0], np.cumsum(np.where(common, gain[at] if len(words) else 0.0, 0.0))])
                known = tb.per_document(common, wb)
                n = high - low
                rows = batch.column(0).slice(low, n)
                info = pa.StructArray.from_arrays(
                    [batch.column(1).slice(low, n), pa.array(held[low:high]), pa.array(np.diff(wb) + 1), pa.array(score)],
                    ["id", "held_out", "n_tokens", "score"],
                )
                yield pa.RecordBatch.from_arrays(
                    [rows, pa.array(tb.mix(rows.to_numpy().astype(np.uint64)).view(np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(known + (facts["texts"] > 0)), pa.array(sums[wb[1:]] - sums[wb[:-1]] + end), info],
                    ["row", "key", "times", "n_known", "base", "info"],
                )
                doc = np.repeat(np.arange(n), np.diff(wb))[~common]
                rare = h[~common]
                order = np.lexsort((rare, doc))
                doc, rare = doc[order], rare[order]
                first = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1]))) if len(rare) else np.zeros(0, np.int64)
                times = np.diff(np.append(first, len(rare)))
                m = len(first)
                yield pa.RecordBatch.from_arrays(
                    [rows.take(pa.array(doc[first])), pa.array(rare[first].view(np.int64)), pa.array(times), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m)), pa.nulls(m, info.type)],
                    ["row", "key", "times", "n_known", "base", "info"],
                )

    info = f"struct<id: {ids.simpleString()}, held_out: boolean, n_tokens: bigint, score: double>"
    return df.mapInArrow(run, f"row long, key long, times long, n_known long, base double, info {info}")


def score_texts(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, modulus: int = 7, remainder: int = 2, depth: int = 6,
    least: float = 1e-6, divergence: float = 1.0, head: float = 1e-6,
) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; it learns from rows not held out.

    A row is held out if crc32 of its key as text leaves ``remainder`` divided by ``modulus``.
    """
    slim = df.select(df[key].alias("id"), df[text].alias("text"))
    counted = cut(_counts(slim, depth, modulus, remainder).groupBy("kind", "key").agg(F.sum("count").alias("count")))
    totals = {r["kind"]: (r["n"], r["total"]) for r in counted.groupBy("kind").agg(F.count("*").alias("n"), F.sum("count").alias("total")).collect()}
    texts = totals.get(2, (0, 0))[1] or 0
    kinds, tokens = totals.get(0, (0, 0))
    facts = {"texts": texts, "tokens": (tokens or 0) + texts, "kinds": kinds + (texts > 0)}
    words = counted.where("kind = 0").select("key", "count")

    def arrays(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        found = rows.toArrow()
        keys = found.column(0).to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return keys[order], found.column(1).to_numpy().astype(np.int64)[order]

    common = arrays(words.where(F.col("count") >= max(2, head * facts["tokens"])))
    runs = counted.where("kind = 1")
    symbols = totals.get(1, (0, 0))[1] or 0
    levels = grow(_tables(runs, symbols, depth, least, arrays), symbols, least, divergence)
    scored = _scores(slim.select(F.monotonically_increasing_id().alias("row"), "id", "text"), levels, common, facts, depth, modulus, remainder)
    rare = words.where(F.col("count") < max(2, head * facts["tokens"]))
    room = facts["tokens"] + facts["kinds"] + 1
    own = F.col("info").isNull()
    joined = scored.join(rare, "key", "left").select(
        "row", "info",
        F.when(own & F.col("count").isNotNull(), F.col("times")).otherwise(F.col("n_known")).alias("n_known"),
        F.when(own, F.col("times") * F.log10((F.coalesce("count", F.lit(0)) + 1) / F.lit(float(room)))).otherwise(F.col("base")).alias("base"),
    )
    return joined.groupBy("row").agg(F.max("info").alias("info"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score")).select(
        F.col("info.id").alias(key), F.col("info.held_out").alias("held_out"), F.col("info.n_tokens").alias("n_tokens"), F.col("n_known"),
        F.lit(facts["tokens"]).cast("long").alias("train_tokens"), F.col("base_score"), F.col("info.score").alias("score"),
    )


def _tables(runs: DataFrame, symbols: int, depth: int, least: float, arrays) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each depth the pairs whose context makes up ``least`` or more of all symbols."""
    tables, level = [], runs.select("key", "count")
    for k in range(depth, -1, -1):
        within = Window.partitionBy(F.shiftrightunsigned("key", 8))
        tables.append(arrays(level.withColumn("all", F.sum("count").over(within)).where(F.col("all") >= least * symbols).select("key", "count")))
        if k:
            level = level.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("key")).agg(F.sum("count").alias("count"))
            level = cut(level) if k == depth else level
    return tables[::-1]
