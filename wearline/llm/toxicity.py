"""Toxicity scores by votes of the nearest labelled examples under exact TF-IDF cosine.

Terms are words (A-Z lowered; runs of letters, digits and non-ASCII bytes) and the first 4, 5 and
6 bytes of longer words, so inflected forms meet.  The examples are at most ``max_examples``
labelled rows, taken by a hash of their id; rows of equal text and label are one example.  The
vocabulary is what the examples support: terms that are more frequent in toxic or in other ones
than chance allows, by a log-likelihood ratio of ``least_ratio``; for these counts alone near copies
(equal ``SKETCH`` smallest hashes of five words) count once, lest the words of one text that was
copied often look telling.  The cosine is that of the texts' TF-IDF vectors over this vocabulary.
Document frequencies come from all documents.  So vocabulary and index have a fixed bound and are
broadcast, and scoring is one narrow pass.

The index is inverted, in blocks of ``BLOCK`` examples with each term's largest weight per block.
A query's bounds per block are the sums of those; blocks are scored from the largest bound on
until the bound falls below the k-th neighbour, so the neighbours are exact, all ties of the last
included.  A neighbour's vote weighs its cosine; ``prior_weight`` votes of the examples' toxic
share calibrate few or distant neighbours.  ``evidence`` lists the ids of the nearest examples.

Defined cases: a document without a term of the vocabulary (an empty or null text too) gets the
calibrated toxic share of such examples; null labels and labels without a document are ignored,
of several labels for an id the largest counts; without examples every score is 0; rows with
equal ids are scored each for itself, a null id is not held out; ties of the last neighbour all
vote; other columns may have any names; an empty table gives an empty result; texts are scored
whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm import textblocks as tb
from wearline.llm.session import cut

BLOCK = 64
PREFIXES = (4, 5, 6)
SKETCH = 3
_TERM = np.zeros(256, bool)
_TERM[list(range(48, 58)) + list(range(97, 123)) + list(range(128, 256))] = True


def terms(piece: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, document numbers) of the words and then of each kind of prefix in a block of lowered texts."""
    ws, we, wb = tb.spans(piece, own, _TERM[piece])
    doc = np.repeat(np.arange(len(own) - 1), np.diff(wb))
    yield tb.hashes(piece, ws, we), doc
    for k in PREFIXES:
        long = we - ws > k
        yield tb.mix(tb.hashes(piece, ws[long], ws[long] + k) + np.uint64(k)), doc[long]


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = tb.text_bytes(column)
    for low, high in tb.blocks(offsets):
        yield low, high, tb.LOWER[data[offsets[low] : offsets[high]]], offsets[low : high + 1] - offsets[low]


def _copy_keys(df: DataFrame) -> DataFrame:
    """id, toxic and a key that near copies mostly share: the smallest hashes of five words in a row (of all, if fewer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for low, high, piece, own in _blocks(batch.column(2)):
                ws, we, wb = tb.spans(piece, own, _TERM[piece])
                h = tb.hashes(piece, ws, we)
                for i in range(high - low):
                    words = h[wb[i] : wb[i + 1]]
                    keys.append(",".join(map(str, np.unique(tb.windows(words, min(5, max(1, len(words)))))[:SKETCH])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.string())], ["id", "toxic", "copy"])

    return df.select("id", "toxic", "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, toxic int, copy string")


def _supports(df: DataFrame) -> DataFrame:
    """term, n (documents), t (toxic ones)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy().astype(np.int64)
            for low, high, piece, own in _blocks(batch.column(2)):
                h, doc = (np.concatenate(x) for x in zip(*terms(piece, own), strict=True))
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                once = np.append(True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]))[: len(h)]
                h, doc = h[once], doc[once]
                first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
                if len(first):
                    n = np.diff(np.append(first, len(h)))
                    t = np.add.reduceat(toxic[low:high][doc], first)
                    yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(n), pa.array(t)], ["term", "n", "t"])

    return df.select("id", "toxic", "text").mapInArrow(run, "term long, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def _found(piece: np.ndarray, own: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, terms (numbers in the vocabulary) and their counts, in order."""
    docs, found = [], []
    for h, doc in terms(piece, own):
        if len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = vocabulary[at] == h
            docs.append(doc[hit])
            found.append(at[hit])
    if not docs:
        return (np.zeros(0, np.int64),) * 3
    key = np.concatenate(docs).astype(np.int64) * len(vocabulary) + np.concatenate(found)
    key, count = np.unique(key, return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), count


def _frequencies(df: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for _, _, piece, own in _blocks(batch.column(0)):
                _, found, _ = _found(piece, own, sent.value)
                total += np.bincount(found, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["i", "n"])

    return df.select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))


def _vectors(df: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, piece, own in _blocks(batch.column(2)):
                doc, found, count = _found(piece, own, sent.value)
                bounds = np.searchsorted(doc, np.arange(high - low + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.ListArray.from_arrays(pa.array(bounds), pa.array(found)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(count))],
                    ["id", "toxic", "terms", "counts"],
                )

    return df.select("id", "toxic", "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, toxic int, terms array<long>, counts array<long>")


@dataclass
class Index:
    """Examples by vector, in blocks, with postings and block maxima by term."""

    vocabulary: np.ndarray
    idf: np.ndarray
    prior: float
    prior_weight: float
    k: int
    blank: float
    postings: dict[int, tuple[np.ndarray, np.ndarray]]
    maxima: dict[int, tuple[np.ndarray, np.ndarray]]
    size: np.ndarray
    toxic: np.ndarray
    first: list

    def weigh(self, found: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[found]
        return w / np.sqrt((w * w).sum())

    def nearest(self, found: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the nearest vectors that hold ``k`` examples or more, best first, with all ties."""
        blocks = -(-len(self.size) // BLOCK)
        bound = np.zeros(blocks)
        for t, w in zip(found.tolist(), weight.tolist(), strict=True):
            if t in self.maxima:
                at, most = self.maxima[t]
                bound[at] += w * most
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        score = np.zeros(len(self.size))
        done, step, ranked, floor = 0, 4, np.zeros(0, np.int64), 0.0
        while done < len(order) and bound[order[done]] + 1e-9 >= floor:
            chosen = np.zeros(blocks, bool)
            chosen[order[done : done + step]] = True
            for t, w in zip(found.tolist(), weight.tolist(), strict=True):
                if t in self.postings:
                    at, own = self.postings[t]
                    here = chosen[at // BLOCK]
                    score[at[here]] += w * own[here]
            done, step = done + step, step * 2
            seen = np.flatnonzero(score > 0)
            ranked = seen[np.argsort(-score[seen], kind="stable")]
            held = np.cumsum(self.size[ranked])
            last = int(np.searchsorted(held, self.k))
            floor = score[ranked[last]] if last < len(ranked) else 0.0
        near = ranked[score[ranked] >= floor - 1e-12]
        return near, score[near]

    def score(self, found: np.ndarray, count: np.ndarray) -> tuple[float, list]:
        if not len(found):
            return self.blank, []
        near, cosine = self.nearest(found, self.weigh(found, count))
        votes, total = float((cosine * self.toxic[near]).sum()), float((cosine * self.size[near]).sum())
        return (votes + self.prior_weight * self.prior) / (total + self.prior_weight), [self.first[i] for i in near[:5]]


def build(rows: list, vocabulary: np.ndarray, idf: np.ndarray, k: int, prior_weight: float) -> Index:
    labelled = np.array([r["toxic"] for r in rows], float)
    prior = float(labelled.mean()) if len(rows) else 0.0
    index = Index(vocabulary, idf, prior, prior_weight, k, prior, {}, {}, np.zeros(0), np.zeros(0), [])
    blank = [r["toxic"] for r in rows if not r["terms"]]
    index.blank = (sum(blank) + prior_weight * prior) / (len(blank) + prior_weight)
    groups: dict[tuple, list] = {}
    for r in sorted((r for r in rows if r["terms"]), key=lambda r: r["id"]):
        groups.setdefault((tuple(r["terms"]), tuple(r["counts"])), []).append(r)
    made = []
    for (found, count), own in groups.items():
        found = np.array(found)
        weight = index.weigh(found, np.array(count))
        made.append((int(found[np.argmax(weight)]), found, weight, own))
    made.sort(key=lambda m: (m[0], -float(m[2].max()), m[3][0]["id"]))
    index.size = np.array([len(m[3]) for m in made], float)
    index.toxic = np.array([sum(r["toxic"] for r in m[3]) for m in made], float)
    index.first = [m[3][0]["id"] for m in made]
    if made:
        term = np.concatenate([m[1] for m in made])
        weight = np.concatenate([m[2] for m in made])
        vector = np.repeat(np.arange(len(made)), [len(m[1]) for m in made])
        order = np.lexsort((vector, term))
        term, weight, vector = term[order], weight[order], vector[order]
        starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True):
            at, own = vector[a:b], weight[a:b]
            index.postings[int(term[a])] = (at, own)
            heads = np.flatnonzero(np.append(True, at[1:] // BLOCK != at[:-1] // BLOCK))
            index.maxima[int(term[a])] = (at[heads] // BLOCK, np.maximum.reduceat(own, heads))
    return index


def score_toxicity(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", *, modulus: int = 4, remainder: int = 2,
    threshold: float = 0.3, k: int = 25, max_examples: int = 20_000, least_ratio: float = 25.0, prior_weight: float = 1.0,
) -> DataFrame:
    """(key, held_out, score, predicted, evidence) per row of ``df``; it learns from labelled rows not held out.

    A row is held out if crc32 of its key as text leaves ``remainder`` divided by ``modulus``.
    """
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % modulus == remainder, F.lit(False))
    slim = df.select(df[key].alias("id"), df[text].alias("text"))
    marks = labels.select(labels[key].alias("id"), labels[label].cast("int").alias("toxic")).where("id is not null and toxic is not null").where(~held)
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    marks = marks.join(slim.select("id").distinct(), "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_examples)
    marks = cut(marks)
    # Bounded from here on: max_examples ids, and the rows that have them (each text once).
    examples = slim.join(F.broadcast(marks), "id").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("same"), "toxic").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id"))
    examples = cut(examples.select("id", "toxic", "text"))
    single = cut(_copy_keys(examples).groupBy("copy", "toxic").agg(F.min("id").alias("id")).select("id"))
    counted_once = examples.join(F.broadcast(single), "id", "left_semi")
    n, t = counted_once.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = t / n if n else 0.0

    def part(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(0.0)

    vocabulary = np.zeros(0, np.uint64)
    if 0 < t < n:
        ratio = 2 * (part(F.col("t"), F.col("n") * share) + part(F.col("n") - F.col("t"), F.col("n") * (1 - share)))
        strong = _supports(counted_once).where(ratio >= least_ratio).select("term").toArrow()
        vocabulary = np.sort(strong.column(0).to_numpy().astype(np.int64).view(np.uint64))
    counted = _frequencies(slim, vocabulary).collect() if len(vocabulary) else []
    df_of = np.zeros(len(vocabulary))
    for r in counted:
        df_of[r["i"]] = r["n"]
    documents = slim.count()
    idf = np.log((documents + 1) / (df_of + 1)) + 1
    rows = _vectors(examples, vocabulary).collect()
    sent = df.sparkSession.sparkContext.broadcast(build(rows, vocabulary, idf, k, prior_weight))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        known: dict[bytes, tuple[float, list]] = {}
        for batch in batches:
            for low, high, piece, own in _blocks(batch.column(2)):
                doc, found, count = _found(piece, own, index.vocabulary)
                bounds = np.searchsorted(doc, np.arange(high - low + 1))
                scores, evidence = np.full(high - low, index.blank), [[]] * (high - low)
                for i in np.flatnonzero(np.diff(bounds)):
                    f, c = found[bounds[i] : bounds[i + 1]], count[bounds[i] : bounds[i + 1]]
                    mark = f.tobytes() + c.tobytes()
                    if mark not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[mark] = index.score(f, c)
                    scores[i], evidence[i] = known[mark]
                m = high - low
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, m), batch.column(1).slice(low, m), pa.array(scores), pa.array((scores >= threshold).astype(np.int32)), pa.array(evidence, pa.list_(batch.schema.field(0).type))],
                    [key, "held_out", "score", "predicted", "evidence"],
                )

    return slim.select("id", held.alias("held_out"), "text").mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int, evidence array<{kind}>")
