"""Line-first cleaning: rules per line, failed lines removed, documents that lose too much rejected.

Rules for a line with words (a line fails by the first that holds):

* duplicate: equal to an earlier line of the same document;
* navigation: at least three words of which a quarter are bare separators (``| > / - · • » ›``);
* symbols: more than ``max_symbols_per_word`` of ``#*$%&|<>`` per word;
* capitals: at least ten ASCII capitals and more capitals than small letters;
* punctuation: at least ``long_line`` words and no ``. ! ? : ;`` that ends a word;
* boilerplate: under 30 words with one of the phrases in ``BOILERPLATE``.

A document is rejected when it fails the base rule (under ``min_words`` words, or over half of
its words inside repeated three-word windows) or when over ``max_lost`` of its words were on
failed lines.  Lines without words are neither judged nor counted.  Everything is decided within
a document, so the work is one narrow pass: no shuffle, no skew.

Defined cases: a null or empty text has zero counts and fails the base rule; nulls in other
columns, ties, repeated rows and extra columns do not matter; an empty table gives an empty
result; a text of any length is judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wearline.llm import textblocks as tb

# Phrases of boilerplate lines, lower case.
BOILERPLATE = (
    b"all rights reserved", b"terms of", b"privacy policy", b"cookie", b"subscribe", b"sign up", b"log in",
    b"click here", b"read more", b"copyright", b"license", b"javascript",
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True
_BARE = np.zeros(256, bool)
_BARE[list(b"|>/-")] = True
_BARE_LONG = ("»", "›", "·", "•")

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_lines long, n_failed_lines long, lost_words long, kept boolean, clean_text string"
)


def _repeated_in_document(keys: np.ndarray, later_only: bool) -> np.ndarray:
    """True where a key occurs twice or more; with ``later_only`` the first occurrence stays False."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    if len(keys):
        equal = keys[order[1:]] == keys[order[:-1]]
        same[order[1:]] = equal
        if not later_only:
            same[order[:-1]] |= equal
    return same


def _judge(data: np.ndarray, offsets: np.ndarray, rules: dict) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    ws, we, wb = tb.words(data, offsets)
    ls, le, lb = tb.lines(data, offsets)
    n_words = np.diff(wb)
    owner = np.repeat(np.arange(n), n_words).astype(np.uint64)
    line_doc = np.repeat(np.arange(n), np.diff(lb)).astype(np.uint64)

    prefix = np.zeros(len(data) + 1, np.int64)
    def between(mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        np.cumsum(mask, out=prefix[1:])
        return prefix[high] - prefix[low]

    points = tb.code_points(data)
    word_chars = tb.per_document(between(points, ws, we), wb)
    symbol = _SYMBOL[data]
    n_symbols = between(symbol, offsets[:-1], offsets[1:])

    wh = tb.hashes(data, ws, we)
    covered = np.zeros(len(wh), bool)
    if len(wh) >= 3:
        inside = owner[2:] == owner[:-2]
        again = np.zeros(len(wh) - 2, bool)
        keys = tb.mix(tb.windows(wh, 3) + tb.mix(owner[2:] + np.uint64(1)))
        again[inside] = _repeated_in_document(keys[inside], later_only=False)
        for j in range(3):
            covered[j : len(wh) - 2 + j] |= again
    n_repeat = tb.per_document(covered, wb)

    line_words = np.searchsorted(ws, le) - np.searchsorted(ws, ls)
    real = line_words > 0
    duplicate = _repeated_in_document(tb.mix(tb.hashes(data, ls, le) + tb.mix(line_doc + np.uint64(1))), later_only=True) & real
    bare = np.zeros(len(ws), bool)
    single = we - ws == 1
    bare[single] = _BARE[data[ws[single]]]
    for mark in (m.encode() for m in _BARE_LONG):
        like = np.flatnonzero(we - ws == len(mark))
        hit = np.ones(len(like), bool)
        for j, byte in enumerate(mark):
            hit &= data[ws[like] + j] == byte
        bare[like[hit]] = True
    upto = np.concatenate([[0], np.cumsum(bare)])
    bare_words = upto[np.searchsorted(ws, le)] - upto[np.searchsorted(ws, ls)]
    capitals = between((data >= 65) & (data <= 90), ls, le)
    small = between((data >= 97) & (data <= 122), ls, le)
    closing = _STOP[data]
    closing[:-1] &= tb.SEPARATOR[data[1:]]
    if n:
        last = offsets[1:][np.diff(offsets) > 0] - 1
        closing[last] = _STOP[data[last]]
    stops = between(closing, ls, le)
    lowered = tb.LOWER[data].tobytes()
    phrase = np.zeros(len(ls), bool)
    for text in BOILERPLATE:
        at = lowered.find(text)
        while at >= 0:
            k = int(np.searchsorted(ls, at, side="right")) - 1
            phrase[k] |= at + len(text) <= le[k]
            at = lowered.find(text, at + 1)
    failed = real & (
        duplicate
        | ((line_words >= 3) & (4 * bare_words >= line_words))
        | (between(symbol, ls, le) > rules["max_symbols_per_word"] * line_words)
        | ((capitals >= 10) & (capitals > small))
        | ((line_words >= rules["long_line"]) & (stops == 0))
        | (phrase & (line_words < 30))
    )
    lost = tb.per_document(np.where(failed, line_words, 0), lb)
    base = (n_words < rules["min_words"]) | (100 * n_repeat > 50 * n_words)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": tb.per_document(duplicate, lb),
        "n_repeat_words": n_repeat, "base_failed": base, "n_lines": tb.per_document(real, lb),
        "n_failed_lines": tb.per_document(failed, lb), "lost_words": lost, "kept": ~base & (lost <= rules["max_lost"] * n_words),
        "_lines": (ls, le, lb, failed),
    }


def judge(column: pa.Array, rules: dict) -> tuple[dict[str, np.ndarray], pa.Array]:
    """The counts and verdict of each text of an Arrow column, and the texts without their failed lines."""
    data, offsets = tb.text_bytes(column)
    parts, texts = [], []
    for low, high in tb.blocks(offsets):
        piece, own = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        found = _judge(piece, own, rules)
        ls, le, lb, failed = found.pop("_lines")
        raw = piece.tobytes()
        for i in range(high - low):
            if found["n_failed_lines"][i]:
                texts.append(b"\n".join(raw[ls[k] : le[k]] for k in range(lb[i], lb[i + 1]) if not failed[k]))
            else:
                texts.append(raw[own[i] : own[i + 1]])
        parts.append(found)
    names = [x.split()[0] for x in RESULT.split(", ")[:-1]]
    kinds = {"base_failed": bool, "kept": bool}
    whole = {k: np.concatenate([np.zeros(0, kinds.get(k, np.int64)), *(p[k] for p in parts)]).astype(kinds.get(k, np.int64)) for k in names}
    return whole, pa.array(texts, pa.binary()).cast(pa.string())


def _rules(min_words: int, long_line: int, max_symbols_per_word: float, max_lost: float) -> dict:
    return {"min_words": min_words, "long_line": long_line, "max_symbols_per_word": max_symbols_per_word, "max_lost": max_lost}


def line_quality(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, min_words: int = 50, long_line: int = 20,
    max_symbols_per_word: float = 2.0, max_lost: float = 0.5,
) -> DataFrame:
    """One row per row of ``df``: its key, the counts, the verdict ``kept`` and the text without failed lines."""
    rules = _rules(min_words, long_line, max_symbols_per_word, max_lost)
    picked = df.select(df[key], df[text])
    kind = picked.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, clean = judge(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found.values()), clean], [key, *found, "clean_text"])

    return picked.mapInArrow(run, f"`{key}` {kind}, {RESULT}")


def keep_clean(df: DataFrame, text: str = "text", length: str | None = "n_chars", **rules) -> DataFrame:
    """The rows of ``df`` that are kept, all columns as they are but for the text without failed lines and its length."""
    limits = _rules(**({"min_words": 50, "long_line": 20, "max_symbols_per_word": 2.0, "max_lost": 0.5} | rules))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, clean = judge(batch.column(names.index(text)), limits)
            columns = list(batch.columns)
            columns[names.index(text)] = clean
            if length in names:
                counted = pa.compute.utf8_length(clean).cast(columns[names.index(length)].type)
                columns[names.index(length)] = counted
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(found["kept"]))

    return df.mapInArrow(run, df.schema)
