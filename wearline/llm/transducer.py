"""Token counts from a finite-state transducer that is compiled from a BPE tokenizer with word ends.

BPE has the property that every prefix of an encoding is the encoding of what it covers.  So the
encoding of the bytes read so far is known by its last token and the encoding before that token,
and the last token is the one dictionary suffix that may follow the token before it.  What the
future can depend on is therefore small: the longest suffix of the unit that begins some token (a
node of a suffix automaton) and, for each place at which such a token could begin, the last token
up to there and how many tokens ago that was.  These are the transducer's states.  A transition
reads one byte and carries the change of the number of tokens; a state has one more number for the
end of its unit, where the last byte takes the word-end mark.

The transducer is deterministic and made on demand: a transition is compiled when text first needs
it and kept in a hash table of arrays, so that thousands of states advance at once.

A block of text runs in chunks of equal size, cut anywhere.  From its first unit start on, a
chunk's state map is constant, so all chunks run at once from there; a prefix scan over the chunks
then gives each one's true entry state (the end state of the last chunk with a unit start, carried
through any chunks without one) and the chunks' heads are run from it, again all at once.

Normalisation and the cut into units follow the tokenizer's own file: composed characters, lower
case, contractions, runs of letters, single numbers, runs of other characters.  Which characters
are letters, numbers or white space, and their lower case, is asked from the public library once
per distinct character.

Defined cases: a null or empty text has no tokens; texts are counted whole (long ones in pieces cut
at white space); added special strings inside a text are one token each and break units, as the
library's default; repeated rows and ties have their own rows; an empty table has no rows; a column
that has the result's name is replaced, other columns are passed on.  Files of another kind of
tokenizer raise.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

#: Characters of text that run at once, bytes of a chunk, and states after which a worker compiles anew.
BLOCK = 1 << 20
CHUNK = 256
MOST_STATES = 400_000

END = 256
#: No count yet.
UNKNOWN = -32768
_SPREAD = np.int64(0x1E3779B97F4A7C15)
SPACE, LETTER, NUMBER, OTHER = 1, 2, 3, 4

# The one cut into units that is compiled.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SHORT_ENDS, LONG_ENDS = ("s", "t", "m", "d"), ("re", "ve", "ll")


def _byte_of() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


@dataclass
class Rules:
    """A tokenizer's vocabulary and merges over bytes (``END`` marks a word's end)."""

    ids: dict[tuple[int, ...], int]
    ranks: dict[tuple[int, int], tuple[int, int]]
    special: list[str]
    library: str

    @classmethod
    def read(cls, spec: str) -> Rules:
        """From the text of a tokenizer's JSON file."""
        whole = json.loads(spec)
        model, steps = whole["model"], [s.get("type") for s in (whole.get("normalizer") or {}).get("normalizers", [])]
        cuts = (whole.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        plain = all(not t[k] for t in whole["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        known = (
            model.get("type") == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") and not model.get("dropout")
            and not model.get("ignore_merges") and steps == ["NFC", "Replace", "Lowercase"] and cuts[0].get("pattern") == {"Regex": UNITS}
            and [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and not cuts[1].get("add_prefix_space") and plain
        )
        if not known:
            raise ValueError("only byte-level BPE tokenizers with word ends are compiled")
        byte, mark = _byte_of(), model["end_of_word_suffix"]

        def symbols(token: str) -> tuple[int, ...]:
            end = token.endswith(mark) and token != mark
            return (*(byte[c] for c in (token[: -len(mark)] if end else token)), *([END] if end else []))

        ids = {symbols(t): i for t, i in model["vocab"].items()}
        if any((b,) not in ids or (b, END) not in ids for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        ranks = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = (symbols(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            ranks[ids[a], ids[b]] = rank, ids[a + b]
        small = {**whole, "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}}
        return cls(ids, ranks, [t["content"] for t in whole["added_tokens"]], json.dumps(small))


@dataclass
class Characters:
    """Class and lower case of code points, asked from the library at first sight."""

    library: str
    kind: np.ndarray = field(default_factory=lambda: np.zeros(0x110000, np.uint8))
    lower: np.ndarray = field(default_factory=lambda: np.arange(0x110000, dtype=np.uint32))
    longer: dict[int, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        from tokenizers import Tokenizer, normalizers

        self._cut = Tokenizer.from_str(self.library).pre_tokenizer
        self.compose, self._lower = normalizers.NFC(), normalizers.Lowercase()

    def learn(self, points: np.ndarray) -> None:
        for p in np.unique(points[self.kind[points] == 0]).tolist():
            low = self._lower.normalize_str(chr(p))
            if len(low) != 1:
                self.longer[p] = low
                self.kind[p] = OTHER  # never used: such characters are replaced first
                continue
            self.lower[p] = ord(low)
            twice = len(self._cut.pre_tokenize_str(low + low))
            if twice == 1:
                self.kind[p] = LETTER if len(self._cut.pre_tokenize_str("a" + low)) == 1 else OTHER
            else:
                self.kind[p] = NUMBER if twice else SPACE


class Transducer:
    """States, transitions and their token counts, compiled on demand."""

    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        self._symbols = {i: s for s, i in rules.ids.items()}
        self._build_automaton()
        self._pairs: dict[int, bool] = {}
        self.reset()

    def _build_automaton(self) -> None:
        """Tries of all tokens with suffix links: per node its depth, the tokens that end there (longest first) and the depths of its suffixes."""
        child: list[dict[int, int]] = [{}]
        token, final, depth = [-1], [-1], [0]
        for symbols, i in self.rules.ids.items():
            node, closed = 0, symbols[-1] == END
            for b in symbols[: len(symbols) - closed]:
                if b not in child[node]:
                    child[node][b] = len(child)
                    child.append({})
                    token.append(-1)
                    final.append(-1)
                    depth.append(depth[node] + 1)
                node = child[node][b]
            (final if closed else token)[node] = i
        n = len(child)
        link, inner, outer, places = [0] * n, [()] * n, [()] * n, [(0,)] * n
        order = [0]
        for node in order:
            for b, c in child[node].items():
                order.append(c)
                f = link[node]
                while f and b not in child[f]:
                    f = link[f]
                link[c] = child[f].get(b, 0) if node else 0
                inner[c] = (((depth[c], token[c]),) if token[c] >= 0 else ()) + inner[link[c]]
                outer[c] = (((depth[c], final[c]),) if final[c] >= 0 else ()) + outer[link[c]]
                places[c] = (depth[c], *places[link[c]])
        self._child, self._link, self._inner, self._outer, self._places = child, link, inner, outer, places
        self._open = [bool(c) or f >= 0 for c, f in zip(child, final, strict=True)]

    def reset(self) -> None:
        """Forgets all states but the first, the start of a unit."""
        self._index: dict[bytes, int] = {}
        self._states: list[bytes] = []
        self._keys = np.full(1 << 16, -1, np.int64)
        self._next = np.zeros(1 << 16, np.int32)
        self._gain = np.zeros(1 << 16, np.int16)
        self._filled = 0
        self._ends = np.full(1 << 12, UNKNOWN, np.int16)
        self._state(0, (-1, 0))

    @property
    def size(self) -> int:
        return len(self._states)

    def _state(self, node: int, told: Sequence[int]) -> int:
        packed = struct.pack(f"{1 + len(told)}i", node, *told)
        i = self._index.get(packed)
        if i is None:
            i = self._index[packed] = len(self._states)
            self._states.append(packed)
        return i

    def _merged(self, tokens: list[int]) -> list[int]:
        """Plain BPE: the best-ranked neighbours first, the leftmost of equals."""
        ranks = self.rules.ranks
        while len(tokens) > 1:
            best = min(((ranks[p][0], j) for j, p in enumerate(zip(tokens, tokens[1:])) if p in ranks), default=None)
            if best is None:
                break
            j = best[1]
            tokens[j : j + 2] = [ranks[tokens[j], tokens[j + 1]][1]]
        return tokens

    def _single(self, t: int) -> list[int]:
        s, ids = self._symbols[t], self.rules.ids
        return [ids[(b,)] for b in s] if s[-1] != END else [*(ids[(b,)] for b in s[:-2]), ids[s[-2:]]]

    def _may_follow(self, before: int, t: int) -> bool:
        """Whether the encoding of the two tokens' bytes is these tokens (``before`` -1: of the one)."""
        key = (before + 1) << 32 | t
        if key not in self._pairs:
            if before < 0:
                self._pairs[key] = self._merged(self._single(t)) == [t]
            else:
                self._pairs[key] = self._may_follow(-1, t) and self._merged(self._single(before) + self._single(t)) == [before, t]
        return self._pairs[key]

    def _unpacked(self, i: int) -> tuple[int, dict[int, tuple[int, int]]]:
        """A state's node and, for each place (bytes back), the last token up to there and the count relative to now."""
        node, *told = struct.unpack(f"{len(self._states[i]) // 4}i", self._states[i])
        return node, {p: (told[2 * k], told[2 * k + 1]) for k, p in enumerate(self._places[node])}

    def _compile(self, i: int, b: int) -> tuple[int, int]:
        node, at = self._unpacked(i)
        f = node
        while f and b not in self._child[f]:
            f = self._link[f]
        reached = self._child[f].get(b, 0)
        last, gain = next((t, at[size - 1][1] + 1) for size, t in self._inner[reached] if self._may_follow(at[size - 1][0], t))
        while reached and not self._open[reached]:
            reached = self._link[reached]
        told: list[int] = []
        for p in self._places[reached]:
            told += (at[p - 1][0], at[p - 1][1] - gain) if p else (last, 0)
        return self._state(reached, told), gain

    def _compile_end(self, i: int) -> int:
        node, at = self._unpacked(i)
        return next(at[size][1] + 1 for size, t in self._outer[node] if self._may_follow(at[size][0], t))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The table's place of each key, or the empty one where it would go."""
        mask = len(self._keys) - 1
        at = (keys * _SPREAD >> 20) & mask  # products wrap
        wrong = np.flatnonzero((self._keys[at] != keys) & (self._keys[at] != -1))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & mask
            held = self._keys[at[wrong]]
            wrong = wrong[(held != keys[wrong]) & (held != -1)]
        return at

    def _put(self, keys: np.ndarray, following: np.ndarray, gains: np.ndarray) -> None:
        """Enters new distinct keys; the table is kept at most a third full."""
        while 3 * (self._filled + len(keys)) > len(self._keys):
            had = self._keys != -1
            keys, following, gains = (np.concatenate([old[had], new]) for old, new in ((self._keys, keys), (self._next, following), (self._gain, gains)))
            size = 2 * len(self._keys)
            self._keys, self._next, self._gain, self._filled = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16), 0
        while len(keys):
            at, mine = np.unique(self._slots(keys), return_index=True)
            self._keys[at], self._next[at], self._gain[at] = keys[mine], following[mine], gains[mine]
            self._filled += len(at)
            left = np.ones(len(keys), bool)
            left[mine] = False
            keys, following, gains = keys[left], following[left], gains[left]

    def advance(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and changes of the count."""
        keys = states.astype(np.int64) << 8 | data
        at = self._slots(keys)
        missing = self._keys[at] == -1
        if missing.any():
            new = np.unique(keys[missing])
            self._put(new, *np.array([self._compile(k >> 8, k & 255) for k in new.tolist()], np.int32).T)
            at = self._slots(keys)
        return self._next[at], self._gain[at]

    def finish(self, states: np.ndarray) -> np.ndarray:
        """Changes of the count at the end of a unit."""
        if self.size > len(self._ends):
            self._ends = np.concatenate([self._ends, np.full(2 * self.size - len(self._ends), UNKNOWN, np.int16)])
        for i in np.unique(states[self._ends[states] == UNKNOWN]).tolist():
            self._ends[i] = self._compile_end(i)
        return self._ends[states]


def emitted(machine: Transducer, data: np.ndarray, starts: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Changes of the token count at each byte; ``starts`` marks units' first bytes, the first byte being one.

    Their sum over a unit is its number of tokens.
    """
    n = len(data)
    out = np.zeros(n, np.int32)
    if not n:
        return out
    lanes = -(-n // chunk)
    ends = np.append(starts[1:], True)
    pad = lanes * chunk - n
    table = np.pad(data, (0, pad)).reshape(lanes, chunk).T.copy()
    opens, closes = (np.pad(x, (0, pad)).reshape(lanes, chunk).T.copy() for x in (starts, ends))
    first = np.where(opens.any(axis=0), opens.argmax(axis=0), chunk)
    last = np.full(lanes, chunk)
    last[-1] = chunk - pad
    state, flat = np.zeros(lanes, np.int32), np.arange(lanes) * chunk

    def run(own: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Advances the given chunks over their bytes from ``begin`` up to ``end``."""
        for j in range(int(begin.min(initial=chunk)), int(end.max(initial=0))):
            now = own[(begin <= j) & (j < end)]
            state[now[opens[j, now]]] = 0
            state[now], gain = machine.advance(state[now], table[j, now])
            stop = closes[j, now]
            if stop.any():
                gain = gain.astype(np.int32)
                gain[stop] += machine.finish(state[now[stop]])
            out[flat[now] + j] = gain

    every = np.arange(lanes)
    run(every, first, last)
    # Scan: a chunk with a start has a constant map, so its end state is known; those without are entered in their order after it.
    constant = np.maximum.accumulate(np.where(first < chunk, every, -1))
    away = every[1:] - constant[:-1]
    for distance in range(1, int(away.max(initial=0)) + 1):
        own = every[1:][(away == distance) & (first[1:] > 0)]
        kept = state[own].copy()
        state[own] = state[own - 1]
        run(own, np.zeros(len(own), np.int64), np.minimum(first[own], last[own]))
        closed = first[own] < chunk
        state[own[closed]] = kept[closed]
    return out


class Counter:
    """Counts of whole texts by one tokenizer."""

    def __init__(self, rules: Rules) -> None:
        self.machine, self.characters = Transducer(rules), Characters(rules.library)
        self._special = re.compile("|".join(map(re.escape, sorted(rules.special, key=len, reverse=True)))) if rules.special else None

    def counts(self, texts: Sequence[str | None]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        for owner, pieces in _blocks(texts):
            if self.machine.size > MOST_STATES:
                self.machine.reset()
            np.add.at(out, owner, self._block(pieces))
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        if self._special and self._special.search("\n".join(texts)):
            for i, t in enumerate(texts):
                texts[i], extra[i] = self._special.subn("\n", t)
        if not unicodedata.is_normalized("NFC", "\n".join(texts)):
            texts = [t if unicodedata.is_normalized("NFC", t) else self.characters.compose.normalize_str(t) for t in texts]
        points = self._points(texts)
        self.characters.learn(points)
        if self.characters.longer and np.isin(points, list(self.characters.longer)).any():
            texts = [t.translate(self.characters.longer) for t in texts]
            points = self._points(texts)
            self.characters.learn(points)
        points = self.characters.lower[points]
        self.characters.learn(points)
        kind = self.characters.kind[points]
        starts = _unit_starts(points, kind)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        solid = kind != SPACE
        before = np.concatenate([[0], np.cumsum(solid)])[np.minimum(bounds, len(points))]
        points, starts = points[solid], starts[solid]
        sizes = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
        place = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        marks = np.zeros(len(data), bool)
        marks[place[:-1][starts]] = True
        total = np.concatenate([[0], np.cumsum(emitted(self.machine, data, marks), dtype=np.int64)])[place[before]]
        return extra + np.diff(total)

    @staticmethod
    def _points(texts: list[str]) -> np.ndarray:
        return np.frombuffer("\n".join(texts).encode("utf-32-le"), "<u4")


def _blocks(texts: Sequence[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about ``BLOCK`` characters; longer ones in pieces cut before white space, which no unit or special string crosses."""
    owner, held, size = [], [], 0
    for i, text in enumerate(texts):
        low = 0
        while text and low < len(text):
            cut = re.compile(r"[ \t\n\r]").search(text, low + BLOCK) if len(text) - low > BLOCK else None
            high = cut.start() if cut else len(text)
            owner.append(i)
            held.append(text[low:high])
            size, low = size + high - low, high
            if size >= BLOCK:
                yield owner, held
                owner, held, size = [], [], 0
    if held:
        yield owner, held


def _unit_starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """True for the first character of each unit."""
    starts = kind != SPACE
    same = (kind[1:] == kind[:-1]) & (kind[1:] != NUMBER)
    starts[1:] &= ~same
    quote = (points == ord("'")) & starts
    at = np.flatnonzero(quote)
    wide = np.concatenate([points, np.zeros(2, points.dtype)])
    for endings in (SHORT_ENDS, LONG_ENDS):
        for end in endings:
            hit = at[np.all([wide[at + 1 + k] == ord(c) for k, c in enumerate(end)], axis=0)]
            starts[hit + 1] = False
            after = hit + 1 + len(end)
            after = after[after < len(points)]
            starts[after] = kind[after] != SPACE
    return starts


_counters: dict[str, Counter] = {}


def count_tokens(df: DataFrame, tokenizer: str, text: str = "text", result: str = "n_tokens") -> DataFrame:
    """Adds each text's number of tokens by the tokenizer in the given JSON file, read on the driver (a bounded vocabulary).

    Narrow: no shuffle.  Each Python worker compiles its own transducer, of about ``MOST_STATES`` states at most.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    name = hashlib.sha256(spec.encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(Rules.read(spec))
    rest = df.drop(result)
    column = rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _counters:
            _counters[name] = Counter(sent.value)
        for batch in batches:
            counts = _counters[name].counts(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], [*batch.schema.names, result])

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(result, LongType(), False)]))
