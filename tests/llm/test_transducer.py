"""Counts of the compiled transducer against the public library's encoding."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wearline.llm import transducer
from wearline.llm.queries import QUERIES, word_tokenizer

DATA = "/root/testdata/sf0.001"
ODD = [*"abcdefghijstremvlldABCSTRE 0123'''  \n\t.,;!?<|>_-/éÉñüßİſǅΣσς日本語½①̸́​\x00\x01\x85\xa0ﬁ한", "<|endoftext|>", "<|startoftext|>", "'re", "'s", "'LL", "é", "Å", "\U0001f600"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(word_tokenizer())
    return lambda texts: [len(e.ids) for e in known.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def rules():
    with open(word_tokenizer(), encoding="utf-8") as file:
        return transducer.Rules.read(file.read())


@pytest.fixture(scope="module")
def counter(rules):
    return transducer.Counter(rules)


def test_random_texts(counter, library):
    rnd = random.Random(0)
    texts = [None, "", " ", *("".join(rnd.choices(ODD, k=rnd.randrange(1, 60))) for _ in range(5000))]
    texts += ["".join(rnd.choices("etaoinshrdlu", k=rnd.randrange(1, 40))) for _ in range(3000)]
    assert counter.counts(texts).tolist() == library(texts)


def test_long_units_and_texts(counter, library, monkeypatch):
    rnd = random.Random(1)
    texts = ["a" * 3000 + "b'sx " * 10, "".join(rnd.choices("abc", k=50_000)), "日本" * 5000, "<|endoftext|>".join(["one two"] * 300), "x"]
    want = library(texts)
    assert counter.counts(texts).tolist() == want
    monkeypatch.setattr(transducer, "BLOCK", 100)  # every text in many pieces
    assert counter.counts(texts).tolist() == want


def test_chunks_may_be_cut_anywhere(counter):
    rnd = random.Random(2)
    data = np.array(rnd.choices(range(97, 109), k=2000), np.uint8)
    starts = np.array([rnd.random() < 0.05 for _ in data])
    starts[0], starts[700:1200] = True, False  # many chunks without a start
    want = transducer.emitted(counter.machine, data, starts, 5000)
    for chunk in (1, 3, 64):
        assert (transducer.emitted(counter.machine, data, starts, chunk) == want).all()
    assert len(transducer.emitted(counter.machine, data[:0], starts[:0])) == 0


def test_forgetting_states_changes_nothing(rules, library, monkeypatch):
    monkeypatch.setattr(transducer, "MOST_STATES", 50)
    monkeypatch.setattr(transducer, "BLOCK", 200)
    texts = [f"tokens of sentence {i} are countable again" for i in range(200)]
    small = transducer.Counter(rules)
    assert small.counts(texts).tolist() == library(texts) and small.machine.size < 500


def test_other_tokenizers_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file, pytest.raises(ValueError):
        transducer.Rules.read(file.read())


def test_rows_of_a_table(spark, library):
    rows = [(1, None), (2, ""), (3, "It's 12 o'clock"), (3, "It's 12 o'clock"), (None, "word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("old"), "other": F.array(F.lit(1))}).repartition(3)
    got = transducer.count_tokens(df, word_tokenizer())
    assert got.columns == ["doc_id", "text", "other", "n_tokens"]
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got.collect()) == sorted((str(k), n) for (k, _), n in zip(rows, library([t for _, t in rows]), strict=True))
    assert transducer.count_tokens(df.where("doc_id > 9"), word_tokenizer()).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: n for r, n in zip(docs, library([r["text"] for r in docs]), strict=True)}
    got = QUERIES["op12_token_counts"](spark, DATA).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(docs)
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in docs}
    assert all(r["n_bytes"] == size[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 2048) for r in got) and any(r["over_limit"] for r in got)
