"""A corpus from documents in five stages, each on all that the one before kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; ``run`` writes each result as Parquet to
the session's shared checkpoint folder and reads it again as the next stage's input.  All but the
last return the columns of ``documents``; the rows of the last one in the order of (slot,
offset_in_block) are the mix.

Defined cases: a null or empty text fails the quality rules, so its row goes; a null id is a
document of its own that links with nothing; of repeated rows one stays; ties of length or weight go by id; a null source is a source; an empty
table runs through all stages and gives no rows; texts are read whole; further columns of
``documents`` are carried on by the stages that keep its columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wearline.llm import mixing, near, pieces, quality, secrets
from wearline.llm.queries import piece_model
from wearline.llm.session import checkpoint_dir, cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops failed lines, then documents that lose too much or fail the base rule."""
    return quality.keep_clean(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group, that of the smallest id."""
    return near.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; keeps all documents."""
    return secrets.redact(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Brings all documents into the order of the mix."""
    return mixing.interleave(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's place in the mix, the piece ids, their number and whether they decode to the text again.

    Files have no order, so the mix is carried on as columns: (slot, offset_in_block) depends on
    the documents' ids, sources and lengths only, which are those of the stage before.
    """
    return pieces.encode(cut(mixing.with_slots(docs)), piece_model(), verify="round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("secret_scan", secret_scan),
    ("mix_to_weights", mix_to_weights),
    ("sentencepiece", sentencepiece),
]

#: The forest of the secret scan and the piece model can't be expressed in SQL; tests/llm/test_pipeline.py tests each stage on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
