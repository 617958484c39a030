"""The pipeline's result."""

import random

import corpus_pipeline
from wearline.llm import mixing


def test_result_carries_the_mix(spark, tmp_path):
    rng = random.Random(8)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(14)) + "."
    rows = [(i, "\n".join(line() for _ in range(60)), "en", "big" if i % 4 else "small", None) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    found = {r["doc_id"]: (r["slot"], r["offset_in_block"]) for r in out.select("doc_id", "slot", "offset_in_block").collect()}
    due = mixing.schedule(out.select("doc_id", "source", "text")).collect()
    assert len(found) == len(due) == len(rows) and len({r["slot"] for r in due}) > 8
    for r in due:
        assert found[r["doc_id"]] == (r["slot"], r["offset_in_block"]) and r["release"] <= found[r["doc_id"]][0] < r["deadline"]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_one_by_one(spark, tmp_path):
    """Each stage on its own input: rows, columns, nulls, repeated rows, columns of clashing names, empty tables."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    page = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(14)) + "." for _ in range(8))
    good = [page() for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(good)]
    rows += [(20, good[0], "en", None, 1), (21, good[1].replace(".", "!", 1), None, "s1", None), (22, "Home | About | Login\n" * 30, "en", "s0", 5), (23, None, None, None, None), (24, "", "en", "s0", 0), (None, good[2], "en", "s0", 3), (3, good[3], "en", "s1", 7)]
    rows += [(25, page() + f'\nSo the token = "{"ab12" * 10}" was given to them for a while and then it was lost.', "en", "s0", 9), (26, page() + "\n" + "Here is the key AKIA" + "Q7" * 8 + " that they had used on all of the machines.", "en", "s0", 9)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "secret_scan", "mix_to_weights", "sentencepiece"]
    clean = stages["quality_rules"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    kept = sorted((r["doc_id"] or 0 for r in clean.collect()))
    assert kept == sorted([0, *range(12), 3, 20, 21, 25, 26])
    one = stages["ngram_jaccard_join"](spark, clean, str(tmp_path))
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {None, *range(12), 25, 26}
    secret = stages["secret_scan"](spark, one, str(tmp_path))
    found = {r["doc_id"]: r for r in secret.collect()}
    assert secret.columns == docs.columns and set(found) == {None, *range(12), 25, 26}
    assert all(("[SECRET]" in r["text"]) == (i in (25, 26)) for i, r in found.items()) and found[26]["n_chars"] == len(found[26]["text"])
    mixed = stages["mix_to_weights"](spark, secret, str(tmp_path))
    assert mixed.columns == docs.columns and sorted(map(str, mixed.collect())) == sorted(map(str, secret.collect()))
    last = stages["sentencepiece"](spark, mixed, str(tmp_path))
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last.collect()) and last.count() == mixed.count()
    extra = docs.withColumns({"row": docs["doc_id"], "src": docs["lang"], "gone": docs["lang"], "component_id": docs["lang"], "key": docs["lang"], "ids": docs["lang"], "slot": docs["n_chars"], "score": docs["lang"]})
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, extra, str(tmp_path))
        assert set(docs.columns) <= set(made.columns) and made.count() > 0, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
