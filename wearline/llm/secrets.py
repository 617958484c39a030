"""Secret scan: candidates by one regular expression, false positives removed by a random forest.

DataFrame and SQL functions only.  A candidate is a private key block, a dotted token of a known
shape, whatever stands behind an assigned secret name (``NAMES``; ``least_named`` characters or
more), or a longest run of ``[A-Za-z0-9_+/-]`` with a digit (and up to two ``=`` behind it) of
``min_length`` characters or more.  Features are length, character classes and the 25 transitions
between them, distinct characters, coverage by a dictionary (the ``dictionary`` most frequent words
of the corpus itself, by documents), the path's flags and the words and marks next to it.

The forest learns from labelled findings (1 a secret, 0 none); ``max_findings`` distinct ones, taken
by hash within each label and weighted by how often they occur, bound the fit.  Without given
findings ``weak_labels`` labels candidates by evidence that is no feature: the secret name a value
is assigned to (features skip that name), its issuer's format, check digits, or surroundings of an
address.  What the rules don't tell, such as numbers without a check digit, has no label and is left to the forest.  The labels are noisy, so no finding is scored by a forest that learnt from its own value:
``FOLDS`` forests learn from the other folds' values each, and the forest's word is the result.
Only an issuer's format needs no forest.

Every step but the word counts, the fit and its sample is narrow; ``redact`` moves only rows that
hold a candidate.  Defined cases: null and empty texts have no candidate; without findings of both
kinds the labels themselves are the scores (unlabelled: 0); rows with equal or null keys are
scanned and redacted each for itself; other columns may have any names; an empty table gives an
empty result; texts are scanned whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.session import cut

NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?-?key|access_?-?key|private_?-?key|auth|credentials?|bearer)"
#: A secret name (its last part is enough), and the assignment, in front of a value.
NAMED = rf"(?i:{NAMES}[\w-]{{0,20}}[\"']?\s{{0,3}}(?:=>|=|:)\s{{0,3}}[\"']?)"
# The frame of a key block, and the shapes of dotted tokens.
BLOCKS = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"
DOTTED = r"\bSG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}|\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
RUN = r"(?<![A-Za-z0-9_+/-])[A-Za-z_+/-]*+[0-9][A-Za-z0-9_+/-]*+={0,2}"
# Formats of well-known issuers.
KNOWN = (
    r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abpr]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|"
    r"AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20}|npm_[0-9A-Za-z]{36}|SG\.[A-Za-z0-9_-]{16,32}\.[A-Za-z0-9_-]{16,64}|"
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*)=*$"
)
ASSIGNED = rf"{NAMED}$|(?i){NAMES}\s+[\"']?$"
FOLDS = 2
NEIGHBOURS = 16
CLASSES = "hludx"
# What a path says of samples, and of code and settings.
PATH_FLAGS = r"(?i)(?:^|[/_.-])(?:test|tests|example|examples|sample|samples|doc|docs|fixture|fixtures|mock|mocks)(?:[/_.-]|$)"
CODE_PATH = r"(?i)\.(?:py|js|ts|java|go|rb|php|sh|env|ini|cfg|conf|toml|ya?ml|json|xml|properties|tf)$"
CONTEXT = 48


def candidate(least_named: int) -> str:
    """The expression of all candidates; the name in front of a value is part of its match."""
    return rf"{BLOCKS}|{DOTTED}|{NAMED}[^\s\"',;<>]{{{least_named},}}|{RUN}"


def _long_enough(match: Column, min_length: int) -> Column:
    return (F.length(match) >= min_length) | match.rlike(f"^{NAMED}")


def dictionary(df: DataFrame, text: str = "text", size: int = 500) -> list[str]:
    """The ``size`` words of 4 to 12 letters that most texts hold (ties by the word), counted over all texts."""
    words = df.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(df[text]), F.lit("[a-z]{4,12}"), F.lit(0)))).alias("word"))
    return [r["word"] for r in words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).collect()]


def candidates(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", *, min_length: int = 12, least_named: int = 6
) -> DataFrame:
    """A row per candidate: key, path, start (code points from 0), value and the text to its left and right."""
    where, pattern = df[path].cast("string") if path else F.lit(None).cast("string"), candidate(least_named)
    scanned = df.select(df[key].alias("key"), where.alias("path"), df[text].alias("t")).select(
        "key", "path", F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("m"), "t"
    ).where(F.exists("m", lambda x: _long_enough(x, min_length)))
    parts = scanned.select("key", "path", "m", F.split("t", pattern, -1).alias("g"))
    before = F.aggregate(
        F.arrays_zip("m", "g"),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
        lambda acc, x: F.struct(
            (acc["n"] + F.length(x["m"]) + F.length(x["g"])).alias("n"),
            F.concat(acc["at"], F.array((acc["n"] + F.length(x["g"])).cast("int"))).alias("at"),
        ),
        lambda acc: acc["at"],
    )

    def one(i: Column) -> Column:
        match = F.get("m", i)
        name = F.when(match.rlike(f"^{NAMED}[^\\s]"), F.regexp_extract(match, f"^{NAMED}", 0)).otherwise("")
        return F.struct(
            (F.get("at", i) + F.length(name)).alias("start"), F.substr(match, F.length(name) + 1).alias("value"),
            F.right(F.concat(F.get("g", i), name), F.lit(CONTEXT)).alias("before"), F.left(F.get("g", i + 1), F.lit(CONTEXT)).alias("after"),
            _long_enough(match, min_length).alias("long"),
        )

    # The last gap has no match; arrays_zip fills it with null, which ends the sum there.
    found = F.filter(F.transform(F.sequence(F.lit(0), F.size("m") - 1), one), lambda c: c["long"])
    return parts.withColumn("at", before).select("key", "path", F.inline(found)).drop("long")


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def _luhn(digits: Column) -> Column:
    """Whether a string of digits ends in the check digit of card numbers."""
    from_right = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2).otherwise(c.cast("int")))
    return F.aggregate(from_right, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(F.coalesce(x, F.lit(0)))) % 10 == 0


def features(found: DataFrame, words: list[str] | tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """The candidates with their numeric features, and the features' names; ``words`` are the dictionary."""
    value = F.col("value")
    low, rest = F.lower(value), F.greatest(F.length(value) - 1, F.lit(1))
    classed = F.translate(value, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "h" * 6 + "l" * 20 + "u" * 26 + "d" * 10)
    classed = F.regexp_replace(classed, "[^hlud]", "x")
    covered = F.regexp_replace(low, "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")", "") if words else low
    # Neighbours without the name that labels go by.
    before, after = F.regexp_replace(F.lower(F.coalesce("before", F.lit(""))), ASSIGNED, ""), F.lower(F.coalesce("after", F.lit("")))
    path = F.coalesce(F.col("path"), F.lit(""))
    flags = {
        "length": F.length(value), "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "coverage": (F.length(low) - F.length(covered)) / F.length(low),
        "hex": low.rlike("^[0-9a-f]+$"), "vowels": (F.length(low) - F.length(F.translate(low, "aeiou", ""))) / F.length(low),
        "path_sample": path.rlike(PATH_FLAGS), "path_code": path.rlike(CODE_PATH), "path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "quoted": F.col("before").rlike("[\"']$") & after.rlike("^[\"']"), "in_phrase": before.rlike("[a-z,.] $") & after.rlike("^[,.]? [a-z]"),
        "counted": before.rlike("(?:order|invoice|card|phone|tel|isbn|commit|sha|hash|uuid|id|no\\.?|number)[ :#=\"']*$"),
    }
    last, first = F.regexp_extract(before, "([a-z]+)[^a-z]*$", 1), F.regexp_extract(after, "^[^a-z]*([a-z]+)", 1)
    for side, word in (("left", last), ("right", first)):
        for i in range(NEIGHBOURS):
            flags[f"{side}_{i}"] = F.pmod(F.xxhash64(word), F.lit(NEIGHBOURS)) == i
    for x in CLASSES:
        runs = F.regexp_replace(F.col("classed"), f"{x}+", "#")
        for y in CLASSES:
            flags[f"t_{x}{y}"] = (_count(F.col("classed"), x) - _count(runs, "#") if x == y else _count(F.col("classed"), x + y)) / rest
    made = found.withColumn("classed", classed)
    return made.select(*found.columns, *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"f_{n}") for n, c in flags.items())), [f"f_{n}" for n in flags]


def weak_labels(found: DataFrame) -> DataFrame:
    """Adds ``label``: 1 for an issuer's format or a mixed value assigned to a secret name, 0 for card numbers by their check digit and parts of addresses, else null."""
    value, before, after = F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    named = before.rlike(ASSIGNED) & value.rlike("[0-9]|[^A-Za-z].*[^A-Za-z]|[a-z][A-Z]")
    card = value.rlike("^[0-9]{13,19}$") & _luhn(value)
    plain = card | before.rlike("(?:https?://|www\\.)\\S*$") | after.rlike("^[\\w.]*@")
    return found.withColumn("label", F.when(value.rlike(KNOWN) | named, 1.0).when(plain, 0.0))


def sample(labelled: DataFrame, names: list[str], max_findings: int) -> DataFrame:
    """(label, weight, features) of at most ``max_findings`` distinct findings, by hash within each label.

    A finding weighs as often as it occurs, times its label's distinct findings for each one taken.
    A label gets half of the places, and those that the other leaves free.
    """
    distinct = cut(labelled.where("label is not null").groupBy("label", *names).agg(F.count("*").alias("times")))
    kinds = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count("*").alias("n")).collect()}
    taken = []
    for label, n in sorted(kinds.items()):
        places = max(max_findings // 2, max_findings - sum(kinds.values()) + n) if len(kinds) > 1 else max_findings
        part = distinct.where(F.col("label") == label).orderBy(F.xxhash64(*names), *names).limit(places)
        taken.append(part.select("label", (F.col("times") * (n / min(n, places))).alias("weight"), *names))
    return reduce(DataFrame.union, taken) if taken else distinct.select("label", F.lit(1.0).alias("weight"), *names)


def fit(labelled: DataFrame, names: list[str], *, max_findings: int = 20_000, trees: int = 24, depth: int = 8):
    """A forest from at most ``max_findings`` distinct labelled findings; None unless both labels occur."""
    known = sample(labelled, names, max_findings)
    known = cut(VectorAssembler(inputCols=names, outputCol="features").transform(known).select("label", "weight", "features"))
    if known.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="onethird", subsamplingRate=0.8, weightCol="weight").fit(known)


def _judged(made: DataFrame, names: list[str], model) -> DataFrame:
    scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(made))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def score(found: DataFrame, words: list[str], findings: DataFrame | None, max_findings: int) -> DataFrame:
    """Candidates (a written table) with ``score``, the forest's; each is scored by a forest that did not see its value."""
    made, names = features(found, words)
    if findings is not None:
        model = fit(features(findings, words)[0], names, max_findings=max_findings)
        return _judged(made, names, model) if model else made.withColumn("score", F.lit(0.0))
    made = weak_labels(made).withColumn("fold", F.pmod(F.xxhash64("value"), F.lit(FOLDS)))
    models = [fit(made.where(F.col("fold") != i), names, max_findings=max_findings) for i in range(FOLDS)]
    if any(m is None for m in models):
        models = [fit(made, names, max_findings=max_findings)] * FOLDS
    if models[0] is None:
        return made.withColumn("score", F.coalesce("label", F.lit(0.0)))
    return reduce(DataFrame.union, [_judged(made.where(F.col("fold") == i), names, m) for i, m in enumerate(models)])


def scan(
    df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source", *, threshold: float = 0.5,
    findings: DataFrame | None = None, min_length: int = 12, least_named: int = 6, max_findings: int = 20_000, words: list[str] | None = None,
) -> DataFrame:
    """A row per candidate: key, start, length, value, known (issuer's format), score, is_secret.

    ``findings`` are labelled candidates (value, before, after, path, label); without them
    ``weak_labels`` labels the candidates of ``df`` itself.  ``words`` replaces the corpus's dictionary.
    """
    words = dictionary(df, text) if words is None else words
    found = cut(candidates(df, key, text, path, min_length=min_length, least_named=least_named))
    scored, known = score(found, words, findings, max_findings), F.col("value").rlike(KNOWN)
    return scored.select(
        F.col("key").alias(key), "start", F.length("value").alias("length"), "value",
        known.alias("known"), F.round("score", 6).alias("score"), (known | (F.round("score", 6) >= threshold)).alias("is_secret"),
    )


def redact(
    df: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", *, path: str | None = "source", mark: str = "[SECRET]",
    min_length: int = 12, least_named: int = 6, **options,
) -> DataFrame:
    """All rows and columns of ``df``, each secret replaced by ``mark``.

    Rows without a candidate stay where they are; the others are written with a number of their
    own, by which their secrets come back, so neither keys nor texts of all rows are shuffled.
    """
    names, pattern = df.columns, candidate(least_named)
    row = df.select(F.struct(*(df[c] for c in names)).alias("row"))
    held = F.coalesce(F.exists(F.regexp_extract_all(f"row.`{text}`", F.lit(pattern), F.lit(0)), lambda x: _long_enough(x, min_length)), F.lit(False))
    some = cut(row.where(held).select("row", F.monotonically_increasing_id().alias("number")))
    slim = some.select("number", F.col(f"row.`{text}`").alias("text"), (F.col(f"row.`{path}`") if path in names else F.lit(None).cast("string")).alias("path"))
    words = options.pop("words", None) or dictionary(df, text)
    secrets = scan(slim, "number", "text", "path", min_length=min_length, least_named=least_named, words=words, **options).where("is_secret")
    places = secrets.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("places"))
    both = some.join(places, "number", "left")
    was = F.col(f"row.`{text}`")
    clean = F.aggregate(
        "places", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, p: F.struct(F.concat(acc["out"], F.substr(was, acc["at"] + 1, p["start"] - acc["at"]), F.lit(mark)).alias("out"), (p["start"] + p["length"]).alias("at")),
        lambda acc: F.concat(acc["out"], F.substr(was, acc["at"] + 1)),
    )
    columns = {c: F.col(f"row.`{c}`") for c in names}
    changed = {**columns, text: F.coalesce(clean, was)}
    if length in columns:
        changed[length] = F.when(F.col("places").isNull(), columns[length]).otherwise(F.length(clean).cast(df.schema[length].dataType))
    same, new = (rows.select(*(c.alias(n) for n, c in cols.items())) for rows, cols in ((row.where(~held), columns), (both, changed)))
    return same.unionByName(new)
