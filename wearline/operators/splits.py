"""Sampling and splits without leakage, by md5 ranks so that they repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wearline.operators.prefix import ranked


def rank_key(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def exact_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows (all, if there are fewer), by the rank of their key."""
    return df.orderBy(rank_key(seed, *keys), *keys).limit(n)


def assets_of_several(df: DataFrame, asset: str, stratum: str) -> DataFrame:
    """Assets that occur in more than one stratum; a split needs this to be empty."""
    return df.groupBy(asset).agg(F.countDistinct(stratum).alias("strata")).where("strata > 1")


def stratified_assets(df: DataFrame, asset: str, stratum: str, train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """(asset, split): per stratum, shares of the assets in md5 order; small strata keep one for validation and test where they can.

    The assets are read once and ranked in ranges of (stratum, md5), so no task sorts a stratum.
    """
    assets = df.select(asset, stratum).distinct().withColumn("_h", rank_key(seed, asset))
    placed = ranked(assets, [stratum], ["_h", asset], "_r").withColumnRenamed("total__r", "_n")
    size = F.col("_n")
    n_train = F.when(size >= 3, F.least(F.greatest(F.bround(size * train), F.lit(1)), size - 2)).otherwise(F.greatest(size - 2, F.lit(0))).cast("long")
    placed = placed.withColumn("_t", n_train)
    left = size - F.col("_t")
    n_val = F.when(left >= 2, F.least(F.greatest(F.bround(size * validation), F.lit(1)), left - 1)).otherwise(F.greatest(left - 1, F.lit(0))).cast("long")
    split = F.when(F.col("_r") <= F.col("_t"), "train").when(F.col("_r") <= F.col("_t") + n_val, "validation").otherwise("test")
    return placed.select(asset, split.alias("split"))


def with_split(df: DataFrame, split: DataFrame, asset: str) -> DataFrame:
    return df.join(split, asset)


def leaks(df: DataFrame, asset: str) -> DataFrame:
    """Assets in more than one split."""
    return df.groupBy(asset).agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def date_cutoff(df: DataFrame, date: str, share: float = 0.8) -> DataFrame:
    """One row: the distinct date at place ``share`` of all, not the first and not the last but one place inside.

    Dates are ranked in ranges of time: ranges are counted first, so no single task sorts all dates.
    """
    dates = df.select(F.col(date).alias("d")).where("d is not null").distinct().withColumn("range", F.year("d") * 12 + F.month("d"))
    per = dates.groupBy("range").count()
    before = per.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy()).alias("n"))
    placed = dates.join(F.broadcast(before), "range").withColumn("i", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("d")) - 1)
    want = F.least(F.greatest(F.floor(F.col("n") * share), F.lit(1)), F.col("n") - 1)
    return placed.where(F.col("i") == want).select(F.col("d").alias("cutoff"))


def chronological(df: DataFrame, date: str, cutoff: DataFrame) -> DataFrame:
    return df.join(F.broadcast(cutoff)).withColumn("split", F.when(F.col(date) < F.col("cutoff"), "train").otherwise("test")).drop("cutoff")


def by_year(df: DataFrame, year: str, train_before: int, validation: int, test: tuple[int, int]) -> DataFrame:
    y = F.col(year)
    split = F.when(y < train_before, "train").when(y == validation, "validation").when(y.between(*test), "test")
    return df.withColumn("split", split).where("split is not null")
