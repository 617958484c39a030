"""Where intermediate tables go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wearline.sources.tables import shared_dir


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared checkpoint folder, so that a lost executor costs no recomputation.

    The folder is the session's ``spark.checkpoint.dir``, or the one set for checkpoints; only where
    neither is set (a local session, as in tests) is a temporary one used, and a cluster's session
    without one is refused.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint()


def checkpoint_dir(spark: SparkSession) -> str:
    return shared_dir(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
