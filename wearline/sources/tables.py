"""Reading and writing: pruned scans, result files, partitioned layouts, manifests, models."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.functions.columns import to_date
from wearline.operators.reshape import indexed


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or the folder set for checkpoints.

    A temporary folder of this machine will do for a local session only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-work-")
    return base


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def scan_wide(spark: SparkSession, path: str, keys: Sequence[str], statics: Sequence[str], bases: Sequence[str]) -> DataFrame:
    """Keys, those statics that exist and all indexed slots; nothing else is read."""
    table = spark.read.parquet(path)
    absent = [k for k in keys if k not in table.columns]
    if absent:
        raise ValueError(f"missing key columns: {absent}")
    slots = [c for base in bases for _, c in indexed(table.columns, base)]
    return table.select(*keys, *(s for s in statics if s in table.columns), *slots)


def scan_events(spark: SparkSession, path: str, columns: Sequence[str], event_type: str | None = None) -> DataFrame:
    """Chosen columns of one event type; filter and columns reach the file scan."""
    table = spark.read.parquet(path)
    if event_type is not None:
        table = table.where(F.col("event_type") == event_type)
    return table.select(*columns)


def scan_dated(spark: SparkSession, path: str, columns: Sequence[str], dates: Sequence[str]) -> DataFrame:
    table = spark.read.parquet(path).select(*columns)
    kinds = dict(table.dtypes)
    return table.withColumns({d: to_date(F.col(d)) for d in dates if not kinds[d].startswith("timestamp")})


def read_results(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Result files that exist, tagged by their name in ``source`` and united; the schema alone if none does."""
    found = spark.createDataFrame([], schema).withColumn("source", F.lit(None).cast("string"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name, path in paths.items():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(hadoop).exists(at):
            found = found.unionByName(spark.read.schema(schema).option("header", True).csv(path).withColumn("source", F.lit(name)), allowMissingColumns=True)
    return found


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows from a table written in the shared folder, so that what follows reads them and does not make them again."""
    path = work_dir(df.sparkSession, name)
    write_parquet(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_by_asset(df: DataFrame, path: str, asset: str = "Segment_ID", buckets: int = 512) -> None:
    """An asset's rows in one bucket folder, sorted: a read of few assets prunes buckets."""
    bucket = F.pmod(F.xxhash64(asset), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).repartition(buckets, "bucket").sortWithinPartitions("bucket", asset, "event_date").write.mode("overwrite").partitionBy("bucket").parquet(path)


def save_bucketed(df: DataFrame, table: str, asset: str = "Segment_ID", buckets: int = 512) -> None:
    """A table whose later windows and joins by asset need no shuffle; its files lie in the shared folder."""
    path = work_dir(df.sparkSession, table)
    df.repartition(buckets, asset).write.mode("overwrite").option("path", path).bucketBy(buckets, asset).sortBy(asset, "event_date").saveAsTable(table)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_manifest(spark: SparkSession, values: dict, path: str) -> None:
    """One JSON document."""
    import json

    spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame, horizon: int, path: str | None = None) -> DataFrame:
    """Predictions at one chosen horizon, written if a path is given."""
    out = model.transform(df.withColumn("forecast_horizon_years", F.lit(float(horizon))))
    if path:
        write_parquet(out.select("Segment_ID", "event_date", *(["slot_idx"] if "slot_idx" in out.columns else []), "forecast_horizon_years", "prediction"), path)
    return out
