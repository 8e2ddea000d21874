"""Saved stages: split tables as parquet, fitted pipelines, and "reuse when already saved"."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Ask the file system that owns the path, so shared stores work as well as local folders."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def save_splits(df: DataFrame, path: str) -> str:
    """One folder per split, so a reader of one split lists only that folder."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, f"{path}/_SUCCESS") else None


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    return PipelineModel.load(path) if path_exists(spark, f"{path}/metadata") else None


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The saved table and True when it is complete, else build and write it once."""
    saved = load_table(spark, path)
    if saved is not None:
        return saved, True
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path), False
