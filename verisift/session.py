"""Session helpers: settings of local sessions and intermediate tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "verisift", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the checkpoint folder, or else one in a local warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster needs spark.checkpoint.dir: the default warehouse may lie on one machine")
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/intermediate"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as parquet and read again: it cuts the lineage, keeps columns apart and tells their size."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_RELEASING = {"lock": Lock(), "users": 0, "before": None}


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that end in this block delete their shuffle files, which else stay until the driver collects garbage.

    Blocks of several threads share the session's setting: the first sets it and the last puts it back.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with _RELEASING["lock"]:
        if not _RELEASING["users"]:
            _RELEASING["before"] = spark.conf.get(key, None)
            spark.conf.set(key, "true")
        _RELEASING["users"] += 1
    try:
        yield
    finally:
        with _RELEASING["lock"]:
            _RELEASING["users"] -= 1
            if not _RELEASING["users"]:
                if _RELEASING["before"] is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, _RELEASING["before"])
