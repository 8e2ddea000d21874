"""Labelled article sources and schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import full_text

ARTICLE_SCHEMA = T.StructType(
    [T.StructField("title", T.StringType(), True), T.StructField("text", T.StringType(), True)]
)
FAKE, REAL = 0, 1


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_articles_csv(spark: SparkSession, path: str, schema: T.StructType = ARTICLE_SCHEMA) -> DataFrame:
    """Quoted multi-line CSV with a header row and an explicit schema, so nothing is inferred."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def require_columns(df: DataFrame, needed: list[str]) -> DataFrame:
    """Fail before any job runs when a needed column is absent."""
    missing = [name for name in needed if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def _optional(df: DataFrame, name: str):
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def read_labelled_sources(fake: DataFrame, true: DataFrame, id_col: str | None = None) -> DataFrame:
    """Stack both sources with ``label``, ``raw_text`` and one sortable ``seq`` (fake rows first).

    Ids of ``id_col`` must be unique over both sources. Without one, rows are numbered by partition and place, even
    numbers for fake and odd ones for real rows, so no two rows share an id. That number follows the files as Spark
    packs them; write the result once before anything refers to it.
    """

    def tag(df: DataFrame, label: int) -> DataFrame:
        row = F.col(id_col) if id_col else F.monotonically_increasing_id() * 2 + label
        return df.select(
            row.cast("long").alias("doc_id"),
            F.lit(label).alias("label"),
            _optional(df, "title").alias("title"),
            _optional(df, "text").alias("text"),
        )

    stacked = tag(fake, FAKE).unionByName(tag(true, REAL))
    return with_sequence(stacked).withColumn("raw_text", full_text(F.col("title"), F.col("text")))


def with_sequence(df: DataFrame) -> DataFrame:
    """Source order and row id in one long, so the first row of a group is a plain ``min``."""
    return df.withColumn("seq", F.shiftleft(F.col("label").cast("long"), 61) + F.col("doc_id"))


def source_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
