"""Labelled sources in, clean split corpus out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_light
from ..operators.corpus import dedup_canonical, dedup_exact, stratified_split
from ..operators.lemmas import with_clean_ml
from ..operators.sentiment import PROFILE, with_style_and_tone
from ..sources.artifacts import load_table, save_splits


def clean_corpus(
    labelled: DataFrame,
    lemmas: DataFrame,
    lexicon: DataFrame,
    canonical: bool = True,
    normalize: bool = True,
) -> DataFrame:
    """Deduplicate, then add both cleaned texts and the style features.

    Duplicates are found on hashed keys before any cleaning, so only rows that stay are cleaned.
    """
    kept = dedup_canonical(labelled, normalize) if canonical else dedup_exact(labelled)
    kept = with_clean_ml(kept.withColumn("text_llm", clean_light(F.col("raw_text"))), lemmas)
    scored = with_style_and_tone(kept, "doc_id", "raw_text", lexicon).drop(*(c for c in PROFILE if c not in kept.columns))
    return scored.withColumn("has_dateline", F.col("has_dateline").cast("int"))


def build_corpus(
    labelled: DataFrame,
    lemmas: DataFrame,
    lexicon: DataFrame,
    path: str,
    train: float = 0.70,
    val: float = 0.10,
    test: float = 0.20,
    seed: int = 42,
    canonical: bool = True,
) -> tuple[DataFrame, bool]:
    """The split corpus, partitioned by split at ``path``; a complete earlier result is reused.

    The cleaned rows are written before they are split, so the split's passes read narrow columns of
    that table and no cleaning runs twice.
    """
    spark = labelled.sparkSession
    saved = load_table(spark, path)
    if saved is not None:
        return saved, True
    staged = f"{path}_rows"
    clean_corpus(labelled, lemmas, lexicon, canonical).write.mode("overwrite").parquet(staged)
    save_splits(stratified_split(spark.read.parquet(staged), train, val, test, seed), path)
    return spark.read.parquet(path), False
