"""Deduplication, splits and class counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus
from ..sources.tables import FAKE, REAL, with_sequence
from . import inputs
from . import sqltext as q
from .base import Query, with_ctes


def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.labelled(spark, sf).select("doc_id", "label", "raw_text")
    stacked = rows.filter(F.col("label") == FAKE).unionByName(rows.filter(F.col("label") == REAL))
    return with_sequence(stacked).select("doc_id", "label", "seq")


def exact(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.dedup_exact(inputs.labelled(spark, sf)).select("doc_id", "label")


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.dedup_canonical(inputs.labelled_variants(spark, sf)).select("doc_id", "label")


def all_documents_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """First document of every distinct text over the whole documents table."""
    docs = inputs.documents(spark, sf).select("doc_id", F.col("text").alias("raw_text"), F.col("doc_id").alias("seq"))
    return corpus.dedup_exact(docs).select("doc_id")


def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.split_texts(spark, sf).select("doc_id", "label", "split")


def default_split_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.labelled(spark, sf)
    return corpus.stratified_split(rows).select("doc_id", "label", "split")


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.class_counts(split_rows(spark, sf))


def proportions(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.class_proportions(split_rows(spark, sf)).select("split", "label", "share")


def proportion_maps(spark: SparkSession, sf: str) -> DataFrame:
    maps = corpus.class_proportion_maps(split_rows(spark, sf))
    return maps.select("split", *[F.col("class_proportions")[k].alias(f"share_{k}") for k in (0, 1)])


def summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.build_and_count(inputs.labelled_variants(spark, sf), *inputs.SHARES, seed=inputs.SEED)[1]


def baseline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.majority_baseline(split_rows(spark, sf))


def clean_class_style(spark: SparkSession, sf: str) -> DataFrame:
    """Documents left per class after canonical dedup and their mean style."""
    kept = corpus.dedup_canonical(inputs.labelled_variants(spark, sf))
    return (
        inputs.style_features(kept)
        .groupBy("label")
        .agg(
            F.count(F.lit(1)).alias("n_docs"),
            F.round(F.avg("caps_ratio"), 4).alias("mean_caps_ratio"),
            F.round(F.avg("lexical_density"), 4).alias("mean_lexical_density"),
        )
    )


def aligned_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.style_features(inputs.labelled(spark, sf))
    return rows.select("doc_id", "label", "lexical_density", "caps_ratio", "n_words")


_SPLITS = (q.LABELLED_CTE, *q.split_ctes("labelled"))
_FINAL = (*q.CANONICAL_CTES, *q.split_ctes("kept"))


def _share(split: str, label: int) -> str:
    return f"(SELECT round(avg((label = {label})::INTEGER), 4) FROM splits WHERE split = '{split}')"


_PARTS = {"train": "train", "val": "validation", "test": "test"}

QUERIES = [
    Query(
        "union_sources",
        union_sources,
        "SELECT doc_id, quality AS label, quality::BIGINT * 2305843009213693952 + doc_id AS seq "
        "FROM labels JOIN documents USING (doc_id)",
    ),
    Query(
        "dedup_exact",
        exact,
        with_ctes(
            """SELECT doc_id, label FROM (SELECT doc_id, label,
 row_number() OVER (PARTITION BY raw_text ORDER BY label, doc_id) AS rn FROM labelled WHERE raw_text <> '')
 WHERE rn = 1""",
            q.LABELLED_CTE,
        ),
    ),
    Query(
        "dedup_exact_documents",
        all_documents_dedup,
        "SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, "
        + q.strip("coalesce(text, '')")
        + " AS t FROM documents) WHERE t <> '' GROUP BY t",
    ),
    Query("dedup_canonical", canonical, with_ctes("SELECT doc_id, label FROM kept", *q.CANONICAL_CTES)),
    Query("stratified_split", split_rows, with_ctes("SELECT doc_id, label, split FROM splits", *_SPLITS)),
    Query(
        "stratified_split_default",
        default_split_rows,
        with_ctes(
            "SELECT doc_id, label, split FROM splits", q.LABELLED_CTE, *q.split_ctes("labelled", (0.70, 0.10, 0.20))
        ),
    ),
    Query(
        "class_counts",
        counts,
        with_ctes("SELECT split, label, count(*) AS n_rows FROM splits GROUP BY split, label", *_SPLITS),
    ),
    Query(
        "class_proportions",
        proportions,
        with_ctes(
            """SELECT split, label, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY split), 4) AS share
 FROM splits GROUP BY split, label""",
            *_SPLITS,
        ),
    ),
    Query(
        "class_proportion_maps",
        proportion_maps,
        with_ctes(
            """SELECT split, round(avg((label = 0)::INTEGER), 4) AS share_0, round(avg((label = 1)::INTEGER), 4) AS share_1
 FROM splits GROUP BY split""",
            *_SPLITS,
        ),
    ),
    Query(
        "preprocess_summary",
        summary,
        with_ctes(
            "SELECT (SELECT count(*) FROM variants WHERE label = 0) AS raw_fake_rows, "
            "(SELECT count(*) FROM variants WHERE label = 1) AS raw_true_rows, "
            "(SELECT count(*) FROM variants) AS raw_total_rows, "
            "(SELECT count(*) FROM filled WHERE raw_text = '') AS empty_rows_removed, "
            "(SELECT count(*) FROM keyed WHERE dedup_key = '') AS empty_key_rows_removed, "
            "(SELECT count(*) FROM keyed WHERE dedup_key <> '') - (SELECT count(*) FROM kept) AS duplicate_rows_removed, "
            "(SELECT count(*) FROM kept) AS final_rows_after_preprocessing, "
            + ", ".join(f"(SELECT count(*) FROM splits WHERE split = '{s}') AS {n}_rows" for n, s in _PARTS.items())
            + ", "
            + ", ".join(f"{_share(s, k)} AS {n}_share_{k}" for n, s in _PARTS.items() for k in (0, 1)),
            *_FINAL,
        ),
    ),
    Query(
        "majority_baseline",
        baseline,
        with_ctes(
            """SELECT m AS majority_label, (SELECT round(avg((label = m)::INTEGER), 4) FROM splits WHERE split = 'test')
 AS accuracy FROM (SELECT label AS m FROM splits WHERE split = 'train' GROUP BY label
 ORDER BY count(*) DESC, label LIMIT 1)""",
            *_SPLITS,
        ),
    ),
    Query(
        "clean_class_style",
        clean_class_style,
        with_ctes(
            """SELECT label, count(*) AS n_docs, round(avg(caps_ratio), 4) AS mean_caps_ratio,
 round(avg(lexical_density), 4) AS mean_lexical_density FROM features GROUP BY label""",
            *q.CANONICAL_CTES,
            q.feature_cte("features", "kept"),
        ),
    ),
    Query(
        "features_alignment",
        aligned_features,
        with_ctes("SELECT * FROM features", q.LABELLED_CTE, q.feature_cte("features", "labelled")),
    ),
]
