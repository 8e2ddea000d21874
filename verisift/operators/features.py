"""Spark ML feature stages: TF-IDF (or raw counts) next to scaled numeric columns.

Every stage is a stock transformer, so a fitted ``PipelineModel`` saves, loads and scores without
this package. After the vocabulary is fitted, transforming a table needs no shuffle.
"""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD
from .vocabulary import MAX_DF, MAX_FEATURES, MIN_DF, ngram_terms, vocabulary

NUMERIC_COLUMNS = ("sub_variance", "mean_subjectivity", "lexical_density", "caps_ratio", "has_dateline")


def _term_stages(text_col: str) -> list[Transformer]:
    return [
        RegexTokenizer(
            inputCol=text_col, outputCol="tokens", pattern=f"[{WORD}]{{2,}}", gaps=False, toLowercase=True
        ),
        NGram(n=2, inputCol="tokens", outputCol="bigrams"),
        SQLTransformer(statement="SELECT *, concat(tokens, bigrams) AS all_terms FROM __THIS__"),
    ]


def _fitted_vocabulary(train: DataFrame, text_col: str, max_features: int) -> tuple[list, int]:
    docs = train.select(ngram_terms(F.col(text_col)).alias("terms"))
    n_docs = train.count()
    # At most max_features rows: the model's own vocabulary.
    rows = vocabulary(docs, n_docs, "terms", max_features, MIN_DF, MAX_DF).orderBy("term").collect()
    if not rows:
        raise ValueError("no term passes the document-frequency limits")
    return rows, n_docs


def text_stages(
    train: DataFrame, text_col: str, max_features: int = MAX_FEATURES, weighting: str = "tfidf"
) -> tuple[list[Transformer], list[str]]:
    """Stages from ``text_col`` to ``text_features`` and the vocabulary in index order.

    ``weighting='counts'`` keeps raw counts; ``'tfidf'`` scales by the smoothed idf plus one and
    norms each row.
    """
    rows, n_docs = _fitted_vocabulary(train, text_col, max_features)
    terms = [r.term for r in rows]
    stages = _term_stages(text_col)
    out = "text_features" if weighting == "counts" else "counts"
    stages.append(CountVectorizerModel.from_vocabulary(terms, inputCol="all_terms", outputCol=out))
    if weighting == "tfidf":
        idf = [math.log((1 + n_docs) / (1 + r.df)) + 1 for r in rows]
        stages.append(ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="weighted"))
        stages.append(Normalizer(p=2.0, inputCol="weighted", outputCol="text_features"))
    return stages, terms


def numeric_stages(train: DataFrame, columns: tuple[str, ...] = NUMERIC_COLUMNS) -> list[Transformer]:
    """Z-scores by the train table's mean and population deviation; missing values count as 0."""
    value = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    stats = train.agg(
        *[F.avg(v).alias(f"m_{c}") for c, v in value.items()],
        *[F.stddev_pop(v).alias(f"s_{c}") for c, v in value.items()],
    ).first()
    scaled = ", ".join(
        f"(coalesce(cast({c} AS DOUBLE), 0D) - {stats[f'm_{c}']!r}D) / {(stats[f's_{c}'] or 1.0)!r}D AS {c}_scaled"
        for c in columns
    )
    return [SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__")]


_WORK_COLUMNS = ("tokens", "bigrams", "all_terms", "counts", "weighted")


def fit_features(
    train: DataFrame,
    text_col: str = "text_ml",
    numeric: tuple[str, ...] = NUMERIC_COLUMNS,
    max_features: int = MAX_FEATURES,
    weighting: str = "tfidf",
) -> tuple[PipelineModel, list[str]]:
    """A fitted pipeline that adds ``features`` and the feature names in vector order."""
    stages, terms = text_stages(train, text_col, max_features, weighting)
    inputs = ["text_features"]
    if numeric:
        stages += numeric_stages(train, numeric)
        inputs += [f"{c}_scaled" for c in numeric]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return PipelineModel(stages), terms + list(numeric)


def apply_features(model: PipelineModel, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Transform and drop the intermediate columns."""
    out = model.transform(df)
    if keep is not None:
        return out.select(*keep, "features")
    extra = [c for c in out.columns if c in _WORK_COLUMNS or c.endswith("_scaled") or c == "text_features"]
    return out.drop(*extra)


def feature_values(vectors: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Vectors in long form: the ``keep`` columns, ``name`` and ``value`` of every component that the vector stores.

    A row takes only what its vector stores, sparse or dense; null and empty vectors give no rows, repeated rows repeat.
    The names are those of one model, at most its vocabulary and numeric columns, and are broadcast.
    """
    spark = vectors.sparkSession
    named = spark.createDataFrame(list(enumerate(names)), "place int, name string")
    v = F.unwrap_udt(F.col("features"))
    places = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
    stored = F.arrays_zip(places.alias("place"), v["values"].alias("value"))
    rows = vectors.select(*keep, F.explode(stored).alias("f")).select(*keep, "f.place", "f.value")
    return rows.join(F.broadcast(named), "place").select(*keep, "name", "value")


def fixed_score(intercept: float, coefficients: dict[str, float]) -> Column:
    """P(real) at four decimals from given coefficients over numeric columns."""
    z = F.lit(float(intercept))
    for column, weight in coefficients.items():
        z = z + F.lit(float(weight)) * F.col(column).cast("double")
    return F.round(1.0 / (1.0 + F.exp(-z)), 4)
