"""Term statistics in long form: n-grams, vocabulary, term weights and numeric scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WORD_FAST, once

# Vocabulary limits of the text models.
MAX_FEATURES = 20_000
MIN_DF = 3
MAX_DF = 0.95


def ngram_terms(c: Column) -> Column:
    """Words of two or more characters and their neighbouring pairs."""

    def with_pairs(tokens: Column) -> Column:
        left = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))
        right = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
        return F.concat(tokens, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b)))

    return once(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"([{WORD_FAST}]{{2,}})"), 1), with_pairs)


def term_stats(docs: DataFrame, terms_col: str = "terms") -> DataFrame:
    """``(term, tf, df)`` of the corpus in one shuffle.

    Occurrences and distinct terms of a document go into the same aggregation, so no per-document
    grouping is shuffled and frequent terms are summed on the map side.
    """
    counted = docs.select(F.col(terms_col).alias("_terms"), F.size(terms_col).alias("_n"))
    both = F.posexplode(F.concat("_terms", F.array_distinct("_terms"))).alias("_pos", "term")
    occurrence = F.col("_pos") < F.col("_n")
    rows = counted.select("_n", both).select("term", occurrence.alias("_occurrence"))
    return rows.groupBy("term").agg(
        F.sum(F.col("_occurrence").cast("long")).alias("tf"), F.sum((~F.col("_occurrence")).cast("long")).alias("df")
    )


def vocabulary(
    docs: DataFrame,
    n_docs: int,
    terms_col: str = "terms",
    max_features: int = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> DataFrame:
    """``(term, tf, df, idx)``: the most frequent terms within the document-frequency limits (ties by
    term), numbered from the rarest on. The numbering runs over ``max_features`` rows at most."""
    kept = term_stats(docs, terms_col).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    best = kept.orderBy(F.desc("tf"), "term").limit(max_features)
    return best.withColumn("idx", F.row_number().over(W.orderBy("df", "term")) - 1)


def idf(df_col: Column, n_docs: int) -> Column:
    return F.log((1.0 + F.lit(n_docs)) / (1.0 + df_col)) + 1.0


def term_counts(docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", terms_col: str = "terms") -> DataFrame:
    """``(id, idx, df, tf)`` of vocabulary terms; the vocabulary is bounded by its maximum size."""
    listed = F.broadcast(vocab.select("term", "idx", "df"))
    hits = docs.select(id_col, F.explode(terms_col).alias("term")).join(listed, "term")
    return hits.groupBy(id_col, "idx").agg(F.max("df").alias("df"), F.count(F.lit(1)).alias("tf"))


def with_terms(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Replace ``idx`` by its term."""
    return rows.join(F.broadcast(vocab.select("idx", "term")), "idx").drop("idx")


def tfidf_vectors(
    docs: DataFrame, vocab: DataFrame, n_docs: int, id_col: str = "doc_id", terms_col: str = "terms"
) -> DataFrame:
    """One row per document: its term numbers, rarest first, and their L2-normed weights.

    Documents without any vocabulary term keep empty arrays.
    """
    weight = F.col("tf") * idf(F.col("df"), n_docs)
    rows = term_counts(docs, vocab, id_col, terms_col).select(id_col, "idx", weight.alias("w"))
    packed = rows.groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")
    )
    vectors = packed.select(
        id_col,
        F.transform("t", lambda x: x["idx"]).alias("terms"),
        F.transform("t", lambda x: x["w"] / F.col("norm")).alias("weights"),
    )
    return (
        docs.select(id_col)
        .join(vectors, id_col, "left")
        .select(
            id_col,
            F.coalesce("terms", F.array().cast("array<int>")).alias("terms"),
            F.coalesce("weights", F.array().cast("array<double>")).alias("weights"),
        )
    )


def tfidf_long(vectors: DataFrame, vocab: DataFrame, id_col: str = "doc_id") -> DataFrame:
    pairs = vectors.select(id_col, F.explode(F.arrays_zip("terms", "weights")).alias("p"))
    rows = pairs.select(id_col, F.col("p.terms").alias("idx"), F.round("p.weights", 4).alias("weight"))
    return with_terms(rows, vocab)


def scale_numeric(df: DataFrame, columns: list[str], fit_on: DataFrame) -> DataFrame:
    """Z-scores with the population deviation of ``fit_on``; a constant column is only centred."""
    stats = fit_on.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"_s_{c}") for c in columns],
    ).first()
    out = df
    for c in columns:
        mean, deviation = stats[f"_m_{c}"] or 0.0, stats[f"_s_{c}"] or 0.0
        out = out.withColumn(f"{c}_scaled", (F.col(c).cast("double") - F.lit(mean)) / F.lit(deviation or 1.0))
    return out
