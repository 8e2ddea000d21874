"""Lexicon sentiment of documents and sentences.

The lexicon is an input table ``(word, polarity, subjectivity)`` of any size. A document's value is the mean over its
listed words, zero without any. Style and tone look words up where the document is, and nothing is shuffled, as long as
the lexicon fits a task's memory (``IN_ROW`` rows); with a larger one, and for ``doc_sentiment``, words are exploded, joined
and summed up per sentence or document, and on the map side the sums shrink to one row per sentence before the shuffle.

Sums are whole numbers: values are taken in millionths, and a sentence's mean enters the variance in billionths. So
every result, ties of the last decimal included, is the same whatever the order in which partitions arrive.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import style
from ..functions.text import WORD_FAST

SCORES = ("sub_variance", "mean_subjectivity", "lexical_density", "caps_ratio", "has_dateline")
PROFILE = (
    "overall_polarity",
    "overall_subjectivity",
    "sentence_count",
    "exclamation_ratio",
    "caps_word_ratio",
    "tone_score",
    "emotional_tone",
)


# A lexicon value in millionths, a sentence's mean in billionths.
MICRO, NANO = 1_000_000, 1_000_000_000
# Rows of a lexicon or lemma table that tasks hold to look words up; larger ones are joined.
IN_ROW = 200_000


def _micro(col: str) -> Column:
    return F.round(F.col(col) * F.lit(float(MICRO))).cast("long")


def _mean(total: str, n: str) -> Column:
    """The mean of ``n`` values in millionths that add up to ``total``, 0 without any."""
    return F.when(F.col(n) > 0, F.col(total) / (F.col(n) * F.lit(MICRO)).cast("double")).otherwise(F.lit(0.0))


def _rounded_mean(total: str, n: str) -> Column:
    """The same at four decimals, half away from zero, decided in whole numbers."""
    half_up = F.expr(f"(2 * abs({total}) + 100 * {n}) div (200 * {n})")
    signed = F.when(F.col(total) < 0, -half_up).otherwise(half_up)
    return F.when(F.col(n) > 0, signed / F.lit(10_000.0)).otherwise(F.lit(0.0))


def lexicon_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD_FAST}]+)"), 1)


def doc_sentiment(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``(id, polarity, subjectivity)`` with one aggregation.

    Words that miss the lexicon still carry their id, so no document is lost.
    """
    words = df.select(id_col, F.explode_outer(lexicon_words(F.col(text_col))).alias("word"))
    sums = (
        words.join(lexicon, "word", "left")
        .groupBy(id_col)
        .agg(
            F.coalesce(F.sum(_micro("polarity")), F.lit(0)).alias("polarity"),
            F.coalesce(F.sum(_micro("subjectivity")), F.lit(0)).alias("subj"),
            F.count("subjectivity").alias("n"),
        )
    )
    return sums.select(
        id_col, _rounded_mean("polarity", "n").alias("polarity"), _rounded_mean("subj", "n").alias("subjectivity")
    )


def _known_words(lexicon: DataFrame) -> dict[str, tuple[int, int, int]] | None:
    """Polarity, subjectivity (in millionths) and number of values per word; nothing for a lexicon above ``IN_ROW``."""
    listed = lexicon.select("word", _micro("polarity"), _micro("subjectivity")).limit(IN_ROW + 1).collect()
    if len(listed) > IN_ROW:
        return None
    known: dict[str, tuple[int, int, int]] = defaultdict(lambda: (0, 0, 0))
    for word, polarity, subj in listed:
        if word is not None:
            p, s, n = known[word]
            known[word] = (p + (polarity or 0), s + (subj or 0), n + (subj is not None))
    return dict(known)


_SUMS = "polarity long, subj long, n long, variance double"


def _summed_in_row(known: dict[str, tuple[int, int, int]]):
    """A function from the words of a document's sentences to its sums and the variance of its sentences' means."""
    listed = pa.array(list(known), type=pa.string())
    # The last row is for words that are not listed.
    values = np.array([*known.values(), (0, 0, 0)], dtype=np.int64)

    @F.arrow_udf(_SUMS)
    def summed(docs: pa.Array) -> pa.Array:
        def ends(lists: pa.Array) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)

        def between(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            run = np.concatenate([np.zeros((1, rows.shape[1]), dtype=np.int64), np.cumsum(rows, axis=0)])
            return run[at[1:]] - run[at[:-1]]

        sentences = docs.flatten()
        place = pc.fill_null(pc.index_in(sentences.flatten(), value_set=listed), len(listed)).to_numpy(zero_copy_only=False)
        own = between(values[place], ends(sentences))
        doc_ends = ends(docs)
        total = between(own, doc_ends)
        subj, n = own[:, 1], own[:, 2]
        mean = np.where(n > 0, subj / np.maximum(n * MICRO, 1).astype(float), 0.0) * float(NANO)
        mean = (np.sign(mean) * np.floor(np.abs(mean) + 0.5)).astype(np.int64)
        # Squares are added up in two parts, which 64 bits hold: m * squares - means ** 2 is exact up to the last division.
        high, low = np.divmod(mean, 100_000)
        parts = between(np.stack([mean, high * high, high * low, low * low], axis=1), doc_ends).tolist()
        variance = []
        for m, (means, hh, hl, ll) in zip(np.diff(doc_ends).tolist(), parts, strict=True):
            above = float(m * (hh * 10**10 + 2 * hl * 10**5 + ll) - means * means)
            variance.append(above / (float(m * (m - 1)) * float(NANO) ** 2) if m > 1 else 0.0)
        columns = [*[pa.array(total[:, k]) for k in range(3)], pa.array(variance, type=pa.float64())]
        return pa.StructArray.from_arrays(columns, names=["polarity", "subj", "n", "variance"])

    return summed


def _cut(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``own``, its per-document values, and ``_words``, the words of its sentences."""
    cut = df.withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    cut = cut.withColumn("_sentences", style.sentences(F.col("_text")))
    text, sentences = F.col("_text"), F.col("_sentences")
    return cut.select(
        *[F.col(c) for c in df.columns],
        F.struct(
            style.lexical_density(text).alias("density"),
            style.caps_ratio(text).alias("caps"),
            style.has_dateline(text).alias("dateline"),
            style.exclamation_ratio(sentences).alias("excl"),
            style.caps_word_ratio(text).alias("caps_words"),
            F.size(sentences).cast("long").alias("n_sentences"),
        ).alias("own"),
        F.transform(sentences, lexicon_words).alias("_words"),
    )


def _summed_by_join(cut: DataFrame, id_col: str, lexicon: DataFrame) -> DataFrame:
    """``(id, own, sums)`` through exploded words; ids must be unique."""
    words = cut.select(id_col, "own", F.posexplode_outer("_words").alias("pos", "words")).select(
        id_col, "own", "pos", F.explode_outer("words").alias("word")
    )
    sentence = (
        words.join(lexicon, "word", "left")
        .groupBy(id_col, "pos", "own")
        .agg(
            F.coalesce(F.sum(_micro("polarity")), F.lit(0)).alias("polarity"),
            F.coalesce(F.sum(_micro("subjectivity")), F.lit(0)).alias("subj"),
            F.count("subjectivity").alias("n"),
        )
        .withColumn("mean", F.round(_mean("subj", "n") * F.lit(float(NANO))).cast("decimal(10,0)"))
    )
    doc = sentence.groupBy(id_col, "own").agg(
        F.sum("polarity").alias("polarity"),
        F.sum("subj").alias("subj"),
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("m"),
        F.sum("mean").alias("means"),
        F.sum((F.col("mean") * F.col("mean")).cast("decimal(20,0)")).alias("squares"),
    )
    # m * squares - means ** 2 over m * (m - 1), all in whole numbers up to the last division.
    above = F.expr("CAST(m * squares AS DECIMAL(38, 0)) - CAST(means * means AS DECIMAL(38, 0))").cast("double")
    below = (F.col("m") * (F.col("m") - 1)).cast("double") * F.lit(float(NANO) ** 2)
    variance = F.when(F.col("m") > 1, above / below).otherwise(F.lit(0.0))
    return doc.withColumn("variance", variance)


def _features() -> list[Column]:
    """SCORES and PROFILE from ``own`` and the sums."""
    subj = _mean("subj", "n")
    tone = style.tone_score(subj, F.col("own.excl"), F.col("own.caps_words"))
    return [
        F.round("variance", 4).alias("sub_variance"),
        _rounded_mean("subj", "n").alias("mean_subjectivity"),
        F.round("own.density", 4).alias("lexical_density"),
        F.round("own.caps", 4).alias("caps_ratio"),
        F.col("own.dateline").alias("has_dateline"),
        _rounded_mean("polarity", "n").alias("overall_polarity"),
        _rounded_mean("subj", "n").alias("overall_subjectivity"),
        F.col("own.n_sentences").alias("sentence_count"),
        F.round("own.excl", 4).alias("exclamation_ratio"),
        F.round("own.caps_words", 4).alias("caps_word_ratio"),
        tone.alias("tone_score"),
        style.tone_band(tone).alias("emotional_tone"),
    ]


def with_style_and_tone(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``df``, its id first, with the five style features and seven tone fields; rows without an id are left out.

    A sentence break is white space, so the words of a text are those of its sentences. Ids must be unique.
    """
    kept = df.select(id_col, *[c for c in df.columns if c != id_col])
    known = _known_words(lexicon)
    if known is None:
        summed = _summed_by_join(_cut(df.select(id_col, text_col), text_col), id_col, lexicon)
        return kept.join(summed.select(id_col, *_features()), id_col)
    summed = _cut(kept.filter(F.col(id_col).isNotNull()), text_col).withColumn("_sums", _summed_in_row(known)("_words"))
    parts = [F.col(f"_sums.{name}").alias(name) for name in ("polarity", "subj", "n", "variance")]
    # The sums keep their own names below the features, where no column of the rows can be mistaken for one.
    measured = summed.select(F.struct(*kept.columns).alias("_row"), "own", *parts)
    return measured.select("_row.*", *_features())


def style_and_tone(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``(id, SCORES, PROFILE)``; equal rows give one row."""
    known = _known_words(lexicon)
    cut = _cut(df.select(id_col, text_col), text_col)
    if known is None:
        return _summed_by_join(cut, id_col, lexicon).select(id_col, *_features())
    summed = cut.select(id_col, "own", _summed_in_row(known)("_words").alias("_sums"))
    return summed.select(id_col, "own", "_sums.*").select(id_col, *_features()).distinct()


def article_scores(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``(id, SCORES)``."""
    return style_and_tone(df, id_col, text_col, lexicon).select(id_col, *SCORES)


def sentiment_profile(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``(id, PROFILE)``."""
    return style_and_tone(df, id_col, text_col, lexicon).select(id_col, *PROFILE)
