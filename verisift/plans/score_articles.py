"""Articles in, verdicts out, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_ml, word_count
from ..operators import verdict
from ..operators.features import fixed_score
from ..operators.lemmas import with_clean_ml
from ..operators.reputation import with_credibility
from ..operators.sentiment import with_style_and_tone
from ..sources.html import usable_status, with_main_text

Scorer = Callable[[DataFrame], DataFrame]


def fixed_scorer(intercept: float, coefficients: dict[str, float], name: str = "fixed") -> Scorer:
    """Score from given coefficients; the stand-in for a fitted model."""

    def score(df: DataFrame) -> DataFrame:
        scored = df.withColumn("ml_score", fixed_score(intercept, coefficients))
        return scored.withColumn("ml_label", verdict.label_from_score(F.col("ml_score"))).withColumn(
            "ml_model_name", F.lit(name)
        )

    return score


def ingest(articles: DataFrame, lexicon: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Article text from page or raw input, with text status, model text, features and tone.

    ``articles`` has a unique ``article_id``, ``input_type`` (``url`` or ``text``), ``raw_input`` and, for URLs, ``html``.
    Rejected pages stay as rows with their status.
    """
    from_page = F.col("input_type") == "url"
    staged = with_main_text(articles.withColumn("_page", F.when(from_page, F.col("html"))), "_page", "_page_text")
    text = F.when(from_page, F.col("_page_text")).otherwise(F.coalesce("raw_input", F.lit("")))
    staged = staged.withColumn("article_text", text).drop("_page", "_page_text")
    staged = staged.withColumn(
        "status", F.when(from_page, usable_status(F.col("article_text"))).otherwise(F.lit("ok"))
    )
    if lemmas is None:
        staged = staged.withColumn("article_text_ml", clean_ml(F.col("article_text")))
    else:
        staged = with_clean_ml(staged, lemmas, "article_id", "article_text")
        staged = staged.withColumnRenamed("text_ml", "article_text_ml")
    staged = staged.withColumn("word_count", word_count(F.col("article_text_ml")))
    return with_style_and_tone(staged, "article_id", "article_text", lexicon)


def score_articles(
    articles: DataFrame,
    lexicon: DataFrame,
    scorer: Scorer,
    reputation: DataFrame | None = None,
    lemmas: DataFrame | None = None,
) -> DataFrame:
    """Ingest, score, look up the source, parse the reviewer's verdict and blend.

    Besides the columns of ``ingest``, ``articles`` has the reviewer's ``final_text`` and the judge's
    ``judge_score``.
    """
    scored = scorer(ingest(articles, lexicon, lemmas))
    scored = with_credibility(
        scored.withColumn("_url", F.when(F.col("input_type") == "url", F.col("raw_input"))), "_url", reputation
    ).drop("_url")
    parsed = verdict.with_parsed_verdict(scored)
    short = verdict.is_too_short(F.col("article_text"))
    parsed = (
        parsed.withColumn("llm_score", F.when(short, 0.5).otherwise(F.col("llm_score")))
        .withColumn("llm_label", F.when(short, "FAKE").otherwise(F.col("llm_label")))
        .withColumn("llm_reasoning", F.when(short, verdict.TOO_SHORT).otherwise(F.col("llm_reasoning")))
        .withColumn(
            "eval_score",
            verdict.reasoning_score(F.col("article_text"), F.col("llm_reasoning"), F.col("judge_score")),
        )
    )
    return verdict.with_summary(verdict.with_blend(parsed))


