"""Lexicon sentiment, as narrow results and as columns added to the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sentiment as se
from ..sources.demo import demo_lexicon
from . import inputs
from . import sqltext as q
from .base import Query, with_ctes


def doc_sentiment(spark: SparkSession, sf: str) -> DataFrame:
    return se.doc_sentiment(inputs.documents(spark, sf), "doc_id", "text", demo_lexicon(spark))


def article_scores(spark: SparkSession, sf: str) -> DataFrame:
    return se.article_scores(inputs.decorated(spark, sf), "doc_id", "text", demo_lexicon(spark))


def article_scores_in_row(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.decorated(spark, sf).select("doc_id", "text")
    return se.with_style_and_tone(docs, "doc_id", "text", demo_lexicon(spark)).select("doc_id", *se.SCORES)


def subjectivity_variance(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.documents(spark, sf)
    return se.article_scores(docs, "doc_id", "text", demo_lexicon(spark)).select("doc_id", "sub_variance")


def sentiment_profile(spark: SparkSession, sf: str) -> DataFrame:
    return se.sentiment_profile(inputs.decorated(spark, sf), "doc_id", "text", demo_lexicon(spark))


def sentiment_profile_in_row(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.decorated(spark, sf).select("doc_id", "text")
    return se.with_style_and_tone(docs, "doc_id", "text", demo_lexicon(spark)).select("doc_id", *se.PROFILE)


def _rounded_mean(total: str, n: str) -> str:
    """Four decimals of a mean of millionths, half away from zero, in whole numbers."""
    half_up = f"(2 * abs({total}) + 100 * {n}) // (200 * {n})"
    return f"CASE WHEN {n} > 0 THEN (CASE WHEN {total} < 0 THEN -1 ELSE 1 END * ({half_up}))::DOUBLE / 10000 ELSE 0 END"


def _mean(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN {total}::DOUBLE / ({n} * 1000000)::DOUBLE ELSE 0 END"


_SUMS = """coalesce(sum(round(polarity * 1000000)::BIGINT), 0)::BIGINT AS sp,
 coalesce(sum(round(subjectivity * 1000000)::BIGINT), 0)::BIGINT AS ss, count(subjectivity) AS n"""


def doc_hits(source: str) -> tuple[str, str]:
    """``doc_avg``: both means at four decimals, and the exact mean subjectivity."""
    return (
        "doc_avg",
        f"""SELECT doc_id, {_rounded_mean('sp', 'n')} AS pol4, {_rounded_mean('ss', 'n')} AS subj4, {_mean('ss', 'n')} AS subj
 FROM (SELECT d.doc_id, {_SUMS}
 FROM {source} d LEFT JOIN (SELECT doc_id, unnest({q.lexicon_words('text')}) AS word FROM {source}) w
 ON d.doc_id = w.doc_id LEFT JOIN lexicon l ON w.word = l.word GROUP BY d.doc_id)""",
    )


def sentence_ctes(source: str) -> tuple:
    return (
        (
            "sents",
            f"""SELECT doc_id, generate_subscripts(s, 1) AS pos, unnest(s) AS sentence
 FROM (SELECT doc_id, {q.sentences('text')} AS s FROM {source})""",
        ),
        (
            "sent_avg",
            f"""SELECT doc_id, round(({_mean('ss', 'n')}) * 1000000000)::HUGEINT AS mean FROM (
 SELECT s.doc_id, s.pos, {_SUMS} FROM sents s LEFT JOIN
 (SELECT doc_id, pos, unnest({q.lexicon_words('sentence')}) AS word FROM sents) w
 ON s.doc_id = w.doc_id AND s.pos = w.pos LEFT JOIN lexicon l ON w.word = l.word GROUP BY s.doc_id, s.pos)""",
        ),
        (
            "variance",
            f"""SELECT d.doc_id, CASE WHEN count(mean) > 1 THEN
 (count(mean) * sum(mean * mean) - sum(mean) * sum(mean))::DOUBLE
 / ((count(mean) * (count(mean) - 1))::DOUBLE * 1e18::DOUBLE) ELSE 0 END AS v FROM {source} d
 LEFT JOIN sent_avg s ON d.doc_id = s.doc_id GROUP BY d.doc_id""",
        ),
    )


SCORES_SQL = with_ctes(
    f"""SELECT d.doc_id, round(v, 4) AS sub_variance, subj4 AS mean_subjectivity,
 round({q.lexical_density("coalesce(text, '')")}, 4) AS lexical_density,
 round({q.caps_ratio("coalesce(text, '')")}, 4) AS caps_ratio, {q.has_dateline("coalesce(text, '')")} AS has_dateline
 FROM deco d JOIN doc_avg a ON d.doc_id = a.doc_id JOIN variance v ON d.doc_id = v.doc_id""",
    inputs.SQL_DECORATED,
    q.LEXICON_CTE,
    doc_hits("deco"),
    *sentence_ctes("deco"),
)

PROFILE_SQL = with_ctes(
    """SELECT *, CASE WHEN tone_score < 0.25 THEN 'neutral' WHEN tone_score < 0.5 THEN 'slightly_biased'
 ELSE 'highly_emotional' END AS emotional_tone FROM (SELECT doc_id, pol4 AS overall_polarity,
 subj4 AS overall_subjectivity, n AS sentence_count, round(e, 4) AS exclamation_ratio,
 round(c, 4) AS caps_word_ratio, round(least(0.4::DOUBLE * subj + 0.3::DOUBLE * least(e * 2::DOUBLE, 1)
 + 0.3::DOUBLE * least(c * 5::DOUBLE, 1), 1), 4) AS tone_score FROM measured)""",
    inputs.SQL_DECORATED,
    q.LEXICON_CTE,
    doc_hits("deco"),
    (
        "measured",
        f"""SELECT d.doc_id, pol4, subj4, subj, len({q.sentences('text')}) AS n, {q.exclamation_ratio('text')} AS e,
 {q.caps_word_ratio('text')} AS c FROM deco d JOIN doc_avg a ON d.doc_id = a.doc_id""",
    ),
)

QUERIES = [
    Query(
        "doc_sentiment",
        doc_sentiment,
        with_ctes(
            "SELECT doc_id, pol4 AS polarity, subj4 AS subjectivity FROM doc_avg",
            q.LEXICON_CTE,
            doc_hits("documents"),
        ),
    ),
    Query(
        "sentence_subjectivity_variance",
        subjectivity_variance,
        with_ctes(
            "SELECT doc_id, round(v, 4) AS sub_variance FROM variance", q.LEXICON_CTE, *sentence_ctes("documents")
        ),
    ),
    Query("article_scores", article_scores, SCORES_SQL),
    Query("article_scores_in_row", article_scores_in_row, SCORES_SQL),
    Query("sentiment_profile", sentiment_profile, PROFILE_SQL),
    Query("sentiment_profile_in_row", sentiment_profile_in_row, PROFILE_SQL),
]
