"""Text, style, source and display functions over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import credibility as cr
from ..functions import display, register, style, text
from ..operators import verdict
from ..operators.corpus import drop_empty
from ..operators.lemmas import build_lemma_table, with_clean_ml
from ..operators.metrics import binary_metrics
from ..operators.reputation import with_credibility
from ..session import stored
from ..sources.tables import read_table
from . import inputs
from . import sqltext as q
from .base import Query, with_ctes


def _on_decorated(**columns: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that applies column functions to the decorated documents."""

    def build(spark: SparkSession, sf: str) -> DataFrame:
        return inputs.decorated(spark, sf).select(
            "doc_id", *[f(F.col("text")).alias(name) for name, f in columns.items()]
        )

    return build


def _sql_on_decorated(**columns: str) -> str:
    picked = ", ".join(f"{expr} AS {name}" for name, expr in columns.items())
    return with_ctes(f"SELECT doc_id, {picked} FROM deco", inputs.SQL_DECORATED)


def _share4(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda c: F.round(f(c), 4)


def full_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.documents(spark, sf).withColumn("title", F.expr(inputs.TITLE))
    return docs.select("doc_id", text.full_text(F.col("title"), F.col("text")).alias("raw_text"))


def non_empty(spark: SparkSession, sf: str) -> DataFrame:


    return drop_empty(inputs.decorated(spark, sf), "text").select("doc_id", "text")


def non_empty_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that are not empty. A filter on the key would be pushed below the join with the labels and compute every key
    once more, of rows without a label too; an array of no or one key is not."""
    key = text.canonical_key(F.col("raw_text"))
    kept = F.filter(F.array(key), lambda k: k != "")
    return inputs.labelled_variants(spark, sf).select("doc_id", F.explode(kept).alias("dedup_key"))


def lemma_table(spark: SparkSession, sf: str) -> DataFrame:
    """Lemmas of the corpus' own words, with every word of the corpus taken as a listed noun."""
    tokens = inputs.decorated(spark, sf).select(F.explode(text.ml_tokens(F.col("text"))).alias("token")).distinct()
    # Read twice: as the vocabulary and as the nouns.
    tokens = stored(tokens, "tokens")
    return build_lemma_table(tokens, tokens.withColumnRenamed("token", "word"))


def lemmatized(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.decorated(spark, sf).select("doc_id", "text")
    return with_clean_ml(docs, lemma_table(spark, sf), "doc_id", "text").select("doc_id", "text_ml")


def leakage_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = text.leakage_flags(F.col("text"))
    return inputs.decorated(spark, sf).select("doc_id", *[c.alias(name) for name, c in flags.items()])


def leakage_clean(spark: SparkSession, sf: str) -> DataFrame:
    scored = inputs.decorated(spark, sf).withColumn("score", text.leakage_flags(F.col("text"))["leakage_score"])
    cleaned = scored.withColumn("cleaned", text.leakage_clean(F.col("text"), F.col("score")))
    return cleaned.select("doc_id", "cleaned", text.leakage_message(F.col("score"), F.col("cleaned")).alias("message"))


def sentence_rows(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.decorated(spark, sf).select(
        "doc_id", F.posexplode(style.sentences(F.col("text"))).alias("pos", "sentence")
    ).withColumn("pos", F.col("pos").cast("long"))


def tone(spark: SparkSession, sf: str) -> DataFrame:
    """Tone from given subjectivity (density stands in for it) and both shouting measures."""
    c = F.col("text")
    parts = inputs.decorated(spark, sf).select(
        "doc_id",
        style.lexical_density(c).alias("subjectivity"),
        style.exclamation_ratio(style.sentences(c)).alias("exclamations"),
        style.caps_word_ratio(c).alias("caps_words"),
    )
    scored = parts.withColumn(
        "tone_score", style.tone_score(F.col("subjectivity"), F.col("exclamations"), F.col("caps_words"))
    )
    return scored.select("doc_id", "tone_score", style.tone_band(F.col("tone_score")).alias("emotional_tone"))


def domains(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.page_urls(spark, sf).select("page_id", cr.extract_domain(F.col("url")).alias("domain"))


def credibility(spark: SparkSession, sf: str) -> DataFrame:
    return with_credibility(inputs.page_urls(spark, sf), "url").drop("url")


def reputation_lookup(spark: SparkSession, sf: str) -> DataFrame:
    found = with_credibility(inputs.page_urls(spark, sf), "url")
    return found.groupBy("domain", "is_known_source", "credibility_score").agg(F.count(F.lit(1)).alias("n_pages"))


def preview(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.decorated(spark, sf).join(inputs.documents(spark, sf).select("doc_id", F.col("text").alias("t")), "doc_id")
    return docs.select("doc_id", text.text_preview(F.col("text"), F.col("t")).alias("preview"))


def composed_context(spark: SparkSession, sf: str) -> DataFrame:
    """Judge input and output and the reviewer's prompt for every conversation turn."""
    turns = read_table(spark, sf, "conversations")
    kind = F.when(F.col("role") == "user", "url").otherwise("text")
    url = F.concat(F.lit("https://example.org/"), F.col("conv_id").cast("string"))
    return turns.select(
        "conv_id",
        "turn",
        verdict.judge_input(F.col("text")).alias("judge_input"),
        verdict.judge_output(F.upper("role"), F.col("text")).alias("judge_output"),
        verdict.user_prompt(kind, url, F.col("text")).alias("prompt"),
    )


def labels_of_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = inputs.scores(spark, sf)
    return scores.select("doc_id", "model", verdict.label_from_score(F.col("y_score")).alias("ml_label"))


def fallback_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Probability for one event type, a decision value for another, only a class for the rest."""
    events = read_table(spark, sf, "events")
    p = F.when(F.col("event_type") == "click", F.col("value") / (F.col("value") + 5.0))
    decision = F.when(F.col("event_type") == "view", F.col("value") / 10.0 - 0.5)
    predicted = (F.col("value") > 5.0).cast("int")
    return events.select("event_id", F.round(verdict.score_fallback(p, decision, predicted), 4).alias("score"))


def confidences(spark: SparkSession, sf: str) -> DataFrame:
    scores = inputs.scores(spark, sf)
    label = verdict.label_from_score(F.col("y_score"))
    return scores.select("doc_id", "model", F.round(verdict.confidence_in_label(F.col("y_score"), label), 4).alias("confidence"))


def input_status(spark: SparkSession, sf: str) -> DataFrame:
    short = verdict.short_input_verdict(F.col("text"))
    docs = inputs.decorated(spark, sf).select("doc_id", short.alias("v"))
    return docs.select("doc_id", F.col("v").isNull().alias("usable"), "v.llm_score", "v.llm_label", "v.llm_reasoning", "v.n_related")


def display_format(spark: SparkSession, sf: str) -> DataFrame:
    metrics = binary_metrics(inputs.scores(spark, sf).filter("split = 'validation'"), ["model"])
    return metrics.select(
        display.model_title(F.col("model")).alias("model"),
        *[display.percent(F.col(m)).alias(m) for m in ("accuracy", "precision", "recall", "f1")],
    )


def key_signals(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("text")
    docs = inputs.decorated(spark, sf)
    return docs.select(
        "doc_id",
        display.signal(F.when(c.isNotNull(), F.round(style.caps_ratio(c), 4)), pct=True).alias("caps"),
        display.signal(F.when(c.isNotNull(), F.round(style.lexical_density(c), 4))).alias("density"),
        display.yes_no(F.when(c.isNotNull(), style.has_dateline(c))).alias("dateline"),
    )


def sql_named_functions(spark: SparkSession, sf: str) -> DataFrame:
    """The SQL names of the text functions, called from SQL text."""
    register.register_functions(spark)
    inputs.decorated(spark, sf).createOrReplaceTempView("decorated_documents")
    return spark.sql(
        """SELECT doc_id, clean_light(text) AS light, normalize_punct(text) AS punct, word_count(text) AS n_words,
 round(lexical_density(text), 4) AS density, round(caps_ratio(text), 4) AS caps, has_dateline(text) AS dateline,
 drop_first_sentence(text) AS rest, strip_publisher(text) AS stripped, clean_ml(text) AS ml,
 leakage_score(text) AS leakage, extract_domain('https://www.' || source || '.com:80/x') AS domain
 FROM decorated_documents"""
    )


_FLAGS = {
    "has_reuters_tag": "regexp_matches(coalesce(text, ''), '(?i)\\(Reuters\\)')",
    "has_location_prefix": "regexp_matches(substring(coalesce(text, ''), 1, 100), "
    + rf"'^[A-Z{q.WS}]{{3,20}}[{q.WS}]?(?:\([^)]+\))?[{q.WS}]?[-—]')",
    "has_twitter_handle": "regexp_matches(coalesce(text, ''), '@[A-Za-z0-9_]{1,15}')",
}
_LEAK_SCORE = (
    "least((CASE WHEN {has_reuters_tag} THEN 0.6 ELSE 0 END)::DOUBLE + (CASE WHEN {has_location_prefix} THEN 0.3 "
    "ELSE 0 END)::DOUBLE + (CASE WHEN {has_twitter_handle} THEN 0.1 ELSE 0 END)::DOUBLE, 1::DOUBLE)"
).format(**_FLAGS)

_LEMMA_CTES = (
    inputs.SQL_DECORATED,
    ("toks", f"SELECT doc_id, {q.ml_tokens('text')} AS t FROM deco"),
    ("vocab", "SELECT DISTINCT unnest(t) AS token FROM toks"),
    (
        "forms",
        "SELECT token, 0 AS place, token AS form FROM vocab"
        + "".join(
            f" UNION ALL SELECT token, {i}, left(token, length(token) - {len(end)}) || '{by}' FROM vocab "
            f"WHERE ends_with(token, '{end}')"
            for i, (end, by) in enumerate(
                (
                    ("s", ""),
                    ("ses", "s"),
                    ("ves", "f"),
                    ("xes", "x"),
                    ("zes", "z"),
                    ("ches", "ch"),
                    ("shes", "sh"),
                    ("men", "man"),
                    ("ies", "y"),
                ),
                1,
            )
        ),
    ),
    (
        "lemmas",
        """SELECT token, form AS lemma FROM (SELECT f.*, row_number() OVER (PARTITION BY f.token
 ORDER BY length(form), place, form) AS rn FROM forms f JOIN vocab v ON f.form = v.token) WHERE rn = 1""",
    ),
)

REPUTATION_CTE = (
    "rep",
    "SELECT domain, score::DOUBLE AS score FROM (VALUES "
    + ", ".join(f"('{d}', {s})" for d, s in cr.REPUTATION.items())
    + ") AS v(domain, score)",
)
CREDIBILITY_CTES = (
    inputs.SQL_PAGE_URLS,
    REPUTATION_CTE,
    ("doms", f"SELECT page_id, {q.domain('url')} AS domain FROM urls"),
    (
        "scored",
        """SELECT page_id, d.domain, score IS NOT NULL AS is_known_source,
 coalesce(score, 0.5::DOUBLE) AS credibility_score FROM doms d LEFT JOIN rep r ON d.domain = r.domain""",
    ),
    (
        "tiered",
        """SELECT *, CASE WHEN domain = '' THEN 'unknown' WHEN credibility_score >= 0.8 THEN 'high'
 WHEN credibility_score >= 0.6 THEN 'moderate' WHEN credibility_score >= 0.2 THEN 'low' ELSE 'very_low' END
 AS credibility_tier FROM scored""",
    ),
)

WARNING_VALUE = """CASE credibility_tier WHEN 'unknown' THEN 'No URL provided.'
 WHEN 'moderate' THEN 'Source ''' || domain || ''' has moderate credibility. Cross-check claims.'
 WHEN 'low' THEN 'Source ''' || domain || ''' has low credibility. Treat claims with skepticism.'
 WHEN 'very_low' THEN 'Source ''' || domain || ''' is a known unreliable site. Do not trust.' END"""

_SCORES_ONLY = q.SCORE_CTES

QUERIES = [
    Query(
        "full_text",
        full_text,
        f"SELECT doc_id, {q.strip('coalesce(title, chr(32)) || chr(32) || coalesce(text, chr(32))')} AS raw_text "
        f"FROM (SELECT *, {inputs.TITLE} AS title FROM documents)",
    ),
    Query(
        "drop_empty",
        non_empty,
        with_ctes(
            "SELECT doc_id, text FROM stripped WHERE text <> ''",
            inputs.SQL_DECORATED,
            ("stripped", "SELECT doc_id, " + q.strip("coalesce(text, '')") + " AS text FROM deco"),
        ),
    ),
    Query(
        "canonical_key",
        _on_decorated(dedup_key=text.canonical_key),
        _sql_on_decorated(dedup_key=q.canonical_key("text")),
    ),
    Query(
        "canonical_key_plain",
        _on_decorated(dedup_key=lambda c: text.canonical_key(c, normalize=False)),
        _sql_on_decorated(dedup_key=q.canonical_key("text")),
    ),
    Query(
        "drop_empty_key",
        non_empty_keys,
        with_ctes("SELECT doc_id, dedup_key FROM keyed WHERE dedup_key <> ''", *q.CANONICAL_CTES),
    ),
    Query("clean_light", _on_decorated(text_llm=text.clean_light), _sql_on_decorated(text_llm=q.clean_light("text"))),
    Query(
        "clean_ml",
        _on_decorated(text_ml=text.clean_ml),
        _sql_on_decorated(text_ml=f"array_to_string({q.ml_tokens('text')}, ' ')"),
    ),
    Query(
        "build_lemma_table",
        lemma_table,
        with_ctes("SELECT token, lemma FROM lemmas WHERE token <> lemma", *_LEMMA_CTES),
    ),
    Query(
        "lemmatize_tokens",
        lemmatized,
        with_ctes(
            """SELECT d.doc_id, coalesce(string_agg(lemma, ' ' ORDER BY pos), '') AS text_ml FROM deco d
 LEFT JOIN (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM toks) p ON d.doc_id = p.doc_id
 LEFT JOIN lemmas l ON p.token = l.token GROUP BY d.doc_id""",
            *_LEMMA_CTES,
        ),
    ),
    Query(
        "strip_publisher",
        _on_decorated(stripped=text.strip_publisher),
        _sql_on_decorated(stripped=q.strip_publisher("text")),
    ),
    Query(
        "normalize_punct",
        _on_decorated(normalized=text.normalize_punct),
        _sql_on_decorated(normalized=q.normalize_punct("text")),
    ),
    Query("leakage_flags", leakage_flags, _sql_on_decorated(**_FLAGS, leakage_score=_LEAK_SCORE)),
    Query(
        "leakage_clean",
        leakage_clean,
        with_ctes(
            """SELECT doc_id, cleaned, CASE WHEN score > 0 THEN 'Leakage Detected: Score ' || score::VARCHAR || chr(10)
 || 'Cleaned Text:' || chr(10) || cleaned ELSE 'No significant leakage markers detected. Text is safe for ML.' END
 AS message FROM cleaned""",
            inputs.SQL_DECORATED,
            ("leaks", f"SELECT doc_id, text, {_LEAK_SCORE} AS score FROM deco"),
            (
                "cleaned",
                f"""SELECT doc_id, score, CASE WHEN score > 0 THEN {q.normalize_punct(q.strip_publisher('text'))}
 ELSE text END AS cleaned FROM leaks""",
            ),
        ),
    ),
    Query(
        "word_count",
        _on_decorated(n_words=lambda c: text.word_count(F.coalesce(c, F.lit("")))),
        _sql_on_decorated(n_words=f"len({q.words('coalesce(text, chr(32))')})"),
    ),
    Query(
        "lexical_density",
        _on_decorated(lexical_density=_share4(style.lexical_density)),
        _sql_on_decorated(lexical_density=f"round({q.lexical_density('text')}, 4)"),
    ),
    Query(
        "caps_ratio",
        _on_decorated(caps_ratio=_share4(style.caps_ratio)),
        _sql_on_decorated(caps_ratio=f"round({q.caps_ratio('text')}, 4)"),
    ),
    Query(
        "has_dateline",
        _on_decorated(has_dateline=style.has_dateline),
        _sql_on_decorated(has_dateline=q.has_dateline("text")),
    ),
    Query(
        "sentence_split",
        sentence_rows,
        with_ctes(
            "SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM cut",
            inputs.SQL_DECORATED,
            ("cut", f"SELECT doc_id, {q.sentences('text')} AS s FROM deco"),
        ),
    ),
    Query(
        "exclamation_ratio",
        _on_decorated(exclamation_ratio=_share4(lambda c: style.exclamation_ratio(style.sentences(c)))),
        _sql_on_decorated(exclamation_ratio=f"round({q.exclamation_ratio('text')}, 4)"),
    ),
    Query(
        "caps_word_ratio",
        _on_decorated(caps_word_ratio=_share4(style.caps_word_ratio)),
        _sql_on_decorated(caps_word_ratio=f"round({q.caps_word_ratio('text')}, 4)"),
    ),
    Query(
        "tone_score",
        tone,
        with_ctes(
            """SELECT doc_id, tone_score, CASE WHEN tone_score < 0.25 THEN 'neutral' WHEN tone_score < 0.5
 THEN 'slightly_biased' ELSE 'highly_emotional' END AS emotional_tone FROM toned""",
            inputs.SQL_DECORATED,
            (
                "parts",
                f"""SELECT doc_id, {q.lexical_density('text')} AS a, {q.exclamation_ratio('text')} AS b,
 {q.caps_word_ratio('text')} AS c FROM deco""",
            ),
            (
                "toned",
                """SELECT doc_id, round(least(0.4::DOUBLE * a + 0.3::DOUBLE * least(b * 2::DOUBLE, 1)
 + 0.3::DOUBLE * least(c * 5::DOUBLE, 1), 1), 4) AS tone_score FROM parts""",
            ),
        ),
    ),
    Query("extract_domain", domains, with_ctes("SELECT page_id, domain FROM doms", *CREDIBILITY_CTES)),
    Query(
        "source_credibility",
        credibility,
        with_ctes(
            f"""SELECT page_id, domain, is_known_source, credibility_score, credibility_tier, {WARNING_VALUE} AS warning
 FROM tiered""",
            *CREDIBILITY_CTES,
        ),
    ),
    Query(
        "reputation_lookup",
        reputation_lookup,
        with_ctes(
            "SELECT domain, is_known_source, credibility_score, count(*) AS n_pages FROM tiered GROUP BY ALL",
            *CREDIBILITY_CTES,
        ),
    ),
    Query(
        "drop_first_sentence",
        _on_decorated(rest=text.drop_first_sentence),
        _sql_on_decorated(rest=q.drop_first_sentence("text")),
    ),
    Query(
        "text_preview",
        preview,
        with_ctes(
            """SELECT e.doc_id, substring(coalesce(e.text, d.text), 1, 250) AS preview FROM deco e
 JOIN documents d ON e.doc_id = d.doc_id""",
            inputs.SQL_DECORATED,
        ),
    ),
    Query(
        "truncate_context",
        composed_context,
        """SELECT conv_id, turn, substring(text, 1, 4000) AS judge_input,
 'Label: ' || upper(role) || chr(10) || 'Reasoning: ' || text AS judge_output,
 CASE WHEN role = 'user' THEN 'Verify this article sourced from the URL (https://example.org/' || conv_id || '):'
  ELSE 'Verify this article:' END || chr(10) || chr(10) || text AS prompt FROM conversations""",
    ),
    Query(
        "label_from_score",
        labels_of_scores,
        with_ctes(
            "SELECT doc_id, model, CASE WHEN y_score >= 0.5 THEN 'REAL' ELSE 'FAKE' END AS ml_label FROM scores",
            *_SCORES_ONLY,
        ),
    ),
    Query(
        "score_fallback",
        fallback_scores,
        """SELECT event_id, round(CASE event_type WHEN 'click' THEN value / (value + 5.0::DOUBLE)
 WHEN 'view' THEN 1::DOUBLE / (1::DOUBLE + exp(-(value / 10.0::DOUBLE - 0.5::DOUBLE)))
 ELSE (value > 5.0)::INTEGER::DOUBLE END, 4) AS score FROM events""",
    ),
    Query(
        "confidence_in_label",
        confidences,
        with_ctes(
            """SELECT doc_id, model, round(CASE WHEN y_score >= 0.5 THEN y_score ELSE 1::DOUBLE - y_score END, 4)
 AS confidence FROM scores""",
            *_SCORES_ONLY,
        ),
    ),
    Query(
        "input_status",
        input_status,
        with_ctes(
            f"""SELECT doc_id, NOT short AS usable, CASE WHEN short THEN 0.5::DOUBLE END AS llm_score,
 CASE WHEN short THEN 'FAKE' END AS llm_label, CASE WHEN short THEN '{verdict.TOO_SHORT}' END AS llm_reasoning,
 CASE WHEN short THEN 0 END AS n_related FROM sized""",
            inputs.SQL_DECORATED,
            ("sized", "SELECT doc_id, length(" + q.strip("coalesce(text, '')") + ") < 50 AS short FROM deco"),
        ),
    ),
    Query(
        "display_format",
        display_format,
        with_ctes(
            """SELECT CASE model WHEN 'density_model' THEN 'Density Model' WHEN 'length_model' THEN 'Length Model'
 ELSE 'Mixed Model' END AS model, printf('%.1f%%', round(accuracy * 100, 1)) AS accuracy,
 printf('%.1f%%', round(precision * 100, 1)) AS precision, printf('%.1f%%', round(recall * 100, 1)) AS recall,
 printf('%.1f%%', round(f1 * 100, 1)) AS f1 FROM metrics""",
            *q.SCORE_CTES,
            ("val_scores", "SELECT * FROM scores WHERE split = 'validation'"),
            *q.metric_ctes("val_scores", "model"),
        ),
    ),
    Query(
        "key_signals",
        key_signals,
        with_ctes(
            """SELECT doc_id, CASE WHEN text IS NULL THEN 'n/a' ELSE printf('%.2f%%', round(c * 100, 2)) END AS caps,
 CASE WHEN text IS NULL THEN 'n/a' ELSE printf('%.2f', round(d, 2)) END AS density,
 CASE WHEN text IS NULL THEN 'n/a' WHEN h THEN 'Yes' ELSE 'No' END AS dateline FROM s""",
            inputs.SQL_DECORATED,
            (
                "s",
                f"""SELECT doc_id, text, round({q.caps_ratio('text')}, 4) AS c, round({q.lexical_density('text')}, 4) AS d,
 {q.has_dateline('text')} AS h FROM deco""",
            ),
        ),
    ),
    Query(
        "sql_named_functions",
        sql_named_functions,
        _sql_on_decorated(
            light=q.clean_light("text"),
            punct=q.normalize_punct("text"),
            n_words=f"len({q.words('text')})",
            density=f"round({q.lexical_density('text')}, 4)",
            caps=f"round({q.caps_ratio('text')}, 4)",
            dateline=q.has_dateline("text"),
            rest=q.drop_first_sentence("text"),
            stripped=q.strip_publisher("text"),
            ml=f"array_to_string({q.ml_tokens('text')}, ' ')",
            leakage=_LEAK_SCORE,
            domain="source || '.com:80'",
        ),
    ),
]
