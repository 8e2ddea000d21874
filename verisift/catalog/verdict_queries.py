"""Verdict parsing, blending, tool traces and the scored article table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tools, verdict
from ..operators.reputation import with_credibility
from ..operators.sentiment import article_scores, sentiment_profile
from ..plans.score_articles import fixed_scorer, score_articles
from ..sources.demo import demo_lexicon
from ..sources.tables import read_table
from ..streaming.score_stream import ARRIVING, read_article_stream, start_scoring
from . import inputs, sentiment_queries
from . import sqltext as q
from .base import Query, scratch_dir, with_ctes
from .source_queries import MAIN_TEXT_CTES, MAIN_TEXT_VALUE
from .text_queries import CREDIBILITY_CTES, REPUTATION_CTE, WARNING_VALUE

# A reviewer's final message around a conversation turn; the length picks its kind.
_JSON_TEXT = (
    "replace(replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), "
    "chr(10), chr(92) || 'n'), chr(13), ''), chr(9), ' ')"
)
FINAL_TEXT = f"""CASE length(text) - 8 * CAST(floor(length(text) / 8) AS INT)
 WHEN 0 THEN text
 WHEN 1 THEN 'Done. ```json {{"label": "REAL", "confidence": 0.8' || chr(10) || '}} ``` ' || text
 WHEN 2 THEN 'Thought.' || chr(10) || '```json' || chr(10) || '{{"confidence": 0.35, "reasoning": "' || {_JSON_TEXT} || '"}}' || chr(10) || '```'
 WHEN 3 THEN '```json {{"label": "real", "reasoning": "' || {_JSON_TEXT} || '"}} ```'
 WHEN 4 THEN '```json {{"label": "fake", "confidence": 0.9}} ``` and ```json {{"label": "REAL"}} ```'
 WHEN 5 THEN '```json {{"label": "REAL", "confidence": "high"}} ```'
 WHEN 6 THEN '```json {{"label": 1, "confidence": 0.4}} ```'
 ELSE 'Thought.' || chr(10) || '```json' || chr(10) || '{{"label": "REAL", "confidence": 0.75, "reasoning": "'
  || {_JSON_TEXT} || '"}}' || chr(10) || '```' END"""
PARSE_CTES = (
    ("finals", f"SELECT conv_id, turn, {FINAL_TEXT} AS final_text FROM conversations"),
    (
        "blocks",
        f"SELECT *, regexp_extract(final_text, '(?s)```json[{q.WS}]*(\\{{.*?\\}})[{q.WS}]*```', 1) AS block FROM finals",
    ),
    ("valid", "SELECT *, CASE WHEN json_valid(block) THEN block::JSON END AS j FROM blocks"),
    (
        "fields",
        """SELECT *, json_type(j, '$.label') AS label_type, json_extract_string(j, '$.label') AS label,
 json_type(j, '$.confidence') AS conf_type, try_cast(json_extract_string(j, '$.confidence') AS DOUBLE) AS conf,
 json_extract_string(j, '$.reasoning') AS why FROM valid""",
    ),
    (
        "judged",
        """SELECT *, block = '' AS no_block, j IS NULL OR (label_type IS NOT NULL AND label_type <> 'VARCHAR')
 OR (conf_type IS NOT NULL AND conf IS NULL) AS broken FROM fields""",
    ),
)
PARSED_VALUES = """CASE WHEN no_block OR broken THEN 0.5::DOUBLE ELSE coalesce(conf, 0.5::DOUBLE) END AS llm_score,
 CASE WHEN no_block THEN 'UNKNOWN' WHEN broken THEN 'FAKE' ELSE upper(coalesce(label, 'FAKE')) END AS llm_label,
 CASE WHEN no_block THEN 'Failed to parse final JSON output. Raw output:' || chr(10) || final_text
  WHEN broken THEN 'Failed to perform LLM analysis: invalid JSON' ELSE coalesce(why, final_text) END AS llm_reasoning"""


def reviewer_texts(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.expr(FINAL_TEXT).alias("final_text"))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return verdict.with_parsed_verdict(reviewer_texts(spark, sf)).drop("final_text")


# Event values and types stand in for scores and labels of both sides.
EVENT_SCORES = """event_id, value / (value + 7.0) AS ml_score,
 CASE WHEN event_type = 'signup' THEN NULL WHEN value / (value + 7.0) >= 0.5 THEN 'REAL' ELSE 'Fake' END AS ml_label,
 1.0 / (1.0 + value / 3.0) AS llm_score,
 CASE event_type WHEN 'click' THEN 'REAL' WHEN 'view' THEN 'fake' WHEN 'purchase' THEN 'real'
  WHEN 'error' THEN 'UNKNOWN' ELSE 'FAKE' END AS llm_label,
 CASE WHEN event_type = 'purchase' THEN NULL ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100.0 END
 AS eval_score"""
_EVENTS = (
    "evs",
    f"""SELECT event_id, ml_score::DOUBLE AS ml_score, ml_label, llm_score::DOUBLE AS llm_score, llm_label,
 eval_score::DOUBLE AS eval_score FROM (SELECT {EVENT_SCORES} FROM events)""",
)
BLEND_CTES = (
    (
        "agreed",
        """SELECT * REPLACE (upper(coalesce(ml_label, 'UNKNOWN')) AS ml_label,
 upper(coalesce(llm_label, 'UNKNOWN')) AS llm_label, coalesce(eval_score, 0::DOUBLE) AS eval_score),
 upper(coalesce(ml_label, 'UNKNOWN')) = upper(coalesce(llm_label, 'UNKNOWN'))
 AND upper(coalesce(ml_label, 'UNKNOWN')) <> 'UNKNOWN' AS eval_agreement,
 abs(ml_score - llm_score) AS eval_confidence_delta FROM evs""",
    ),
    (
        "weighted",
        """SELECT *, CASE WHEN eval_score >= 0.7 THEN 0.5 WHEN eval_score >= 0.3 THEN 0.6 ELSE 0.7 END::DOUBLE AS ml_weight,
 CASE WHEN eval_score >= 0.7 THEN 0.5 WHEN eval_score >= 0.3 THEN 0.4 ELSE 0.3 END::DOUBLE AS llm_weight FROM agreed""",
    ),
    (
        "blended",
        """SELECT *, ml_weight * ml_score + llm_weight * CASE WHEN llm_label = 'REAL' THEN llm_score
 ELSE 1::DOUBLE - llm_score END AS p_real_final FROM weighted""",
    ),
    (
        "final",
        """SELECT *, CASE WHEN p_real_final >= 0.5 THEN 'REAL' ELSE 'FAKE' END AS final_label,
 CASE WHEN p_real_final >= 0.5 THEN p_real_final ELSE 1::DOUBLE - p_real_final END AS final_score FROM blended""",
    ),
)
SUMMARY_VALUE = f"""'The article is classified as ' || final_label || ' with ' || printf('%.2f', round(final_score, 2))
 || ' confidence. ' || CASE WHEN eval_score >= 0.7 THEN '{verdict.NOTE_STRONG}' WHEN eval_score >= 0.3
 THEN '{verdict.NOTE_MODERATE}' ELSE '{verdict.NOTE_POOR}' END
 || CASE WHEN eval_agreement THEN '' ELSE ' (ML: ' || ml_label || ', AI: ' || llm_label || ')' END"""


def _explanation(reasoning: str) -> str:
    return f"""chr(10) || '### Analysis Results:' || chr(10) || '- **ML Model:** ' || ml_label || ' (Confidence: '
 || printf('%.2f', round(CASE WHEN ml_label = 'REAL' THEN ml_score ELSE 1::DOUBLE - ml_score END, 2)) || ')' || chr(10)
 || '- **AI Classifier:** ' || llm_label || ' (Confidence: ' || printf('%.2f', round(llm_score, 2)) || ')' || chr(10)
 || '- **DeepEval Reasoning Score:** ' || printf('%.2f', round(eval_score, 2)) || '/1.0' || chr(10) || chr(10)
 || '### AI Reasoning:' || chr(10) || {reasoning} || chr(10)"""


def event_scores(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events").selectExpr(*_select_items(EVENT_SCORES))
    doubles = ("ml_score", "llm_score", "eval_score")
    return events.select("event_id", "ml_label", "llm_label", *[F.col(c).cast("double") for c in doubles])


def _select_items(text: str) -> list[str]:
    items, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            items.append(text[start:i])
            start = i + 1
    return [*items, text[start:]]


def weights(spark: SparkSession, sf: str) -> DataFrame:
    ml, llm = verdict.blend_weights(F.coalesce("eval_score", F.lit(0.0)))
    return event_scores(spark, sf).select("event_id", ml.alias("ml_weight"), llm.alias("llm_weight"))


def agreement(spark: SparkSession, sf: str) -> DataFrame:
    agreed = verdict.with_agreement(event_scores(spark, sf))
    return agreed.select("event_id", "eval_agreement", F.round("eval_confidence_delta", 4).alias("eval_confidence_delta"))


def blend(spark: SparkSession, sf: str) -> DataFrame:
    blended = verdict.with_blend(event_scores(spark, sf))
    return blended.select(
        "event_id", "final_label", F.round("p_real_final", 4).alias("p_real"), F.round("final_score", 4).alias("score")
    )


def summaries(spark: SparkSession, sf: str) -> DataFrame:
    rows = event_scores(spark, sf).withColumn("llm_reasoning", F.lit(None).cast("string"))
    return verdict.with_summary(verdict.with_blend(rows)).select("event_id", "summary", "explanation")


def queue(spark: SparkSession, sf: str) -> DataFrame:
    disagreeing = verdict.review_queue(verdict.with_agreement(event_scores(spark, sf)), "event_id")
    return disagreeing.select(
        "event_id", "ml_label", "llm_label", F.round("eval_confidence_delta", 4).alias("eval_confidence_delta")
    )


def reasoning_scores(spark: SparkSession, sf: str) -> DataFrame:
    """User turns have no reasoning, short ones no article, some no score."""
    turns = read_table(spark, sf, "conversations")
    article = F.when(F.length("text") > 100, F.col("text"))
    reasoning = F.when(F.col("role") == "assistant", F.substring("text", 1, 20))
    score = F.when(F.length("text") < 400, F.col("turn") / F.lit(10.0))
    return turns.select("conv_id", "turn", verdict.reasoning_score(article, reasoning, score).alias("eval_score"))


# Tool calls: every assistant turn calls the tool its length names; the next user turn answers it.
_TOOL_NAME = "CASE length(text) - 6 * CAST(floor(length(text) / 6) AS INT) " + " ".join(
    f"WHEN {i} THEN '{name}'" for i, name in enumerate(tools.TOOLS)
) + " ELSE NULL END"
_CALL_TITLE = "CASE WHEN length(text) < 250 THEN '' ELSE text END"


def _calls(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    turns = read_table(spark, sf, "conversations")
    calls = turns.filter("role = 'assistant'").select(
        F.col("conv_id").alias("article_id"),
        F.col("turn").alias("pos"),
        F.col("turn").alias("call_id"),
        F.expr(_TOOL_NAME).alias("name"),
        F.create_map(F.lit("article_title"), F.expr(_CALL_TITLE)).alias("args"),
    )
    results = turns.filter("role = 'user'").select(
        F.col("conv_id").alias("article_id"), (F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


_CALL_CTES = (
    (
        "paired",
        f"""SELECT c.conv_id AS article_id, c.turn AS pos, coalesce(c.name, 'unknown') AS name, c.title,
 coalesce(r.text, '') AS result FROM (SELECT *, {_TOOL_NAME} AS name, {_CALL_TITLE} AS title FROM conversations
 WHERE role = 'assistant') c LEFT JOIN (SELECT * FROM conversations WHERE role = 'user') r
 ON c.conv_id = r.conv_id AND c.turn = r.turn - 1""",
    ),
)


def paired_calls(spark: SparkSession, sf: str) -> DataFrame:
    paired = tools.pair_tool_results(*_calls(spark, sf))
    return paired.select("article_id", "pos", "name", F.col("args")["article_title"].alias("title"), "result")


def traces(spark: SparkSession, sf: str) -> DataFrame:
    traced = tools.tool_traces(tools.pair_tool_results(*_calls(spark, sf)))
    return traced.select(
        "article_id",
        F.size("tool_trace").cast("long").alias("n_calls"),
        F.array_join(F.transform("tool_trace", lambda e: e["name"]), ",").alias("names"),
    )


def first_queries(spark: SparkSession, sf: str) -> DataFrame:
    turns = read_table(spark, sf, "conversations")
    articles = turns.filter("turn = 0").select(F.col("conv_id").alias("article_id"), F.col("role").alias("title"))
    return tools.first_tool_query(articles, tools.pair_tool_results(*_calls(spark, sf)))


def tool_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls: four event types are tools, the others keep their own names."""
    names = {"click": tools.TOOLS[0], "view": tools.TOOLS[1], "purchase": tools.TOOLS[2]}
    name = F.col("event_type")
    for event, tool in names.items():
        name = F.when(F.col("event_type") == event, tool).otherwise(name)
    return tools.tool_call_counts(read_table(spark, sf, "events").select(name.alias("name")))


def tool_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs, lexicon = inputs.decorated(spark, sf), demo_lexicon(spark)
    features = article_scores(docs, "doc_id", "text", lexicon)
    tone = sentiment_profile(docs, "doc_id", "text", lexicon)
    return features.select("doc_id", tools.features_text().alias("features_text")).join(
        tone.select("doc_id", tools.sentiment_text().alias("sentiment_text")), "doc_id"
    )


def credibility_texts(spark: SparkSession, sf: str) -> DataFrame:
    found = with_credibility(inputs.page_urls(spark, sf), "url")
    return found.select("page_id", tools.credibility_text().alias("credibility_text"))


# Articles to score: pages with a URL and documents as plain text, each with a reviewer's message.
_SCORER = (-3.0, {"lexical_density": 5.0, "caps_ratio": 10.0, "sub_variance": 4.0, "mean_subjectivity": -1.0})
_REVIEW = """CASE WHEN raw_input LIKE '%/fr/%' THEN '```json {"label": "real", "confidence": 0.8, "reasoning": "steady"} ```'
 WHEN raw_input LIKE '%/de/%' THEN '```json {"label": "FAKE", "confidence": 0.7} ```'
 WHEN raw_input LIKE '%the%' THEN 'no block' ELSE '```json {"confidence": 0.2, "reasoning": "thin"} ```' END"""
_JUDGE = "CASE WHEN raw_input LIKE '%an%' THEN 0.75 WHEN raw_input LIKE '%er%' THEN 0.45 ELSE NULL END"


def arriving_articles(spark: SparkSession, sf: str) -> DataFrame:
    pages = inputs.pages(spark, sf).select(
        (F.col("page_id") * 2).alias("article_id"), F.lit("url").alias("input_type"), F.expr(inputs.DECORATED_URL).alias("raw_input"), "html"
    )
    texts = inputs.decorated(spark, sf).select(
        (F.col("doc_id") * 2 + 1).alias("article_id"),
        F.lit("text").alias("input_type"),
        F.col("text").alias("raw_input"),
        F.lit(None).cast("string").alias("html"),
    )
    both = pages.unionByName(texts)
    return both.withColumn("final_text", F.expr(_REVIEW)).withColumn("judge_score", F.expr(_JUDGE).cast("double"))


def _score(spark: SparkSession, articles: DataFrame) -> DataFrame:
    return score_articles(articles, demo_lexicon(spark), fixed_scorer(*_SCORER))


_VERDICT_COLUMNS = (
    "article_id",
    "status",
    "domain",
    "credibility_tier",
    "word_count",
    "ml_score",
    "ml_label",
    "llm_label",
    "eval_score",
    "final_label",
    "summary",
)


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    scored = _score(spark, arriving_articles(spark, sf))
    return scored.select(*_VERDICT_COLUMNS, F.round("final_score", 6).alias("final_score"))


def streamed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """The same articles through a file stream of several micro-batches; the result is what the stream wrote."""
    folder = scratch_dir(spark)
    columns = [f.name for f in ARRIVING.fields]
    arriving_articles(spark, sf).select(*columns).repartition(5, "article_id").write.parquet(f"{folder}/in")
    stream = read_article_stream(spark, f"{folder}/in", files_per_trigger=2)
    lexicon = demo_lexicon(spark)
    start_scoring(stream, lexicon, fixed_scorer(*_SCORER), f"{folder}/out", f"{folder}/offsets").awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    return out.select(*_VERDICT_COLUMNS, F.round("final_score", 6).alias("final_score"))


def _verdict_sql() -> str:
    b, w = _SCORER
    z = " + ".join([f"{b!r}::DOUBLE"] + [f"{v!r}::DOUBLE * {c}" for c, v in w.items()])
    return with_ctes(
        f"""SELECT article_id, status, domain, credibility_tier, word_count, ml_score, ml_label, llm_label, eval_score,
 final_label, {SUMMARY_VALUE} AS summary, round(final_score, 6) AS final_score FROM final""",
        *MAIN_TEXT_CTES,
        inputs.SQL_DECORATED,
        q.LEXICON_CTE,
        REPUTATION_CTE,
        (
            "articles",
            f"""SELECT p.page_id * 2 AS doc_id, 'url' AS input_type, {inputs.DECORATED_URL} AS raw_input, main_text AS text
 FROM pages p JOIN (SELECT page_id, {MAIN_TEXT_VALUE} AS main_text FROM blocks) m ON p.page_id = m.page_id
 UNION ALL SELECT doc_id * 2 + 1, 'text', text, coalesce(text, '') FROM deco""",
        ),
        sentiment_queries.doc_hits("articles"),
        *sentiment_queries.sentence_ctes("articles"),
        (
            "featured",
            f"""SELECT a.doc_id AS article_id, input_type, raw_input, text,
 CASE WHEN input_type = 'text' OR length({q.strip('text')}) > 80 THEN 'ok' ELSE 'too_short' END AS status,
 round(v, 4) AS sub_variance, subj4 AS mean_subjectivity, round({q.lexical_density('text')}, 4) AS lexical_density,
 round({q.caps_ratio('text')}, 4) AS caps_ratio, len({q.ml_tokens('text')}) AS word_count,
 CASE WHEN input_type = 'url' THEN {q.domain('raw_input')} ELSE '' END AS domain,
 {_REVIEW} AS final_text, ({_JUDGE})::DOUBLE AS judge_score, length({q.strip('text')}) < 50 AS short
 FROM articles a JOIN doc_avg d ON a.doc_id = d.doc_id JOIN variance v ON a.doc_id = v.doc_id""",
        ),
        ("blocks2", f"SELECT *, regexp_extract(final_text, '(?s)```json[{q.WS}]*(\\{{.*?\\}})[{q.WS}]*```', 1) AS block FROM featured"),
        (
            "reviewed",
            """SELECT *, CASE WHEN block <> '' THEN block::JSON END AS j,
 CASE WHEN short THEN 'x' WHEN block = '' THEN final_text ELSE coalesce(json_extract_string(
  CASE WHEN block <> '' THEN block::JSON END, '$.reasoning'), final_text) END AS why FROM blocks2""",
        ),
        (
            "evs",
            f"""SELECT r.*, round(1::DOUBLE / (1::DOUBLE + exp(-({z}))), 4) AS ml_score,
 CASE WHEN round(1::DOUBLE / (1::DOUBLE + exp(-({z}))), 4) >= 0.5 THEN 'REAL' ELSE 'FAKE' END AS ml_label,
 CASE WHEN short OR block = '' THEN 0.5::DOUBLE ELSE json_extract_string(j, '$.confidence')::DOUBLE END AS llm_score,
 CASE WHEN short THEN 'FAKE' WHEN block = '' THEN 'UNKNOWN'
  ELSE upper(coalesce(json_extract_string(j, '$.label'), 'FAKE')) END AS llm_label,
 CASE WHEN text <> '' AND why <> '' THEN judge_score END AS eval_score,
 CASE WHEN r.domain = '' THEN 'unknown' WHEN coalesce(score, 0.5) >= 0.8 THEN 'high' WHEN coalesce(score, 0.5) >= 0.6
  THEN 'moderate' WHEN coalesce(score, 0.5) >= 0.2 THEN 'low' ELSE 'very_low' END AS credibility_tier
 FROM reviewed r LEFT JOIN rep ON r.domain = rep.domain""",
        ),
        *BLEND_CTES,
    )


_NUMBER = "regexp_replace({0}::DECIMAL(18,4)::VARCHAR, '0{{1,3}}$', '')"


def _text_lines(*pairs: tuple[str, str]) -> str:
    return " || chr(10) || ".join(f"'{name}: ' || {value}" for name, value in pairs)


def _n(column: str) -> str:
    return _NUMBER.format(column)


def _bool(column: str) -> str:
    return f"CASE WHEN {column} THEN 'True' ELSE 'False' END"


_FEATURE_LINES = _text_lines(
    ("Subjectivity Variance", _n("sub_variance")),
    ("Mean Subjectivity", _n("mean_subjectivity")),
    ("Lexical Density", _n("lexical_density")),
    ("Caps Ratio", _n("caps_ratio")),
    ("Has Dateline", _bool("has_dateline")),
)
_TONE_LINES = _text_lines(
    ("Emotional Tone", "emotional_tone"),
    ("Tone Score", _n("tone_score") + " || ' (0=neutral, 1=sensationalist)'"),
    ("Polarity", _n("overall_polarity")),
    ("Subjectivity", _n("overall_subjectivity")),
    ("Exclamation Ratio", _n("exclamation_ratio")),
    ("ALL-CAPS Word Ratio", _n("caps_word_ratio")),
    ("Sentence Count", "sentence_count::VARCHAR"),
)


def _credibility_text_sql() -> str:
    lines = _text_lines(
        ("Domain", "domain"),
        ("Credibility Score", _n("credibility_score")),
        ("Credibility Tier", "credibility_tier"),
        ("Known Source", _bool("is_known_source")),
    )
    return with_ctes(
        f"SELECT page_id, {lines} || coalesce(chr(10) || 'Warning: ' || {WARNING_VALUE}, '') AS credibility_text FROM tiered",
        *CREDIBILITY_CTES,
    )


QUERIES = [
    Query("parse_verdict", parsed, with_ctes(f"SELECT conv_id, turn, {PARSED_VALUES} FROM judged", *PARSE_CTES)),
    Query(
        "blend_weights",
        weights,
        with_ctes("SELECT event_id, ml_weight, llm_weight FROM weighted", _EVENTS, *BLEND_CTES),
    ),
    Query(
        "agreement",
        agreement,
        with_ctes(
            "SELECT event_id, eval_agreement, round(eval_confidence_delta, 4) AS eval_confidence_delta FROM agreed",
            _EVENTS,
            *BLEND_CTES,
        ),
    ),
    Query(
        "blend_verdict",
        blend,
        with_ctes(
            "SELECT event_id, final_label, round(p_real_final, 4) AS p_real, round(final_score, 4) AS score FROM final",
            _EVENTS,
            *BLEND_CTES,
        ),
    ),
    Query(
        "verdict_summary",
        summaries,
        with_ctes(
            f"""SELECT event_id, {SUMMARY_VALUE} AS summary,
 {_explanation("'" + verdict.NO_REASONING + "'")} AS explanation FROM final""",
            _EVENTS,
            *BLEND_CTES,
        ),
    ),
    Query(
        "review_queue",
        queue,
        with_ctes(
            """SELECT event_id, ml_label, llm_label, round(eval_confidence_delta, 4) AS eval_confidence_delta FROM agreed
 WHERE NOT eval_agreement""",
            _EVENTS,
            *BLEND_CTES,
        ),
    ),
    Query(
        "reasoning_score_default",
        reasoning_scores,
        """SELECT conv_id, turn, CASE WHEN length(text) > 100 AND role = 'assistant' AND length(text) < 400
 THEN turn / 10.0::DOUBLE ELSE 0::DOUBLE END AS eval_score FROM conversations""",
    ),
    Query("pair_tool_results", paired_calls, with_ctes("SELECT * FROM paired", *_CALL_CTES)),
    Query(
        "tool_traces",
        traces,
        with_ctes(
            """SELECT article_id, count(*) AS n_calls, string_agg(name, ',' ORDER BY pos) AS names FROM paired
 GROUP BY article_id""",
            *_CALL_CTES,
        ),
    ),
    Query(
        "first_tool_query",
        first_queries,
        with_ctes(
            """SELECT a.conv_id AS article_id, coalesce(s.asked, a.role) AS query,
 CASE WHEN s.article_id IS NOT NULL THEN CASE WHEN s.first_title <> '' THEN substring(s.first_title, 1, 120)
  ELSE '(none)' END END AS shown_query, string_split(s.first_result, chr(10))[1] AS result_first_line
 FROM (SELECT * FROM conversations WHERE turn = 0) a LEFT JOIN (SELECT article_id,
  arg_min(title, pos) FILTER (title <> '') AS asked, arg_min(title, pos) AS first_title,
  arg_min(result, pos) AS first_result FROM paired WHERE name = 'cross_reference_tool' GROUP BY article_id) s
 ON a.conv_id = s.article_id""",
            *_CALL_CTES,
        ),
    ),
    Query(
        "tool_call_counts",
        tool_counts,
        with_ctes(
            """SELECT coalesce(t.name, c.name) AS name, coalesce(n, 0) AS times, coalesce(place, 6) AS place
 FROM tools t FULL JOIN counts c ON t.name = c.name""",
            (
                "tools",
                "SELECT * FROM (VALUES "
                + ", ".join(f"('{n}', {i})" for i, n in enumerate(tools.TOOLS, 1))
                + ") AS v(name, place)",
            ),
            (
                "counts",
                """SELECT CASE event_type WHEN 'click' THEN 'sentiment_analysis_tool' WHEN 'view'
 THEN 'source_credibility_tool' WHEN 'purchase' THEN 'cross_reference_tool' ELSE event_type END AS name,
 count(*) AS n FROM events GROUP BY 1""",
            ),
        ),
    ),
    Query(
        "agent_tools_text",
        tool_texts,
        f"""SELECT doc_id, {_FEATURE_LINES} AS features_text, sentiment_text
 FROM ({sentiment_queries.SCORES_SQL}) JOIN (SELECT doc_id, {_TONE_LINES} AS sentiment_text
 FROM ({sentiment_queries.PROFILE_SQL})) USING (doc_id)""",
    ),
    Query("credibility_text", credibility_texts, _credibility_text_sql()),
    Query("score_articles", verdicts, _verdict_sql()),
    Query("stream_score_articles", streamed_verdicts, _verdict_sql()),
]
