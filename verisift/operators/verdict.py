"""Verdict parsing and the blend of model score and reviewer verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, strip

# Blend rules, messages and defaults.
STRONG, MODERATE = 0.7, 0.3
NOTE_STRONG = "LLM reasoning quality was high — equal weight applied."
NOTE_MODERATE = "LLM reasoning quality was moderate — ML-led weighting applied."
NOTE_POOR = "LLM reasoning quality was low — ML-dominant weighting applied."
UNPARSED = "Failed to parse final JSON output. Raw output:\n"
BROKEN = "Failed to perform LLM analysis: "
TOO_SHORT = "Article content is missing or too short to analyze."
NO_REASONING = "No reasoning provided."
MIN_ARTICLE = 50
CONTEXT_CHARS = 4000


def label_from_score(p: Column) -> Column:
    return F.when(p >= 0.5, "REAL").otherwise("FAKE")


def score_fallback(probability: Column, decision: Column, prediction: Column) -> Column:
    """P(real) when there is one, else the squashed decision value, else the predicted class."""
    return F.coalesce(probability, 1.0 / (1.0 + F.exp(-decision)), prediction.cast("double"))


def confidence_in_label(p: Column, label: Column) -> Column:
    return F.when(label == "REAL", p).otherwise(1.0 - p)


def is_too_short(text: Column) -> Column:
    return F.length(strip(F.coalesce(text, F.lit("")))) < MIN_ARTICLE


def short_input_verdict(text: Column) -> Column:
    """Neutral verdict of a missing or too short article, null for a usable one."""
    return F.when(
        is_too_short(text),
        F.struct(
            F.lit(0.5).alias("llm_score"),
            F.lit("FAKE").alias("llm_label"),
            F.lit(TOO_SHORT).alias("llm_reasoning"),
            F.lit(0).cast("long").alias("n_related"),
        ),
    )


def user_prompt(input_type: Column, raw_input: Column, article: Column) -> Column:
    from_url = F.concat(F.lit("Verify this article sourced from the URL ("), raw_input, F.lit("):\n\n"), article)
    has_url = (input_type == "url") & (F.coalesce(raw_input, F.lit("")) != "")
    return F.when(has_url, from_url).otherwise(F.concat(F.lit("Verify this article:\n\n"), article))


def judge_input(article: Column) -> Column:
    return F.substring(article, 1, CONTEXT_CHARS)


def judge_output(label: Column, reasoning: Column) -> Column:
    return F.concat(F.lit("Label: "), label, F.lit("\nReasoning: "), reasoning)


def reasoning_score(article: Column, reasoning: Column, score: Column) -> Column:
    """The judge's score; 0 when article, reasoning or score is missing."""
    given = (F.coalesce(article, F.lit("")) != "") & (F.coalesce(reasoning, F.lit("")) != "")
    return F.coalesce(F.when(given, score), F.lit(0.0))


def with_parsed_verdict(df: DataFrame, text_col: str = "final_text") -> DataFrame:
    """Add ``llm_score``, ``llm_label`` and ``llm_reasoning`` from the first fenced json block.

    A block that is no valid JSON, or holds a label or confidence of the wrong kind, is an error
    verdict; a text without a block is unknown.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    block = F.regexp_extract(text, rf"(?s)```json[{WS}]*(\{{.*?\}})[{WS}]*```", 1)
    parsed = df.withColumn("_block", block).withColumn("_v", F.try_parse_json("_block"))

    def field(name: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", "variant")

    parsed = (
        parsed.withColumn("_label", field("label"))
        .withColumn("_conf", field("confidence"))
        .withColumn("_conf_value", F.try_variant_get("_v", "$.confidence", "double"))
        .withColumn("_why", F.try_variant_get("_v", "$.reasoning", "string"))
    )
    bad_label = F.col("_label").isNotNull() & (F.schema_of_variant("_label") != "STRING")
    bad_conf = F.col("_conf").isNotNull() & F.col("_conf_value").isNull()
    broken = F.col("_v").isNull() | bad_label | bad_conf
    none = F.col("_block") == ""
    label = F.upper(F.coalesce(F.try_variant_get("_v", "$.label", "string"), F.lit("FAKE")))
    return (
        parsed.withColumn(
            "llm_score", F.when(none | broken, 0.5).otherwise(F.coalesce("_conf_value", F.lit(0.5)))
        )
        .withColumn("llm_label", F.when(none, "UNKNOWN").when(broken, "FAKE").otherwise(label))
        .withColumn(
            "llm_reasoning",
            F.when(none, F.concat(F.lit(UNPARSED), text))
            .when(broken, F.lit(BROKEN + "invalid JSON"))
            .otherwise(F.coalesce("_why", text)),
        )
        .drop("_block", "_v", "_label", "_conf", "_conf_value", "_why")
    )


def blend_weights(eval_score: Column) -> tuple[Column, Column]:
    ml = F.when(eval_score >= STRONG, 0.5).when(eval_score >= MODERATE, 0.6).otherwise(0.7)
    llm = F.when(eval_score >= STRONG, 0.5).when(eval_score >= MODERATE, 0.4).otherwise(0.3)
    return ml, llm


def with_agreement(df: DataFrame) -> DataFrame:
    """Upper-case both labels; they agree when equal and known."""
    ml = F.upper(F.coalesce("ml_label", F.lit("UNKNOWN")))
    llm = F.upper(F.coalesce("llm_label", F.lit("UNKNOWN")))
    return (
        df.withColumn("ml_label", ml)
        .withColumn("llm_label", llm)
        .withColumn("ml_score", F.coalesce("ml_score", F.lit(0.0)))
        .withColumn("llm_score", F.coalesce("llm_score", F.lit(0.0)))
        .withColumn("eval_agreement", (F.col("ml_label") == F.col("llm_label")) & (F.col("ml_label") != "UNKNOWN"))
        .withColumn("eval_confidence_delta", F.abs(F.col("ml_score") - F.col("llm_score")))
    )


def with_blend(df: DataFrame) -> DataFrame:
    """Weights, blended P(real), final label and its confidence."""
    ml_weight, llm_weight = blend_weights(F.coalesce("eval_score", F.lit(0.0)))
    p_llm = F.when(F.col("llm_label") == "REAL", F.col("llm_score")).otherwise(1.0 - F.col("llm_score"))
    return (
        with_agreement(df)
        .withColumn("eval_score", F.coalesce("eval_score", F.lit(0.0)))
        .withColumn("ml_weight", ml_weight)
        .withColumn("llm_weight", llm_weight)
        .withColumn("p_real_final", F.col("ml_weight") * F.col("ml_score") + F.col("llm_weight") * p_llm)
        .withColumn("final_label", label_from_score(F.col("p_real_final")))
        .withColumn("final_score", confidence_in_label(F.col("p_real_final"), F.col("final_label")))
    )


def _two(c: Column) -> Column:
    return F.format_string("%.2f", F.round(c, 2))


def with_summary(df: DataFrame) -> DataFrame:
    """Add the verdict sentence and the explanation text of blended rows."""
    note = (
        F.when(F.col("eval_score") >= STRONG, NOTE_STRONG)
        .when(F.col("eval_score") >= MODERATE, NOTE_MODERATE)
        .otherwise(NOTE_POOR)
    )
    sentence = F.concat(
        F.lit("The article is classified as "),
        F.col("final_label"),
        F.lit(" with "),
        _two(F.col("final_score")),
        F.lit(" confidence. "),
        note,
        F.when(F.col("eval_agreement"), F.lit("")).otherwise(
            F.concat(F.lit(" (ML: "), F.col("ml_label"), F.lit(", AI: "), F.col("llm_label"), F.lit(")"))
        ),
    )
    reasoning = F.coalesce(F.col("llm_reasoning"), F.lit(NO_REASONING))
    explanation = F.concat(
        F.lit("\n### Analysis Results:\n- **ML Model:** "),
        F.col("ml_label"),
        F.lit(" (Confidence: "),
        _two(confidence_in_label(F.col("ml_score"), F.col("ml_label"))),
        F.lit(")\n- **AI Classifier:** "),
        F.col("llm_label"),
        F.lit(" (Confidence: "),
        _two(F.col("llm_score")),
        F.lit(")\n- **DeepEval Reasoning Score:** "),
        _two(F.col("eval_score")),
        F.lit("/1.0\n\n### AI Reasoning:\n"),
        reasoning,
        F.lit("\n"),
    )
    return df.withColumn("summary", sentence).withColumn("explanation", explanation)


def review_queue(df: DataFrame, id_col: str) -> DataFrame:
    """Articles whose two labels disagree, largest confidence gap first."""
    return df.filter(~F.col("eval_agreement")).orderBy(F.desc("eval_confidence_delta"), id_col)
