"""Tool calls of the fact-checking agent: pairing, counting, queries and rendered results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tool names in display order.
TOOLS = (
    "sentiment_analysis_tool",
    "source_credibility_tool",
    "cross_reference_tool",
    "preprocess_leakage_tool",
    "fetch_url_tool",
)
SEARCH_TOOL = "cross_reference_tool"
QUERY_SHOWN = 120
NO_QUERY = "(none)"


def pair_tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call with the result of the same call id; a missing name is ``unknown``, a missing result empty.

    ``calls`` is ``(article_id, pos, call_id, name, args)``, ``results`` is ``(article_id, call_id,
    content)``. Call ids belong to one article, so the join key never gathers more than one call.
    """
    matched = calls.join(results, ["article_id", "call_id"], "left")
    return matched.select(
        "article_id",
        "pos",
        F.coalesce(F.when(F.col("name") != "", F.col("name")), F.lit("unknown")).alias("name"),
        "args",
        F.coalesce("content", F.lit("")).alias("result"),
    )


def tool_traces(paired: DataFrame) -> DataFrame:
    """The ordered trace of an article as one array; an article holds as many entries as it made calls."""
    entries = F.collect_list(F.struct("pos", "name", "args", "result"))

    def by_place(a: Column, b: Column) -> Column:
        return F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)

    return paired.groupBy("article_id").agg(F.array_sort(entries, by_place).alias("tool_trace"))


def tool_call_counts(calls: DataFrame) -> DataFrame:
    """Calls per tool: the fixed tools in display order (0 when unused), then other names."""
    spark = calls.sparkSession
    fixed = spark.createDataFrame([(n, i) for i, n in enumerate(TOOLS, 1)], "name string, place long")
    counts = calls.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.join(F.broadcast(fixed), "name", "full_outer")
        .select(
            "name",
            F.coalesce("n", F.lit(0).cast("long")).alias("times"),
            F.coalesce("place", F.lit(len(TOOLS) + 1).cast("long")).alias("place"),
        )
    )


def first_tool_query(articles: DataFrame, paired: DataFrame) -> DataFrame:
    """The search query of every article and what is shown of its first search call.

    The query is the first non-empty title argument of a search call, else the article's own title.
    ``articles`` is ``(article_id, title)``; ``paired.args`` is a string map.
    """
    title = F.coalesce(F.try_element_at("args", F.lit("article_title")), F.lit(""))
    search = paired.filter(F.col("name") == SEARCH_TOOL).withColumn("asked", title)
    first = search.groupBy("article_id").agg(
        F.min_by(F.when(F.col("asked") != "", F.col("asked")), F.when(F.col("asked") != "", F.col("pos"))).alias("asked"),
        F.min_by(F.struct("asked", "result"), "pos").alias("shown"),
    )
    joined = articles.join(first, "article_id", "left")
    shown = F.when(F.col("shown.asked") != "", F.substring("shown.asked", 1, QUERY_SHOWN)).otherwise(NO_QUERY)
    return joined.select(
        "article_id",
        F.coalesce("asked", "title", F.lit("")).alias("query"),
        F.when(F.col("shown").isNotNull(), shown).alias("shown_query"),
        F.split("shown.result", r"\r\n|\n|\r", 2).getItem(0).alias("result_first_line"),
    )


def _number(c: Column) -> Column:
    """A four-decimal value without padding zeros, but with at least one decimal."""
    return F.regexp_replace(c.cast("decimal(18,4)").cast("string"), "0{1,3}$", "")


def _flag(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def _lines(*pairs: tuple[str, Column]) -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in pairs])


def sentiment_text() -> Column:
    return _lines(
        ("Emotional Tone", F.col("emotional_tone")),
        ("Tone Score", F.concat(_number(F.col("tone_score")), F.lit(" (0=neutral, 1=sensationalist)"))),
        ("Polarity", _number(F.col("overall_polarity"))),
        ("Subjectivity", _number(F.col("overall_subjectivity"))),
        ("Exclamation Ratio", _number(F.col("exclamation_ratio"))),
        ("ALL-CAPS Word Ratio", _number(F.col("caps_word_ratio"))),
        ("Sentence Count", F.col("sentence_count").cast("string")),
    )


def features_text() -> Column:
    return _lines(
        ("Subjectivity Variance", _number(F.col("sub_variance"))),
        ("Mean Subjectivity", _number(F.col("mean_subjectivity"))),
        ("Lexical Density", _number(F.col("lexical_density"))),
        ("Caps Ratio", _number(F.col("caps_ratio"))),
        ("Has Dateline", _flag(F.col("has_dateline"))),
    )


def credibility_text() -> Column:
    lines = _lines(
        ("Domain", F.col("domain")),
        ("Credibility Score", _number(F.col("credibility_score"))),
        ("Credibility Tier", F.col("credibility_tier")),
        ("Known Source", _flag(F.col("is_known_source"))),
    )
    return F.concat_ws("\n", lines, F.concat(F.lit("Warning: "), F.col("warning")))


def cross_reference_text(shown: Column) -> Column:
    """Counts, sources and summary, then ``shown`` lines of the first articles (an array of strings)."""
    sources = F.when(F.size("sources") > 0, F.array_join("sources", ", ")).otherwise("None")
    head = _lines(
        ("Related articles found", F.col("related_count").cast("string")),
        ("Sources", sources),
        ("Summary", F.col("corroboration_summary")),
    )
    return F.concat_ws("\n", head, F.array_join(shown, "\n"))
