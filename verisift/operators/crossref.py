"""Related coverage in a corpus table: the best-matching articles of every query article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import WORD, words
from ..session import stored
from .similarity import SIMILARITY_DIGITS
from .vocabulary import idf

# Query length, number of related articles, and summary texts.
QUERY_WORDS = 15
PAGE_SIZE = 5
NONE_FOUND = (
    "No related articles found. This could indicate the story is exclusive, too niche, or fabricated."
)
FEW_FOUND = "Only %d related article(s) found from %s. Limited corroboration available."
MANY_FOUND = "Found %d related articles from %d source(s): %s. Multiple sources corroborate this story."


def query_text(title: Column, body: Column) -> Column:
    """The title, or the first words of the text when there is no title."""
    first = F.array_join(F.slice(words(F.coalesce(body, F.lit(""))), 1, QUERY_WORDS), " ")
    return F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(first)


def distinct_terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"([{WORD}]{{2,}})"), 1))


def related_articles(
    queries: DataFrame, corpus: DataFrame, n_docs: int, page_size: int = PAGE_SIZE
) -> DataFrame:
    """``(query_id, doc_id, relevancy, place)``: the ``page_size`` corpus rows with the highest summed
    IDF of shared terms, ties by id.

    ``queries`` is ``(query_id, query)``, ``corpus`` is ``(doc_id, text)``, both with unique ids. The corpus is tokenised
    once, and only (row, term) pairs of terms that a query has are kept. Terms are taken rarest first. A few rows of
    every term give each query a floor that its page reaches at least. A row that shares only terms from some point on
    cannot pass what these terms add up to; from where that lies below the floor, terms are only probed in rows that a
    rarer term brought up, and never bring up rows themselves. So a term that a third of all rows have costs nothing
    for queries that have rarer ones.
    """
    asked = queries.select("query_id", F.explode(distinct_terms(F.col("query"))).alias("term"))
    asked = stored(asked, "asked")
    wanted = asked.select("term").distinct()
    present = corpus.select("doc_id", F.explode(distinct_terms(F.col("text"))).alias("term"))
    present = stored(present.join(wanted, "term", "left_semi"), "present")
    weights = present.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(weights.select("term", idf(F.col("df"), n_docs).alias("w")), "term")
    # What a row can reach with this term as its rarest: a query has few terms, whatever the corpus.
    onward = W.partitionBy("query_id").orderBy(F.desc("w"), "term").rowsBetween(W.currentRow, W.unboundedFollowing)
    weighted = stored(weighted.withColumn("reach", F.sum("w").over(onward)), "weighted")

    some = F.row_number().over(W.partitionBy("term").orderBy("doc_id"))
    few = present.withColumn("_n", some).filter(F.col("_n") <= page_size).drop("_n")
    seeds = probed(weighted.select("query_id", "term").join(few, "term"), weighted, present)
    floors = _page(seeds, page_size).filter(F.col("place") == page_size)
    floors = floors.select("query_id", (F.col("relevancy") - 10.0**-SIMILARITY_DIGITS).alias("floor"))
    open_ = weighted.join(floors, "query_id", "left").filter(F.col("reach") >= F.coalesce("floor", F.lit(0.0)))
    found = probed(open_.select("query_id", "term").join(present, "term"), weighted, present)
    return _page(found, page_size).select("query_id", "doc_id", "relevancy", F.col("place").cast("long").alias("place"))


def probed(brought: DataFrame, weighted: DataFrame, present: DataFrame) -> DataFrame:
    """(query_id, doc_id, relevancy) of the pairs in ``brought``, summed over all terms they share.

    The terms of a row and the weights of a query travel as arrays, so a pair stays one row. Weights are added in one
    order, the heaviest first.
    """
    pairs = brought.select("query_id", "doc_id").distinct()
    rows = present.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    # As many terms as a row and the queries share, and as a query has.
    rows = rows.groupBy("doc_id").agg(F.collect_list("term").alias("terms"))
    asked = weighted.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("w", "term")), asc=False).alias("asked"))
    both = pairs.join(rows, "doc_id").join(asked, "query_id")
    shared = F.filter("asked", lambda a: F.array_contains("terms", a["term"]))
    total = F.aggregate(shared, F.lit(0.0), lambda s, a: s + a["w"])
    return both.select("query_id", "doc_id", F.round(total, SIMILARITY_DIGITS).alias("relevancy"))


def _page(scored: DataFrame, page_size: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevancy"), "doc_id"))
    return scored.withColumn("place", place).filter(F.col("place") <= page_size)


def cross_reference(queries: DataFrame, related: DataFrame, sources: DataFrame) -> DataFrame:
    """Count, sorted distinct sources and summary text per query; ``sources`` is ``(doc_id, source)``.

    ``related`` has at most a page of rows per query, so its groups are small by construction.
    """
    named = related.join(sources, "doc_id")
    found = named.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_set(F.when(F.coalesce("source", F.lit("")) != "", F.col("source")))).alias("s"),
    )
    joined = queries.select("query_id").join(found, "query_id", "left")
    count = F.coalesce("n", F.lit(0).cast("long"))
    listed = F.coalesce("s", F.array().cast("array<string>"))
    names = F.array_join(listed, ", ")
    summary = (
        F.when(count == 0, F.lit(NONE_FOUND))
        .when(count <= 2, F.format_string(FEW_FOUND, count, names))
        .otherwise(F.format_string(MANY_FOUND, count, F.size(listed), names))
    )
    return joined.select(
        "query_id", count.alias("related_count"), listed.alias("sources"), summary.alias("corroboration_summary")
    )


# How many related articles are shown and the stand-ins for missing names.
SHOWN = 3
NO_TITLE, NO_SOURCE = "(untitled)", "Unknown"


def top_sources(related: DataFrame, articles: DataFrame) -> DataFrame:
    """The first shown articles of every query with stand-in names and a note on how many there are.

    ``articles`` is ``(doc_id, title, source)``.
    """
    total = F.count(F.lit(1)).over(W.partitionBy("query_id"))
    noted = related.withColumn("total", total).filter(F.col("place") <= SHOWN).join(articles, "doc_id")

    def named(col: str, stand_in: str) -> Column:
        return F.coalesce(F.when(F.col(col) != "", F.col(col)), F.lit(stand_in))

    note = F.when(F.col("total") > SHOWN, F.format_string("Showing top %d of %d matches.", F.lit(SHOWN), F.col("total")))
    return noted.select(
        "query_id",
        "place",
        "doc_id",
        named("title", NO_TITLE).alias("title"),
        named("source", NO_SOURCE).alias("source"),
        note.alias("note"),
    )
