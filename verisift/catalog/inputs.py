"""Inputs derived from the given tables, in Spark and, where a query has SQL, as the same CTE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import style, text
from ..operators.corpus import stratified_split
from ..operators.features import fixed_score
from ..session import stored
from ..sources.tables import read_table, with_sequence

# Documents by themselves hold no publisher marks, links or tags, so some sources get them.
DECORATED_TEXT = """CASE source
 WHEN 'src0' THEN 'WASHINGTON (Reuters) - ' || text
 WHEN 'src1' THEN 'NEW YORK (Reuters) - ' || text
 WHEN 'src2' THEN 'Title first WASHINGTON (Reuters) - ' || text
 WHEN 'src3' THEN 'LONDON — ' || text
 WHEN 'src4' THEN text || ' Photo by Some One/Agency'
 WHEN 'src5' THEN 'Keep. Read more: gone' || chr(10) || text
 WHEN 'src6' THEN 'See http://x.y/z?q=1 <b>bold</b> @handle ' || text
 WHEN 'src7' THEN text || ' Really?!? Yes!!'
 WHEN 'src8' THEN ''
 WHEN 'src9' THEN NULL
 WHEN 'src10' THEN 'PARIS (AFP) - ' || text
 WHEN 'src11' THEN replace(text, ' ', '  ')
 WHEN 'src12' THEN '(reuters) You cannot go, I wanna STAY. It is GONNA RAIN! ' || text
 WHEN 'src13' THEN chr(10) || '  ' || text || '  ' || chr(9)
 ELSE text END"""

# Page URLs all have unknown hosts, so some get known ones.
DECORATED_URL = """CASE
 WHEN url LIKE '%/fr/%' THEN regexp_replace(url, '^[a-z]+://[^/]+', 'https://www.reuters.com')
 WHEN url LIKE '%/de/%' THEN regexp_replace(url, '^[a-z]+://[^/]+', 'http://foxnews.com:8080')
 WHEN url LIKE '%/es/%' THEN regexp_replace(url, '^[a-z]+://[^/]+', 'https://breitbart.com')
 WHEN url LIKE '%#top' THEN ''
 WHEN url LIKE 'http://%' THEN regexp_replace(url, '^[a-z]+://[^/]+', 'https://WWW.TheOnion.com')
 WHEN url LIKE '%ref=x' THEN regexp_replace(url, '^[a-z]+://[^/]+', 'https://foxnews.com')
 ELSE url END"""

TITLE = "CASE WHEN lang = 'de' THEN NULL ELSE source END"

# Three fixed models over style features: intercept and coefficients.
MODELS = {
    "density_model": (-4.0, {"lexical_density": 6.5, "caps_ratio": 12.0}),
    "length_model": (2.5, {"n_words": -0.004, "caps_ratio": 20.0}),
    "mixed_model": (0.75, {"lexical_density": -1.5, "n_words": 0.003}),
}
SHARES = (0.70, 0.20, 0.10)
SEED = 42


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages")


def decorated(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", "lang", "source", F.expr(DECORATED_TEXT).alias("text"))


SQL_DECORATED = ("deco", f"SELECT doc_id, lang, source, {DECORATED_TEXT} AS text FROM documents")


def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages").select("page_id", F.expr(DECORATED_URL).alias("url"))


SQL_PAGE_URLS = ("urls", f"SELECT page_id, {DECORATED_URL} AS url FROM pages")


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: quality is the label, fake rows come first."""
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    rows = documents(spark, sf).join(labels, "doc_id")
    rows = rows.select("doc_id", "label", "lang", "source", F.expr(TITLE).alias("title"), "text")
    return with_sequence(rows).withColumn("raw_text", text.strip(F.coalesce("text", F.lit(""))))


def labelled_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows and three altered copies: respaced, punctuation only, and blank."""
    base = labelled(spark, sf).select("doc_id", "label", F.col("text").alias("raw_text"))
    respaced = base.select(
        F.col("doc_id") * 4 + 1, "label", F.concat(F.replace("raw_text", F.lit(" "), F.lit("  ")), F.lit(" !!"))
    )
    marks = base.select(F.col("doc_id") * 4 + 2, "label", F.regexp_replace("raw_text", "[^!?.]+", ""))
    blank = base.select(F.col("doc_id") * 4 + 3, "label", F.lit(" \n "))
    first = base.select(F.col("doc_id") * 4, "label", "raw_text")
    return with_sequence(first.union(respaced).union(marks).union(blank).toDF("doc_id", "label", "raw_text"))


def style_features(df: DataFrame) -> DataFrame:
    """Two style features and the word count of ``raw_text``."""
    raw = F.col("raw_text")
    return (
        df.withColumn("lexical_density", F.round(style.lexical_density(raw), 4))
        .withColumn("caps_ratio", F.round(style.caps_ratio(raw), 4))
        .withColumn("n_words", text.word_count(raw))
    )


def split_features(rows: DataFrame) -> DataFrame:
    """Narrow feature rows with a 70/20/10 split.

    The split reads its input three times, so the features are materialised without the text first.
    """
    features = stored(
        style_features(rows).select("doc_id", "label", "lexical_density", "caps_ratio", "n_words"), "features"
    )
    return stratified_split(features, *SHARES, seed=SEED)


def split_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return split_features(labelled(spark, sf))


def split_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with their text and the same split."""
    return stratified_split(labelled(spark, sf), *SHARES, seed=SEED)


def score_rows(features: DataFrame, keep: list[str]) -> DataFrame:
    """Long scores of the three fixed models over rows with style features."""
    structs = [
        F.struct(F.lit(name).alias("model"), F.lit(i).alias("model_order"), fixed_score(b, w).alias("y_score"))
        for i, (name, (b, w)) in enumerate(MODELS.items(), 1)
    ]
    rows = features.select(*keep, F.col("label").alias("y_true"), F.explode(F.array(*structs)).alias("m"))
    return rows.select(*keep, "y_true", "m.*").withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return score_rows(split_corpus(spark, sf), ["doc_id", "split"])
