"""Term tables, similarity audits, related coverage and ablation data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, crossref, ranking, similarity, tools, vocabulary
from ..operators.corpus import stratified_split
from ..session import stored
from ..sources.tables import read_table
from . import inputs
from . import sqltext as q
from .base import Query, with_ctes


def _term_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _terms_of(inputs.split_texts(spark, sf))


def _terms_of(corpus: DataFrame) -> DataFrame:
    """Terms of a split corpus, whose rows are materialised because vocabulary and counts both read them."""
    terms = vocabulary.ngram_terms(F.col("raw_text")).alias("terms")
    return stored(corpus.select("doc_id", "label", "split", terms), "terms")


def _train(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("split") == "train")


def _vocabulary(rows: DataFrame) -> tuple[DataFrame, int]:
    n_docs = _train(rows).count()
    return stored(vocabulary.vocabulary(_train(rows), n_docs), "vocabulary"), n_docs


def sides_of(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Test and train vectors ``(id, terms, weights)`` of a split corpus, fitted on its train split."""
    rows = _terms_of(corpus)
    vocab, n_docs = _vocabulary(rows)
    vectors = vocabulary.tfidf_vectors(rows, vocab, n_docs).join(rows.select("doc_id", "split"), "doc_id")
    vectors = stored(vectors.withColumnRenamed("doc_id", "id"), "vectors")
    test, train = (vectors.filter(F.col("split") == s).drop("split") for s in ("test", "train"))
    return test, train


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return sides_of(inputs.split_texts(spark, sf))


def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.documents(spark, sf).select("doc_id", vocabulary.ngram_terms(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", "|")).alias("digest"))


def term_table(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.documents(spark, sf).select("doc_id", vocabulary.ngram_terms(F.col("text")).alias("terms"))
    return vocabulary.term_stats(docs)


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return _vocabulary(_term_rows(spark, sf))[0].select("term", "tf", "df")


def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    rows = _term_rows(spark, sf)
    vocab, n_docs = _vocabulary(rows)
    return vocabulary.tfidf_long(vocabulary.tfidf_vectors(rows, vocab, n_docs), vocab)


def counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _term_rows(spark, sf)
    vocab, _ = _vocabulary(rows)
    return vocabulary.with_terms(vocabulary.term_counts(rows, vocab), vocab).select("doc_id", "term", "tf")


def scaled(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.split_corpus(spark, sf)
    columns = ["lexical_density", "caps_ratio", "n_words"]
    out = vocabulary.scale_numeric(rows, columns, _train(rows))
    return out.select("doc_id", *[F.round(f"{c}_scaled", 4).alias(f"{c}_scaled") for c in columns])


def fixed_scores(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.scores(spark, sf).select("doc_id", "model", "y_score", "y_pred")


def _shown(matches: DataFrame) -> DataFrame:
    return matches.select("test_id", "train_id", F.round("similarity", 6).alias("similarity"))


def nearest(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(similarity.nearest_train_match(*_sides(spark, sf)))


def nearest_report(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest train row of every test row, with both labels and both text previews."""
    matches = similarity.nearest_train_match(*_sides(spark, sf))
    texts = inputs.labelled(spark, sf).select("doc_id", "label", F.substring("raw_text", 1, 250).alias("preview"))
    test = texts.select(F.col("doc_id").alias("test_id"), F.col("label").alias("test_label"), F.col("preview").alias("test_preview"))
    train = texts.select(
        F.col("doc_id").alias("train_id"), F.col("label").alias("train_label"), F.col("preview").alias("train_preview")
    )
    return _shown(matches).join(test, "test_id").join(train, "train_id")


def similar(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(similarity.similar_train_matches(*_sides(spark, sf)))


def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.similarity_thresholds(similarity.similar_train_matches(*_sides(spark, sf)))


def top(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(similarity.top_matches(*_sides(spark, sf)))


def dense(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    split = stratified_split(vectors, *inputs.SHARES, seed=inputs.SEED, id_col="id").select("id", "embedding", "split")
    split = stored(split, "split")
    test, train = (split.filter(F.col("split") == s).drop("split") for s in ("test", "train"))
    return _shown(similarity.nearest_dense_match(test, train))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    items = read_table(spark, sf, "benchmark")
    return items.select(F.col("item_id").alias("query_id"), crossref.query_text(F.lit(""), F.col("text")).alias("query"))


def _related(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.documents(spark, sf).select("doc_id", "text")
    return crossref.related_articles(_queries(spark, sf), docs, docs.count())


def related(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf).withColumn("relevancy", F.round("relevancy", 6))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    sources = inputs.documents(spark, sf).select("doc_id", "source")
    found = crossref.cross_reference(_queries(spark, sf), _related(spark, sf), sources)
    return found.withColumn("sources", F.array_join("sources", ","))


def shown_sources(spark: SparkSession, sf: str) -> DataFrame:
    articles = inputs.documents(spark, sf).select(
        "doc_id", F.expr(inputs.TITLE).alias("title"), F.expr("CASE WHEN lang = 'fr' THEN '' ELSE source END").alias("source")
    )
    return crossref.top_sources(_related(spark, sf), articles)


def coverage_text(spark: SparkSession, sf: str) -> DataFrame:
    """The tool text of every query: counts, sources, summary and a line per shown article."""
    docs = inputs.documents(spark, sf).select("doc_id", "text", "source")
    related = stored(crossref.related_articles(_queries(spark, sf), docs, docs.count()), "related")
    found = crossref.cross_reference(_queries(spark, sf), related, docs.select("doc_id", "source"))
    shown = crossref.top_sources(related, docs.select("doc_id", F.lit(None).cast("string").alias("title"), "source"))
    line = F.format_string("%d. %s (%s)", "place", "title", "source")
    # At most SHOWN lines per query.
    lines = shown.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    joined = found.join(lines, "query_id", "left")
    text = tools.cross_reference_text(F.coalesce("lines", F.array().cast("array<string>")))
    return joined.select("query_id", text.alias("cross_reference_text"))


def log_odds_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Top terms of a given coefficient table: smoothed log odds of a term between the classes."""
    rows = _term_rows(spark, sf).select(F.explode("terms").alias("term"), "label")
    tf = rows.groupBy("term").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("real"), F.sum((F.col("label") == 0).cast("long")).alias("fake")
    )
    coefficients = tf.select("term", F.log((F.col("real") + 1.0) / (F.col("fake") + 1.0)).alias("coefficient"))
    return ranking.top_terms(coefficients)


def ablation_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.labelled(spark, sf).withColumn("text_ml", F.col("raw_text"))
    return audit.without_first_sentence(rows).select("doc_id", "ablate_text_ml")


#: From ``toks(doc_id, split, t)``, the terms of the rows, to ``vocab`` of the train rows and ``w``, normed weights.
TERM_CTES = (
    ("train_n", "SELECT count(*) AS n FROM toks WHERE split = 'train'"),
    (
        "stats",
        """SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term
 FROM toks WHERE split = 'train') GROUP BY term""",
    ),
    (
        "vocab",
        """SELECT term, tf, df, n FROM stats, train_n WHERE df >= 3 AND df <= 0.95::DOUBLE * n
 ORDER BY tf DESC, term LIMIT 20000""",
    ),
    (
        "tcounts",
        """SELECT doc_id, split, x.term, count(*) AS tf, max(df) AS df, max(n) AS n FROM (SELECT doc_id, split,
 unnest(t) AS term FROM toks) x JOIN vocab v ON x.term = v.term GROUP BY doc_id, split, x.term""",
    ),
    ("raw_w", "SELECT *, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0::DOUBLE) AS w0 FROM tcounts"),
    ("w", "SELECT doc_id, split, term, w0 / sqrt(sum(w0 * w0) OVER (PARTITION BY doc_id)) AS w FROM raw_w"),
)
_VOCAB_CTES = (
    q.LABELLED_CTE,
    *q.split_ctes("labelled"),
    (
        "toks",
        f"""SELECT l.doc_id, l.label, s.split, {q.terms('raw_text')} AS t FROM labelled l
 JOIN splits s ON l.doc_id = s.doc_id""",
    ),
    *TERM_CTES,
)
_SIM_CTES = (
    *_VOCAB_CTES,
    (
        "sims",
        """SELECT a.doc_id AS test_id, b.doc_id AS train_id, round(sum(a.w * b.w), 9) AS s FROM w a JOIN w b
 ON a.term = b.term WHERE a.split = 'test' AND b.split = 'train' GROUP BY a.doc_id, b.doc_id""",
    ),
    (
        "best",
        """SELECT t.doc_id AS test_id, coalesce(b.train_id, (SELECT min(doc_id) FROM toks WHERE split = 'train')) AS train_id,
 coalesce(b.s, 0::DOUBLE) AS s FROM (SELECT doc_id FROM toks WHERE split = 'test') t LEFT JOIN (SELECT * FROM (
 SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY s DESC, train_id) AS rn FROM sims) WHERE rn = 1) b
 ON t.doc_id = b.test_id""",
    ),
)
_SHOWN = "test_id, train_id, round(s, 6) AS similarity"

_QUERY_CTES = (
    (
        "qs",
        f"SELECT item_id AS query_id, array_to_string({q.words('text')}[1:15], ' ') AS query FROM benchmark",
    ),
    (
        "qterms",
        f"""SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[{q.WORD}]{{2,}}')) AS term FROM qs""",
    ),
    (
        "dterms",
        f"""SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[{q.WORD}]{{2,}}')) AS term FROM documents""",
    ),
    (
        "idfs",
        """SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + count(*))) + 1.0::DOUBLE AS idf
 FROM dterms WHERE term IN (SELECT term FROM qterms) GROUP BY term""",
    ),
    (
        "scored",
        """SELECT query_id, doc_id, round(sum(idf), 9) AS r FROM qterms t JOIN idfs i ON t.term = i.term
 JOIN dterms d ON t.term = d.term GROUP BY query_id, doc_id""",
    ),
    (
        "related",
        """SELECT * FROM (SELECT query_id, doc_id, r, row_number() OVER (PARTITION BY query_id ORDER BY r DESC, doc_id)
 AS place FROM scored) WHERE place <= 5""",
    ),
)

QUERIES = [
    Query(
        "ngram_terms",
        ngrams,
        f"""SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, '|')) AS digest
 FROM (SELECT doc_id, {q.terms('text')} AS t FROM documents)""",
    ),
    Query(
        "term_stats",
        term_table,
        f"""SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df
 FROM (SELECT doc_id, unnest({q.terms('text')}) AS term FROM documents) GROUP BY term""",
    ),
    Query("vocabulary", vocab, with_ctes("SELECT term, tf, df FROM vocab", *_VOCAB_CTES)),
    Query("tfidf", tfidf, with_ctes("SELECT doc_id, term, round(w, 4) AS weight FROM w", *_VOCAB_CTES)),
    Query("bag_of_words", counts, with_ctes("SELECT doc_id, term, tf FROM tcounts", *_VOCAB_CTES)),
    Query(
        "scale_numeric",
        scaled,
        with_ctes(
            "SELECT f.doc_id, "
            + ", ".join(
                f"round((f.{c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END, 4) AS {c}_scaled"
                for c in ("lexical_density", "caps_ratio", "n_words")
            )
            + " FROM split_features f, fitted",
            *q.SCORE_CTES,
            (
                "fitted",
                "SELECT "
                + ", ".join(
                    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("lexical_density", "caps_ratio", "n_words")
                )
                + " FROM split_features WHERE split = 'train'",
            ),
        ),
    ),
    Query(
        "fixed_scorer",
        fixed_scores,
        with_ctes("SELECT doc_id, model, y_score, y_pred FROM scores", *q.SCORE_CTES),
    ),
    Query("nearest_train_match", nearest, with_ctes(f"SELECT {_SHOWN} FROM best", *_SIM_CTES)),
    Query(
        "similar_train_matches", similar, with_ctes(f"SELECT {_SHOWN} FROM best WHERE s > 0.95", *_SIM_CTES)
    ),
    Query(
        "similarity_report",
        nearest_report,
        with_ctes(
            f"""SELECT {_SHOWN}, a.label AS test_label, substring(a.raw_text, 1, 250) AS test_preview,
 b.label AS train_label, substring(b.raw_text, 1, 250) AS train_preview FROM best
 JOIN labelled a ON test_id = a.doc_id JOIN labelled b ON train_id = b.doc_id""",
            *_SIM_CTES,
        ),
    ),
    Query(
        "similarity_thresholds",
        thresholds,
        with_ctes(
            """SELECT count(*) FILTER (s > 0.95) AS gt_0_95, count(*) FILTER (s > 0.98) AS gt_0_98,
 count(*) FILTER (s > 0.99) AS gt_0_99 FROM best""",
            *_SIM_CTES,
        ),
    ),
    Query(
        "top_matches",
        top,
        with_ctes(f"SELECT {_SHOWN} FROM best ORDER BY s DESC, test_id LIMIT 10", *_SIM_CTES),
    ),
    Query(
        "nearest_dense_match",
        dense,
        with_ctes(
            """SELECT test_id, train_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (
 PARTITION BY test_id ORDER BY s DESC, train_id) AS rn FROM (SELECT a.vec_id AS test_id, b.vec_id AS train_id,
 round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s
 FROM embeddings a JOIN splits x ON a.vec_id = x.doc_id AND x.split = 'test', embeddings b
 JOIN splits y ON b.vec_id = y.doc_id AND y.split = 'train')) WHERE rn = 1""",
            ("vecs", "SELECT vec_id AS doc_id, label FROM embeddings"),
            *q.split_ctes("vecs"),
        ),
    ),
    Query(
        "related_articles",
        related,
        with_ctes("SELECT query_id, doc_id, round(r, 6) AS relevancy, place FROM related", *_QUERY_CTES),
    ),
    Query(
        "cross_reference",
        coverage,
        with_ctes(
            f"""SELECT query_id, n AS related_count, s AS sources, CASE WHEN n = 0 THEN '{crossref.NONE_FOUND}'
 WHEN n <= 2 THEN 'Only ' || n || ' related article(s) found from ' || replace(s, ',', ', ')
  || '. Limited corroboration available.'
 ELSE 'Found ' || n || ' related articles from ' || k || ' source(s): ' || replace(s, ',', ', ')
  || '. Multiple sources corroborate this story.' END AS corroboration_summary FROM found""",
            *_QUERY_CTES,
            (
                "found",
                """SELECT q.query_id, count(r.doc_id) AS n, count(DISTINCT source) AS k,
 coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS s FROM qs q LEFT JOIN related r
 ON q.query_id = r.query_id LEFT JOIN documents d ON r.doc_id = d.doc_id GROUP BY q.query_id""",
            ),
        ),
    ),
    Query(
        "cross_reference_text",
        coverage_text,
        with_ctes(
            """SELECT query_id, 'Related articles found: ' || n || chr(10) || 'Sources: '
 || CASE WHEN n = 0 THEN 'None' ELSE s END || chr(10) || 'Summary: ' || CASE WHEN n = 0
 THEN 'No related articles found. This could indicate the story is exclusive, too niche, or fabricated.'
 WHEN n <= 2 THEN 'Only ' || n || ' related article(s) found from ' || s || '. Limited corroboration available.'
 ELSE 'Found ' || n || ' related articles from ' || k || ' source(s): ' || s
  || '. Multiple sources corroborate this story.' END || chr(10) || shown AS cross_reference_text FROM found""",
            *_QUERY_CTES,
            (
                "found",
                """SELECT q.query_id, count(r.doc_id) AS n, count(DISTINCT source) AS k,
 coalesce(string_agg(DISTINCT source, ', ' ORDER BY source), '') AS s,
 coalesce(string_agg(place || '. (untitled) (' || source || ')', chr(10) ORDER BY place) FILTER (place <= 3), '')
  AS shown FROM qs q LEFT JOIN related r
 ON q.query_id = r.query_id LEFT JOIN documents d ON r.doc_id = d.doc_id GROUP BY q.query_id""",
            ),
        ),
    ),
    Query(
        "top_sources",
        shown_sources,
        with_ctes(
            """SELECT r.query_id, place, r.doc_id, CASE WHEN lang = 'de' THEN '(untitled)' ELSE source END AS title,
 CASE WHEN lang = 'fr' THEN 'Unknown' ELSE source END AS source,
 CASE WHEN total > 3 THEN 'Showing top 3 of ' || total || ' matches.' END AS note
 FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM related) r JOIN documents d
 ON r.doc_id = d.doc_id WHERE place <= 3""",
            *_QUERY_CTES,
        ),
    ),
    Query(
        "top_terms",
        log_odds_terms,
        with_ctes(
            """SELECT term, round(c, 4) AS coefficient, 'real' AS class, hi AS place FROM ranked WHERE hi <= 30
 UNION ALL SELECT term, round(c, 4), 'fake', lo FROM ranked WHERE lo <= 30""",
            *_VOCAB_CTES[: len(_VOCAB_CTES) - 6],
            (
                "coefs",
                """SELECT term, ln((count(*) FILTER (label = 1) + 1.0::DOUBLE) / (count(*) FILTER (label = 0) + 1.0::DOUBLE))
 AS c FROM (SELECT label, unnest(t) AS term FROM toks) GROUP BY term""",
            ),
            (
                "ranked",
                """SELECT *, row_number() OVER (ORDER BY c DESC, term) AS hi, row_number() OVER (ORDER BY c, term) AS lo
 FROM coefs""",
            ),
        ),
    ),
    Query(
        "first_sentence_ablation_texts",
        ablation_texts,
        with_ctes(
            f"""SELECT doc_id, rest AS ablate_text_ml FROM (SELECT doc_id, {q.drop_first_sentence('raw_text')} AS rest
 FROM labelled) WHERE rest <> ''""",
            q.LABELLED_CTE,
        ),
    ),
]
